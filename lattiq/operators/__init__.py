"""Panel, tensor, model and evaluation operators over long and wide DataFrames."""
