"""Panel and tensor analytics on Spark."""
