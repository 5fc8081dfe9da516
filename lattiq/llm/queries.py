"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lattiq.llm import decontaminate, html, language, mixing, neardup, quality, runs, spelling, suffixes, tokencount, tokens, toxicity, vectors

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html": html.op2_html,
    "op3_language": language.op3_language,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_token_planes": tokens.op5_token_planes,
    "op6_neardup": neardup.op6_neardup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_vectors": vectors.op9_vectors,
    "op10_mixing": mixing.op10_mixing,
    "op11_runs": runs.op11_runs,
    "op12_token_counts": tokencount.op12_token_counts,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op9_vectors": vectors.OP9_SQL,
    "op6_neardup": neardup.OP6_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
