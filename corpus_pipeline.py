"""A corpus pipeline of training-data operators: each stage is written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of documents, the last reads its token files back: (doc_id, start, n_tokens, ids_crc32) for
every copy of a document in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import decontaminate, mixing, neardup, quality, tokens
from lattiq.llm.common import Stash, new_path, scratch, table

#: The models and files of the stages have no SQL; the tests hold run() against its stages one by one,
#: and near-duplicates against all pairs.
ORACLE_SQL = None


#: Percent of shared five-word shingles from which the stage takes two documents as near-duplicates.
NEAR = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; repeated rows and ties stay or go together; a null doc_id is judged
    by its text; without usable labels all stay; an empty table stays empty; further columns are kept."""
    return quality.keep_good(docs, quality.fit_labelled(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: all rows of its smallest doc_id.

    Null and empty texts and null doc_ids are nobody's duplicates and stay; repeated rows are one document; an empty
    table stays empty; further columns are kept."""
    gone = neardup.near_duplicates(docs, level=NEAR).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id.

    Null and empty texts and null doc_ids stay; an empty table, or an empty benchmark, takes nothing away; further
    columns are kept."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents of a source without words are not taken; null sources are one source; null texts have size 0; repeated
    rows are drawn one by one; an empty table stays empty; further columns are kept."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: a row for each copy, further columns are left out.

    Null and empty texts are the end id alone; null doc_ids come first; an empty table gives no rows."""
    return tokens.read_tokens(spark, tokens.write_tokens(docs, new_path(spark, "tokens")), with_ids=False)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("tokens", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables, and the stage before it, go when it is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark, keep=["stage-", "tokens-"]):
            made = Stash(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            last.drop()
        docs, last = made.df, made
    return docs
