"""From raw documents to a mixed training corpus: five stages, each written as Parquet and read as the next one's input.

Stages run their maps over texts while they are made, within small_batches: with batches of any size, these and the
Python workers between them took an executor to its limit of memory. Stages of many joins make them within
no_late_broadcasts: the driver's memory grew with each small side that was sent there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import discard, no_late_broadcasts, small_batches, written_alone
from quillspark.llm.decontaminate import drop_leaks
from quillspark.llm.exact_dedup import drop_exact_copies
from quillspark.llm.jaccard_join import drop_near_copies
from quillspark.llm.language_id import keep_languages
from quillspark.llm.mixing import mix_rows


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an identified language go (null and empty texts among them)."""
    with small_batches(spark), no_late_broadcasts(spark):
        return keep_languages(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space runs count as one space; null counts as empty) the row with the smallest doc_id stays,
    null last; of repeated rows one. An empty table stays one."""
    with no_late_broadcasts(spark):
        return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays,
    null last; of repeated rows with words one. Null and empty texts and texts of white space are copies of nothing and
    stay. Fewer than five words make one shingle. An empty table stays one."""
    with small_batches(spark), no_late_broadcasts(spark):
        return drop_near_copies(docs, k=5, num=8, den=10)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go, repeated rows alike. Null and empty texts hold none and stay. An empty
    table, or a benchmark without texts, changes nothing."""
    with small_batches(spark), no_late_broadcasts(spark):
        return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its block, slot and place in the mixed order (slot, place); all columns of docs stay, and where docs
    has a column of such a name ours ends in _mix."""
    return mix_rows(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mixing_stage),
]

#: The language, near-copy, alignment and schedule stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables go when it is written, its input when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        docs = before = made
    return docs
