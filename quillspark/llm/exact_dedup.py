"""Exact deduplication by a tree merge of sorted digest runs (DataFrame operations only).

Rows are dealt to as many runs as the cluster shuffles partitions; a run is sorted by digest and reduced to one row per
digest. In round k, FAN_IN neighbouring runs become one (run r meets those of equal r div FAN_IN**k), and a run is cut
into FAN_IN**k slices by the leading bits of its digests, so a partition receives the same slice of all partners, merges
them in digest order and gives on one sorted slice. Partitions keep their number and, but for copies that meet, their
size; after ceil(log(runs) / log(FAN_IN)) rounds one run is left, sorted by slices. Every merge keeps, per digest, the
smallest identifier and the size so far. Only equal SHA-256 digests of equal length and an equal independent 64-bit hash
are merged, so an identifier is verified at every level. A text that holds a third of all rows is dealt over all runs,
and enters each merge as at most FAN_IN rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_ones, lookup_spread, row_key, written

SPACE = r"[\x20\x09-\x0D]+"
FAN_IN = 16
KEY = ["digest", "n", "proof"]


def runs_for(df: DataFrame) -> int:
    """Runs grow with the cluster's shuffle width, so a run has a partition's size."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def merged(level: DataFrame, runs: int, slices: int, place: Column) -> DataFrame:
    """(run, *KEY, first, size) of the runs that meet: one exchange, a merge in digest order, one row per digest.

    The smallest identifier is kept in a struct, which Spark aggregates over sorted input, not in a hash table; run and
    slice alone deal the rows, so the aggregation needs no exchange of its own.
    """
    slice_ = F.floor(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") * slices / F.lit(1 << 24)).cast("int")
    dealt = level.withColumn("run", place.cast("int")).withColumn("slice", slice_).repartition(runs * slices, "run", "slice")
    ordered = dealt.sortWithinPartitions("run", "slice", *KEY)
    return ordered.groupBy("run", "slice", *KEY).agg(F.min("first").alias("first"), F.sum("size").alias("size")).drop("slice")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest (binary SHA-256 of the normalised text), keep_id, group_size.

    Null text counts as empty; empty texts are equal to each other. White space runs count as one space, at the
    ends too. Rows that repeat an identifier and its text count each in group_size and share one keep_id. Null
    identifiers never stay unless a group has no other. An empty table gives an empty result. Other columns are
    not read, so clashing names do no harm.
    """
    runs = runs_for(docs)
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    slim = docs.select(F.col(id_col).alias("id"), norm.alias("t")).select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.length("t").alias("n"), F.xxhash64("t").alias("proof"))
    # rows that repeat an identifier are dealt over the runs too; the table fixes where
    slim = written(slim.withColumn("run", F.pmod(F.monotonically_increasing_id(), F.lit(runs)).cast("int")), "digests")
    named = F.struct(F.col("id").isNull().alias("none"), "id")  # null after all others
    level = merged(slim.select("run", *KEY, named.alias("first"), F.lit(1).cast("long").alias("size")), runs, 1, F.col("run"))
    slices = 1
    while runs > 1:
        runs, slices = -(-runs // FAN_IN), slices * FAN_IN
        level = merged(level, runs, min(slices, runs_for(docs)) if runs == 1 else slices, F.floor(F.col("run") / F.lit(FAN_IN)))
    found = level.select(*KEY, F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"))
    return lookup_spread(slim.drop("run"), found, KEY, ["id"], fan=64, how="inner")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, one with the smallest doc_id (null last); all columns stay."""
    key = row_key(docs, "text")
    found = exact_groups(docs.select(key.alias("doc_id"), "text"))
    found = found.select(F.col("id").alias("key"), (F.col("id") == F.col("keep_id")).alias("kept"), F.lit(True).alias("copies"))
    return keep_ones(docs, key, found, "copies")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
