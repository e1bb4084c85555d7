"""Change detection between snapshots, and what applying it amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, change (added, deleted, modified, unchanged) for (path, file_size, modified_at) tables; a changed time alone
    is a modification. Repeated paths in one snapshot count once, by their latest row."""
    latest = lambda df, s: df.groupBy("path").agg(F.max(F.struct("modified_at", "file_size")).alias(s))
    both = latest(current, "now").join(latest(previous, "then"), "path", "full_outer")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def summarize(changes: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counters over the changed files; links must carry `exists`."""
    counts = changes.agg(*[F.count_if(F.col("change") == c).alias(f"files_{c}") for c in ("added", "modified", "deleted", "unchanged")])
    touched = changes.where(F.col("change").isin("added", "modified")).select("path")
    docs = documents.join(touched, "path", "left_semi").agg(F.count_if(F.col("parse_status") == "failed").alias("parse_failures"), F.count_if(F.col("parse_status") == "partial").alias("parse_partial"))
    edge = links.join(touched.withColumnRenamed("path", "src"), "src", "left_semi").agg(F.count(F.lit(1)).alias("total_links"), F.count_if(~F.col("exists")).alias("broken_links"))
    return counts.crossJoin(docs).crossJoin(edge)  # one row each
