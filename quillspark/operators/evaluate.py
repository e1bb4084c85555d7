"""Retrieval quality: recall, reciprocal rank and zero-hit measures over judged queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row from ranked(query, path, rank) and judged(query, path): macro averages over judged queries."""
    both = judged.join(ranked, ["query", "path"], "left")
    per = both.groupBy("query").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in cuts], F.min("rank").alias("first"))
    last = max(cuts)
    return per.agg(
        *[F.avg(F.col(f"hit{k}") / F.col("n")).alias(f"recall_{k}") for k in cuts],
        F.avg(F.when(F.col("first") <= last, 1 / F.col("first")).otherwise(0.0)).alias(f"mrr_{last}"),
        F.avg((F.col(f"hit{last}") == 0).cast("double")).alias("zero_evidence_rate"),
    )
