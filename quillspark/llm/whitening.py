"""Embedding whitening from an exact integer scatter matrix.

Components become integers, a shift is subtracted, and tasks accumulate counts, sums and cross-products without
rounding: a product of blocks is taken in floats while these hold it exactly, in longs while those do, else in Python's
integers, and totals are kept in limbs of 32 bits, which Spark adds up as longs. The driver forms n * X'X - SS' in
integers (a matrix of dimensions, whatever the corpus) and only then turns it into floats and decomposes it by eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroid_clustering import finite, whole

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BITS = 32
#: Rows whose products are added in one block.
BLOCK = 4096


def products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exactly."""
    most = len(y) * int(np.abs(y).max(initial=0)) ** 2
    if most < 2**53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    if most < 2**63:
        return y.T @ y
    o = y.astype(object)
    return o.T.dot(o)


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Integers as longs to the base 2**BITS, lowest first; only the last may be negative."""
    out = []
    while True:
        if all(-(2**BITS) <= int(v) < 2**BITS for v in (values.min(), values.max())):
            return [*out, values.astype(np.int64)]
        out.append((values & (2**BITS - 1)).astype(np.int64))
        values = values >> BITS


class Total:
    """A running sum of integer arrays that never overflows."""

    def __init__(self, shape: tuple[int, ...]):
        self.parts = [np.zeros(shape, np.int64)]

    def add(self, values: np.ndarray) -> None:
        for i, limb in enumerate(limbs(values)):
            if i == len(self.parts):
                self.parts.append(np.zeros_like(limb))
            self.parts[i] += limb
        for i, part in enumerate(self.parts):  # carry on what no longer fits
            if np.abs(part).max() >= 2**61:
                if i + 1 == len(self.parts):
                    self.parts.append(np.zeros_like(part))
                self.parts[i + 1] += part >> BITS
                part &= 2**BITS - 1


def scatter(vectors: DataFrame, dims: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and cross-products of the integer vectors of vectors(v), all exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, Total((dims,)), Total((dims, dims))
        for b in batches:
            y = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dims), scale)
            for at in range(0, len(y), BLOCK):
                part = y[at : at + BLOCK]
                n += len(part)
                sums.add(part.astype(object).sum(axis=0) if int(np.abs(part).max()) >= 2**50 else part.sum(axis=0))
                cross.add(products(part))
        if not n:
            return
        i, j = np.triu_indices(dims)
        rows = [(np.array([-1]), np.array([-1]), 0, np.array([n]))]
        rows += [(np.full(dims, -1), np.arange(dims), k, p) for k, p in enumerate(sums.parts)]
        rows += [(i, j, k, p[i, j]) for k, p in enumerate(cross.parts)]
        for a, b_, k, p in rows:
            # a long holds the sum of 2**30 such values
            for half, v in ((0, p & (2**BITS - 1)), (1, p >> BITS)):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b_, pa.int32()), pa.array(np.full(len(a), k + half), pa.int32()), pa.array(v, pa.int64())], ["i", "j", "limb", "part"])

    parts = vectors.mapInArrow(run, "i int, j int, limb int, part long")
    n, sums, cross = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("part").alias("s")).toLocalIterator():  # rows by dimensions only
        value = r["s"] << (BITS * r["limb"])
        if r["j"] < 0:
            n += value
        elif r["i"] < 0:
            sums[r["j"]] += value
        else:
            cross[r["i"]][r["j"]] += value
            if r["i"] != r["j"]:
                cross[r["j"]][r["i"]] += value
    return n, sums, cross


def decomposed(n: int, sums: list[int], cross: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), eigenvectors in columns, and shares of the trace, of the components that have variance."""
    dims = len(sums)
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    cov = np.array([[v / (n * n) for v in row] for row in exact])  # quotients of integers, rounded once
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values > dims * np.finfo(float).eps * max(values[0], 0.0)).sum())
    keep = min(most, keep)
    trace = sum(exact[i][i] for i in range(dims)) / (n * n)
    return values[:keep], vectors[:, :keep], values[:keep] / trace if keep else values[:0]


def whiten(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation (decimal), whitened, explained, identity_error: a row per vector and component.

    x is floor(scale * entry) + offset; offset is also the shift that is subtracted before products are taken, which
    changes no digit of the exact result. Rows whose vector is null or holds a null, NaN or infinite entry are left out,
    and so are those of another length than most (of equally frequent lengths the longest counts), as one matrix has
    one dimension. Directions without variance cannot be whitened and give no component: a single vector, equal vectors
    and empty tables give no rows. Repeated rows and null identifiers are answered each. Other columns are not read.
    Entries that do not fit a long are an error; a deviation of more than 38 digits is null.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite(F.col("v")))
    kind = dict(slim.dtypes)["id"]
    common = slim.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    dims = common["d"] if common else 0
    empty = spark.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not dims:
        return empty
    slim = slim.where(F.size("v") == dims)
    n, sums, cross = scatter(slim.select("v"), dims, scale)
    values, basis, explained = decomposed(n, sums, cross, components)
    if not len(values):
        return empty
    project, s = basis / np.sqrt(values), np.array(sums, object)
    widest = max(map(abs, sums))

    def centred(b: pa.RecordBatch) -> np.ndarray:
        """n * x - S, exactly."""
        y = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dims), scale)
        if n * int(np.abs(y).max(initial=0)) + widest < 2**63:
            return n * y - s.astype(np.int64)
        return n * y.astype(object) - s

    def white(c: np.ndarray) -> np.ndarray:
        return (c / n).astype(float) @ project

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        sums_w, cross_w = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = white(centred(b))
            sums_w += w.sum(axis=0)
            cross_w += w.T @ w
        i, j = np.triu_indices(k)
        for a, b_, v in ((np.full(k, -1), np.arange(k), sums_w), (i, j, cross_w[i, j])):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b_, pa.int32()), pa.array(v)], ["i", "j", "part"])

    summed = slim.select("v").mapInArrow(squares, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("s"))
    found = {(r["i"], r["j"]): r["s"] / n for r in summed.collect()}  # rows by components only
    error = max(abs(v - found[-1, i] * found[-1, j] - (i == j)) for (i, j), v in found.items() if i >= 0)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = centred(b)
            if c.dtype == object or dims * int(np.abs(c).max(initial=0)) ** 2 >= 2**63:
                c = c.astype(object)
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in (c * c).sum(axis=1).tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), deviation, pa.array(list(white(c)), pa.list_(pa.float64()))], ["id", "deviation", "w"])

    rows = slim.mapInArrow(answers, f"id {kind}, deviation decimal(38,0), w array<double>")
    rows = rows.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.array(*[F.lit(float(v)) for v in explained])
    return rows.select(
        "id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """deviation as long; from some ten million vectors on a long cannot hold it: it is null there, and deviation_exact
    has it in full."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
