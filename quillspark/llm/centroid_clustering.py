"""Centroid clustering in integers by Yinyang grouping.

Centroids are cut into groups once, before the first round. Each vector carries the number of its centroid, an upper
bound of the distance to it and one lower bound per group for all other centroids of that group. When centroids have
moved, bounds are widened by how far: a vector whose upper bound lies below all its lower bounds is passed over (global
filter), else below some of them (group filter), and only the centroids of the groups that are left are scanned, with
exact integer distances. Bounds are rounded away from each other, so a tie is always scanned and the smaller number wins.

A round is one pass: tasks read vectors with their bounds, write them anew into the shared folder, and add a row per
centroid with count and sums, which the next query reads as the only columns it needs. Nothing is shuffled but those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Centroids in a group, on average.
GROUP = 10
STATE = "x binary, cluster int, upper double, lower binary, distance long, n long, sums array<long>"
LARGEST = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * values) as long; beyond that an error, as of any other arithmetic on longs."""
    scaled = np.floor(scale * values)
    if scaled.size and not np.abs(scaled).max() < 2.0**63:
        raise ValueError(f"a component times {scale} does not fit a long")
    return scaled.astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the integer rows of x and c; by floats where these hold every sum exactly."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    widest = x.shape[1] * (2 * max(int(np.abs(x).max()), int(np.abs(c).max()))) ** 2
    if widest < 2**53:
        xf, cf = x.astype(float), c.astype(float)
        return ((xf * xf).sum(axis=1)[:, None] + (cf * cf).sum(axis=1) - 2 * (xf @ cf.T)).astype(np.int64)
    if widest >= 2**63:
        raise ValueError("squared distances do not fit a long")
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _up(v: np.ndarray) -> np.ndarray:
    return v * (1 + 1e-12) + 1e-9


def _down(v: np.ndarray) -> np.ndarray:
    return v * (1 - 1e-12) - 1e-9


def grouped(centroids: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """The numbers of the centroids of each group, ascending: a few rounds of clustering of the centroids themselves."""
    k = max(1, len(centroids) // size)
    middles = centroids[:: max(1, len(centroids) // k)][:k].astype(float)
    for _ in range(5):
        nearest = ((centroids[:, None, :] - middles) ** 2).sum(axis=2).argmin(axis=1)
        middles = np.stack([centroids[nearest == g].mean(axis=0) if (nearest == g).any() else middles[g] for g in range(k)])
    return [np.flatnonzero(nearest == g) for g in range(k) if (nearest == g).any()]


class Step:
    """What a round needs to know: centroids, their groups, and how far each moved since bounds were set."""

    def __init__(self, centroids: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None):
        self.centroids, self.groups = centroids, groups
        self.moved = moved
        self.group_moved = None if moved is None else np.array([moved[g].max() for g in groups])
        self.group_of = np.empty(len(centroids), int)
        for i, g in enumerate(groups):
            self.group_of[g] = i

    def _lower(self, d: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        """Per group, the distance to its nearest centroid but the vector's own; endless where there is no other."""
        d = d.astype(float)
        d[np.arange(len(d)), nearest] = np.inf
        return np.stack([_down(np.sqrt(d[:, g].min(axis=1))) for g in self.groups], axis=1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = distances(x, self.centroids)
        nearest = d.argmin(axis=1)
        return nearest, _up(np.sqrt(d[np.arange(len(x)), nearest].astype(float))), self._lower(d, nearest)

    def next(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Number, upper and lower bounds of each vector, and how many centroids were scanned."""
        own, upper, lower = own.copy(), _up(upper + self.moved[own]), _down(lower - self.group_moved)
        at = np.flatnonzero(upper >= lower.min(axis=1))  # global filter
        if not len(at):
            return own, upper, lower, 0
        near = np.zeros(len(at), np.int64)
        for c in np.unique(own[at]):
            mine = own[at] == c
            near[mine] = distances(x[at[mine]], self.centroids[c : c + 1])[:, 0]
        upper[at] = _up(np.sqrt(near.astype(float)))
        left = upper[at] >= lower[at].min(axis=1)
        at, near = at[left], near[left]
        hit = lower[at] <= upper[at][:, None]  # group filter
        d = np.full((len(at), len(self.centroids)), LARGEST)
        d[np.arange(len(at)), own[at]] = near
        scanned = 0
        for i, g in enumerate(self.groups):
            rows = np.flatnonzero(hit[:, i])
            d[np.ix_(rows, g)] = distances(x[at[rows]], self.centroids[g])
            scanned += len(rows) * len(g)
        nearest = d.argmin(axis=1)
        fresh = lower[at]
        # the centroid that is left behind counts among the others of its group, which may not have been scanned
        changed = np.flatnonzero(nearest != own[at])
        old_group = self.group_of[own[at[changed]]]
        fresh[changed, old_group] = np.minimum(fresh[changed, old_group], _down(np.sqrt(near[changed].astype(float))))
        if len(at):
            d_lower = self._lower(np.where(d == LARGEST, np.inf, d.astype(float)), nearest)
            fresh[hit] = d_lower[hit]
        own[at], lower[at] = nearest, fresh
        upper[at] = _up(np.sqrt(d[np.arange(len(at)), nearest].astype(float)))
        return own, upper, lower, scanned


def _runner(step: Step, dims: int, scale: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round over Arrow batches of (id, v) or (id, *STATE)."""
    k = len(step.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, id_type = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), None
        for b in batches:
            rows = len(b)
            if not rows:
                continue
            id_type = b.column("id").type
            if step.moved is None:
                x = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows, dims), scale)
                if 2 * int(np.abs(x).max()) >= 2**31:
                    raise ValueError("components are too large for distances in a long")
                packed = x.astype("<i4")
                own, upper, lower = step.first(x)
            else:
                packed = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(rows, dims)
                x = packed.astype(np.int64)
                bounds = np.frombuffer(b"".join(b.column("lower").to_pylist()), "<f8").reshape(rows, -1)
                own, upper, lower, _ = step.next(x, b.column("cluster").to_numpy().astype(int), b.column("upper").to_numpy(), bounds)
            none = pa.nulls(rows)
            if last:
                exact = ((x - step.centroids[own]) ** 2).sum(axis=1)
                cells = [none.cast(pa.binary()), pa.array(own, pa.int32()), none.cast(pa.float64()), none.cast(pa.binary()), pa.array(exact, pa.int64())]
            else:
                np.add.at(counts, own, 1)
                np.add.at(sums, own, x)
                lower = np.ascontiguousarray(lower, "<f8")
                cells = [pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(own, pa.int32()), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), none.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cells, none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], ["id", *NAMES])
        if not last and id_type is not None:
            full = np.flatnonzero(counts)
            none = pa.nulls(len(full))
            cells = [none.cast(id_type), none.cast(pa.binary()), pa.array(full, pa.int32()), none.cast(pa.float64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, ["id", *NAMES])

    return run


NAMES = [c.split()[0] for c in STATE.split(", ")]


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor of the exact mean of their vectors; those without any stay."""
    part = state.where("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
    total = part.groupBy("cluster", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    fresh = centroids.copy()
    for r in total.collect():  # a row per centroid and component
        fresh[r["cluster"], r["pos"]] = int(r["s"]) // int(r["n"])
    return fresh


def centroid_clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors with exactly dims components.

    Rows whose vector is null, of another length, or holds a null, NaN or infinite component are left out; every other
    row is answered, repeated rows and null identifiers too. Starting centroids are the k vectors with the smallest
    SHA-256 of `seed:id` (null identifiers last; equal hashes by components), so fewer than k vectors give fewer
    centroids, and equal vectors may start equal centroids, of which the smaller number takes all. An empty table gives
    an empty result. Other columns are not read. Components whose distances, or sums of these, do not fit a long are an error.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    slim = vectors.select(F.col(id_col).alias("id"), vec.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dims) & finite(F.col("v")))
    kind = dict(slim.dtypes)["id"]
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    starts = slim.orderBy(order, "v").limit(k).select("v").collect()
    if not starts:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = whole(np.array([r["v"] for r in starts], float), scale)
    groups = grouped(centroids)
    state, moved = slim, None
    for at in range(rounds + 1):
        run = _runner(Step(centroids, groups, moved), dims, scale, at == rounds)
        fresh = written(state.mapInArrow(run, f"id {kind}, {STATE}"), "yinyang")
        if moved is not None:
            discard(state)
        if at < rounds:
            new = _moved(fresh, centroids)
            moved = _up(np.sqrt(np.array([((a.astype(object) - b.astype(object)) ** 2).sum() for a, b in zip(new, centroids, strict=True)], float)))
            centroids = new
            state = fresh.where("n IS NULL")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["d"]) for r in fresh.groupBy("cluster").agg(exact.alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, d, sum(inertia.values()), digest(c)) for c, d in inertia.items()]  # at most k
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return fresh.select("id", "cluster", "distance").join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def _sql() -> str:
    """Lloyd's rounds as a chain of tables; every number is a whole one below 2**53."""
    nearest = "SELECT vec_id, x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS HUGEINT) * 64 + j) AS m, rid FROM v, c{i} GROUP BY vec_id, x, rid"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS j, x AS c FROM v QUALIFY j < 40)",
    ]
    for i in range(5):
        parts += [
            f"a{i} AS MATERIALIZED ({nearest.format(i=i)})",
            f"s{i} AS (SELECT CAST(m % 64 AS BIGINT) AS j, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{i})",
            f"f{i} AS (SELECT j, list(f ORDER BY pos) AS c FROM (SELECT j, pos, floor(sum(e) / count(*)) AS f FROM s{i} GROUP BY j, pos) GROUP BY j)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.j, coalesce(f.c, o.c) AS c FROM c{i} o LEFT JOIN f{i} f USING (j))",
        ]
    parts.append(f"a5 AS MATERIALIZED ({nearest.format(i=5)})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, CAST(m // 64 AS BIGINT) AS distance,"
        " CAST(sum(m // 64) OVER (PARTITION BY m % 64) AS BIGINT) AS cluster_inertia, CAST(sum(m // 64) OVER () AS BIGINT) AS inertia,"
        " sha256(array_to_string(list_transform(c, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.j = m % 64"
    )


SQL = _sql()
