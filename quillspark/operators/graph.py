"""The link graph: filters, bounded traversal, broken links, conflicts, cycles, reachability."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..schema import Catalog
from ..sources.ingest import with_existence

UNTYPED = ("links_to", "linked_from")
MOST_DEPTH, MOST_NODES = 5, 100


def relation_test(relations: list[str] | None) -> Column:
    """Untyped links count where one of UNTYPED is asked for; no relations means all."""
    if not relations:
        return F.lit(True)
    test = F.coalesce(F.col("relation").isin(*relations), F.lit(False))
    return test | F.col("relation").isNull() if set(relations) & set(UNTYPED) else test


def links_by_relation(links: DataFrame, relations: list[str] | None) -> DataFrame:
    return links.where(relation_test(relations))


def self_free(links: DataFrame) -> DataFrame:
    return links.where(~F.col("dst").eqNullSafe(F.col("src")))


def broken_links(catalog: Catalog) -> DataFrame:
    inner = catalog.links.where(F.col("external_url").isNull())
    return inner.join(catalog.documents.select(F.col("path").alias("dst")), "dst", "left_anti")


def typed_conflicts(links: DataFrame) -> DataFrame:
    """Pairs that are linked both with and without a relation."""
    inner = links.where(F.col("dst").isNotNull())
    counts = inner.groupBy("src", "dst").agg(F.count_if(F.col("relation").isNull()).alias("untyped"), F.count_if(F.col("relation").isNotNull()).alias("typed"))
    return counts.where("untyped > 0 AND typed > 0")


def traverse(catalog: Catalog, starts: DataFrame, depth: int = 3, max_nodes: int = 50, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each start(path), both ways, level by level, for all starts in the same jobs.

    nodes: start, path, title, type, depth; a start keeps its max_nodes nearest, by depth and then path, and a level never
    holds more than what is left of that. edges: start, source (the document that links), target, label (links_to where
    the source comes first by depth and path, else linked_from), link_relation: all links between kept nodes but those
    between two of the last level. Depth and nodes are clamped, so the loop has at most MOST_DEPTH joins.
    """
    depth, max_nodes = min(depth, MOST_DEPTH), min(max_nodes, MOST_NODES)
    inner = catalog.links.where(F.col("dst").isNotNull() & relation_test(relations) & (F.col("src") != F.col("dst"))).select("src", "dst", "relation").distinct()
    step = inner.select(F.col("src").alias("path"), F.col("dst").alias("next")).unionByName(inner.select(F.col("dst").alias("path"), F.col("src").alias("next")))
    frontier = starts.select(F.col("path").alias("start"), "path", F.lit(0).alias("depth")).distinct()
    nodes = frontier
    for level in range(1, depth + 1):
        room = nodes.groupBy("start").agg((F.lit(max_nodes) - F.count(F.lit(1))).alias("room"))
        out = frontier.join(step, "path").select("start", F.col("next").alias("path")).distinct().join(nodes, ["start", "path"], "left_anti")
        nearest = Window.partitionBy("start").orderBy("path")
        out = out.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= max_nodes).join(room, "start").where(F.col("r") <= F.col("room"))
        frontier = _cut(out.select("start", "path", F.lit(level).alias("depth")))
        nodes = nodes.unionByName(frontier)
    kept = nodes.join(catalog.documents.select("path", "title", "type"), "path", "left").select("start", "path", "title", "type", "depth")
    end = lambda name: nodes.select("start", F.col("path").alias(name), F.struct("depth", "path").alias(f"at_{name}"))
    edges = end("src").join(inner, "src").join(end("dst"), ["start", "dst"]).where(F.least("at_src.depth", "at_dst.depth") < depth)
    label = F.when(F.col("at_src") < F.col("at_dst"), "links_to").otherwise("linked_from")
    return kept, edges.select("start", F.col("src").alias("source"), F.col("dst").alias("target"), label.alias("label"), F.col("relation").alias("link_relation"))


def reachable(links: DataFrame, start: str) -> DataFrame:
    """path of everything that links lead to from start (start itself only by a cycle), a round for each link of the way."""
    step = links.where(F.col("dst").isNotNull()).select(F.col("src").alias("path"), F.col("dst").alias("next")).distinct().cache()
    seen = frontier = step.where(F.col("path") == start).select(F.col("next").alias("path")).distinct()
    for round_ in itertools.count(1):
        frontier = _cut(frontier.join(step, "path").select(F.col("next").alias("path")).distinct().join(seen, "path", "left_anti"))
        if not frontier.head(1):
            return seen
        seen = seen.unionByName(frontier)
        if round_ % 16 == 0:
            seen = _cut(seen)


def would_create_cycle(links: DataFrame, source: str, target: str) -> bool:
    return source == target or bool(reachable(links, target).where(F.col("path") == source).head(1))


def _propagated(live: DataFrame) -> DataFrame:
    """path, low, high of the ends of live(src, dst): the smallest path that leads to it, and the smallest that it leads to
    (itself only by a cycle).

    Each round passes labels over every link once, both ways, combined before the shuffle; nothing grows with paths.
    """
    labels = live.select(F.col("src").alias("path")).union(live.select("dst")).distinct().select("path", F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))
    while True:
        ahead = live.join(labels.select(F.col("path").alias("src"), "low"), "src").select(F.col("dst").alias("path"), F.least("src", "low").alias("low"), F.lit(None).cast("string").alias("high"))
        behind = live.join(labels.select(F.col("path").alias("dst"), "high"), "dst").select(F.col("src").alias("path"), F.lit(None).cast("string").alias("low"), F.least("dst", "high").alias("high"))
        own = labels.select("path", "low", "high", F.struct("low", "high").alias("old"))
        passed = ahead.unionByName(behind).withColumn("old", F.lit(None).cast("struct<low:string,high:string>"))
        fresh = _cut(own.unionByName(passed).groupBy("path").agg(F.min("low").alias("low"), F.min("high").alias("high"), F.max("old").alias("old")))
        labels = fresh.select("path", "low", "high")
        if not fresh.where(~F.col("low").eqNullSafe(F.col("old.low")) | ~F.col("high").eqNullSafe(F.col("old.high"))).head(1):
            return labels


def cycle_members(catalog: Catalog) -> DataFrame:
    """path, cycle_id of documents on a cycle of existing links; a cycle is named by its smallest member.

    Documents without a way in or out are peeled off in rounds. Of what is left, smallest labels are passed forwards and
    backwards: a document whose smallest predecessor is its smallest successor is on a cycle with it. Links whose ends
    differ in a label are on no cycle; those and the settled documents go, and the rest is taken anew. The smallest
    document left is settled or loses its links each time, and a round costs the number of links left.
    """
    docs = catalog.documents.select("path")
    live = catalog.links.where(F.col("external_url").isNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    live = live.join(docs.withColumnRenamed("path", "dst"), "dst", "left_semi").join(docs.withColumnRenamed("path", "src"), "src", "left_semi")
    live = _cut(live)
    found = live.where(F.col("src") == F.col("dst")).select(F.col("src").alias("path"), F.col("src").alias("cycle_id"))
    live = live.where(F.col("src") != F.col("dst"))
    while True:
        size = live.count()
        while True:
            live = _cut(live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
            before, size = size, live.count()
            if size in (before, 0):
                break
        if not size:
            return found.groupBy("path").agg(F.min("cycle_id").alias("cycle_id"))
        labels = _propagated(live)
        settled = labels.where(F.col("low") == F.col("high"))
        found = found.unionByName(settled.select("path", F.col("low").alias("cycle_id")))
        rest = labels.where(F.col("low") != F.col("high"))
        end = lambda name, rest=rest: rest.select(F.col("path").alias(name), "low", "high")
        live = _cut(live.join(end("src"), "src").join(end("dst"), ["dst", "low", "high"]).select("src", "dst"))


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop: df as a table in the shared folder that spark.checkpoint.dir names (where none is
    named, on a single machine, in a temporary one). Written once, where a checkpoint computes a plan twice."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quill-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forward(catalog: Catalog, path: str, relation: str | None = None) -> DataFrame:
    found = catalog.links.where(F.col("src") == path)
    found = found.where(F.col("relation") == relation) if relation else found
    return with_existence(found, catalog.documents).orderBy("pos")


def backward(catalog: Catalog, path: str, relation: str | None = None, limit: int = 50) -> DataFrame:
    """Links to path, with their source; ordered."""
    found = catalog.links.where(F.col("dst") == path)
    found = found.where(F.col("relation") == relation) if relation else found
    return found.select(F.col("src").alias("source_path"), "dst", "anchor", "relation").orderBy("source_path", "anchor", "relation").limit(limit)
