"""Secret scan with corpus-wide ownership frequency (DataFrame operations only).

Every row's whole text gives candidate spans. Hashes of their values are aggregated over the corpus by distinct
repositories (documents) and distinct owners (sources): a value that many owners hold is a widely copied example,
one that a single owner holds looks live. Base spans always stay; bare tokens without a telling keyword are only
added where their value is owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_spread, written

#: kind -> (order, raw pattern, length that the value must have); fixed by the contract, but for "bare".
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (0, ASSIGN, 8), "access": (1, r"AKIA[A-Z0-9]{12,}", 16), "hex": (2, r"[0-9a-f]{32,}", 32), "bare": (3, r"[A-Za-z0-9+/_-]{24,}", 24)}
BASE = ("assign", "access", "hex")
#: A bare token needs letters of both cases and digits.
MIXED = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"
#: From so many distinct owners on, a value is a widely copied example.
SHARED_OWNERS = 3
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your_|xxxxxx|00000000"


def _raw(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as structs: place in the row, length of the gap before, the match.

    `{12,}` and `{32,}` find what the open patterns find after short matches are dropped, as no later match can
    begin within a short one; the keyword pattern keeps its open form, and short values are dropped afterwards.
    """
    order, pattern, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    pairs = F.transform(found, lambda m, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.get(gaps, i).alias("gap"), m.alias("match")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,match:string>>")
    return F.when(text.rlike(pattern), pairs).otherwise(none)


def candidates(rows: DataFrame) -> DataFrame:
    """Exploded spans of rows(rid, repo, owner, hits): rid, repo, owner, kind, start, end (code points), value."""
    one = rows.select("rid", "repo", "owner", F.explode("hits").alias("h")).select("rid", "repo", "owner", "h.*")
    sofar = "sum(gap + length(match)) OVER (PARTITION BY rid, kind ORDER BY i ROWS UNBOUNDED PRECEDING)"
    placed = one.withColumn("end", F.expr(sofar)).withColumn("start", F.col("end") - F.length("match"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    least = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS.values()]), F.col("kind") + 1)
    placed = placed.withColumn("value", value).where(F.length("value") >= least)
    return placed.where((F.col("kind") < 3) | F.col("value").rlike(MIXED)).drop("i", "gap", "match")


def ownership(spans: DataFrame) -> DataFrame:
    """key -> n_repos, n_owners over the whole corpus. The first step is keyed by (key, repo), so one value that
    sits in a third of all documents is dealt over all tasks, and each later step is combined before its shuffle."""
    by_repo = spans.groupBy("key", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("n_repos"))
    return by_owner.groupBy("key").agg(F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per row of docs: id, spans array<struct<start,kind,end,value,n_repos,n_owners,live>> in order.

    Null text is empty and has no span. A null owner counts as one owner of its own. Repeated rows give repeated
    results; their repository counts once. An empty table gives an empty result; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.concat(*[_raw(text, k) for k in KINDS])
    rows = docs.select(F.col(id_col).alias("repo"), F.col(owner_col).cast("string").alias("owner"), hits.alias("hits"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    spans = candidates(rows).withColumn("key", F.sha2("value", 256))
    known = lookup_spread(spans, ownership(spans), ["key"], ["rid", "start"], how="left")
    live = (F.col("n_owners") < SHARED_OWNERS) & ~F.col("value").rlike(PLACEHOLDER)
    known = known.withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    # a bare token that touches a base span is that span's own value; the nearest ends and starts tell, in one pass each
    base = F.col("kind") < 3
    before, after = (Window.partitionBy("rid").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("start"), -F.col("start")))
    known = known.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    touches = (F.coalesce("reach", F.lit(0)) > F.col("start")) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    known = known.where(base | ~touches)
    lists = known.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "n_repos", "n_owners", "live"))).alias("spans"))
    return rows.select("rid", F.col("repo").alias("id")).join(lists, "rid", "left").drop("rid")


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string,n_repos:bigint,n_owners:bigint,live:boolean>>"))
    found = found.select(F.col("id").alias("doc_id"), spans.alias("all"), F.filter(spans, lambda s: s["kind"] < 3).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(KINDS[k][0]).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_shared"),
    )
