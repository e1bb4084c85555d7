"""Field-weighted BM25 search over token positions, with filters, a typo fallback, excerpts and outlines.

A stored index is a log of segments. A segment is a table of entries (term, path, field, positions) in folders by a hash
of the term and sorted by it, so a query reads the row groups of its terms only, with the documents that it replaces or
deletes, and by how much it changes the counts of terms and the totals. Unstemmed terms are gathered within a document and
sorted within a task, so writing them shuffles nothing. Changes add a segment; segments of one size are merged.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.porter import stem
from ..functions.text import display_title, excerpt
from ..schema import Catalog
from .document import outline
from .ftsquery import Phrase, parse_query
from .tokens import FIELDS, entries_of, entry_rows, lengths_of, stem_rows, token_rows

WEIGHTS = {"title": 10.0, "description": 5.0, "headings": 2.0, "body": 1.0, "type": 0.0}
MOST_TOKENS, MOST_VOCABULARY, SHORTEST = 8, 50_000, 5
TERM_FOLDERS = 64
#: Parts by path into which tasks cut a folder of terms, and segments of one size that are merged.
PATH_CUTS, MERGE_FAN = 16, 8
#: By what factor counts and lengths of postings of one step may differ.
LEVEL = 1.4


@dataclass
class Index:
    tokens: DataFrame
    totals: DataFrame  # one row: n, avgdl
    lengths: DataFrame  # path, dl
    stem: bool = True
    terms: DataFrame | None = None  # term, df, cnt, where the index is stored
    postings: DataFrame | None = None  # term, part, impact, path, dl, and the term's count in each field, where it is stored
    bounds: DataFrame | None = None  # term, impact, n, and what no posting of that impact exceeds
    entries: DataFrame | None = None  # path, dl, term, counts, field, at, lead: where it is stored or its terms are not stemmed

    def repeats(self) -> bool:
        """Whether documents share a path, so that entries of a term have to be brought together."""
        return not self.lengths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def searchable(catalog: Catalog) -> DataFrame:
    heads = catalog.headings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("h"))
    docs = catalog.documents.join(heads.select("path", F.array_join(F.transform("h", lambda h: h["title"]), " ").alias("headings")), "path", "left")
    return docs.select("path", "title", "description", "headings", F.coalesce("plain_text", "body").alias("body"), "type")


def build_index(docs: DataFrame, use_stem: bool = True, ascii_only: bool = False) -> Index:
    """docs(path, title, description, headings, body, type). Re-indexing a path replaces it, as the index follows docs."""
    tokens, lengths = token_rows(docs, ascii_only), lengths_of(docs, ascii_only)
    tokens = stem_rows(tokens) if use_stem else tokens
    entries = None if use_stem else entry_rows(docs, ascii_only)
    return Index(tokens, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), lengths, use_stem, entries=entries)


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_FOLDERS)).cast("int")


COUNTS = ", ".join(f"in_{f} int" for f in FIELDS)
SEGMENT = {
    "entries": f"path string, dl long, field string, at array<int>, term string, part int, impact int, lead boolean, {COUNTS}",
    "docs": "path string, dl long, gone boolean", "terms": "term string, df long, cnt long", "totals": "n long, dl long",
    "bounds": f"term string, impact int, n long, dl long, {COUNTS}",
}


def write_index(index: Index, folder: str) -> Index:
    """The index as stored under folder, as one segment."""
    spark = index.tokens.sparkSession
    _write_entries(index, folder)
    index.lengths.select("path", F.col("dl").cast("long").alias("dl"), F.lit(False).alias("gone")).write.mode("overwrite").parquet(f"{folder}/docs")
    _write_counts(spark, folder, None)
    return read_index(spark, folder, index.stem)


def _write_entries(index: Index, folder: str, cut: bool = True) -> None:
    """Entries sorted by term, cut into folders by term unless they are few.

    Entries that are made row by row stay in their tasks, each of which sorts its own: a folder has a file of each task.
    Else they are dealt to folders by a hash of the path too, so a hot term is spread like any other, and no range has to
    be sampled.
    """
    own = index.entries is not None and not index.repeats()
    rows = index.entries if own else entries_of(index.tokens)
    rows = rows.withColumn("part", _part(F.col("term"))).withColumn("impact", _impact())
    rows = rows.select(*[c.split()[0] for c in SEGMENT["entries"].split(", ")])
    if not own:
        rows = rows.withColumn("cut", F.pmod(F.xxhash64("path"), F.lit(PATH_CUTS))).hint("rebalance", "part", "cut").drop("cut")
    writer = rows.sortWithinPartitions("part", "term", "impact", "path", "field").write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("part") if cut else writer).parquet(f"{folder}/entries")
    most = [F.max(f"in_{f}").alias(f"in_{f}") for f in FIELDS]
    written = _segment(index.tokens.sparkSession, folder, "entries")["entries"]
    held = written.where("lead").groupBy("term", "impact").agg(F.count(F.lit(1)).alias("n"), F.min("dl").alias("dl"), *most)
    held.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/bounds")


def _tokens(entries: DataFrame) -> DataFrame:
    return entries.select("path", "dl", "field", F.explode("at").alias("pos"), "term", "part")


def _impact() -> Column:
    """The step of a posting: its weighted count and its document's length, each within a factor of LEVEL, so that the
    largest count and the least length of a step bound its postings closely."""
    f = sum((F.col(f"in_{name}") * F.lit(w) for name, w in WEIGHTS.items()), F.lit(0.0))
    level = lambda x: F.floor(F.log(LEVEL, x)).cast("int")
    return level(f + 1) * F.lit(1000) + level(F.col("dl") + 1)


def _write_counts(spark: SparkSession, folder: str, before: Index | None) -> None:
    """By how much a segment changes the counts of terms and the totals: what its documents hold, less what they held."""
    now = _segment(spark, folder, "entries", "docs")
    new = Index(_tokens(now["entries"]), now["docs"], now["docs"].where("NOT gone"), entries=now["entries"])
    counts = lambda index, sign: term_counts(index).select("term", *[(F.col(c) * sign).alias(c) for c in ("df", "cnt")])
    totals = lambda index, sign: index.lengths.agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).cast("long").alias("dl"))
    terms, whole = counts(new, 1), totals(new, 1)
    if before is not None:
        terms = terms.unionByName(counts(before, -1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt")).where("df <> 0 OR cnt <> 0")
        whole = whole.unionByName(totals(before, -1)).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
    whole.write.mode("overwrite").parquet(f"{folder}/totals")  # last: the segment is whole


def _segment(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(SEGMENT[name]).parquet(f"{folder}/{name}") for name in names or SEGMENT}


def read_index(spark: SparkSession, folders: str | list[str], use_stem: bool) -> Index:
    """The index of segments, oldest first: a document's rows are those of the last segment that names it.

    What later segments name is little beside what they leave standing, so it is joined away from each older one; terms
    and totals are sums of the segments' changes.
    """
    folders = [folders] if isinstance(folders, str) else folders
    parts = [_segment(spark, f) for f in folders]
    entries = lengths = later = None
    for part in reversed(parts):
        own_entries, own = part["entries"], part["docs"]
        if later is not None:
            own_entries, own = (x.join(later, "path", "left_anti") for x in (own_entries, own))
        live = own.where("NOT gone").select("path", "dl")
        entries = own_entries if entries is None else entries.unionByName(own_entries)
        lengths = live if lengths is None else lengths.unionByName(live)
        names = part["docs"].select("path")
        later = names if later is None else later.unionByName(names)
    terms, totals, bounds = (reduce(DataFrame.unionByName, [p[name] for p in parts]) for name in ("terms", "totals", "bounds"))
    if len(parts) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt")).where("df > 0")
        totals = totals.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    postings = entries.where("lead").select("term", "part", "impact", "path", "dl", *[f"in_{f}" for f in FIELDS])
    return Index(_tokens(entries), totals.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).alias("avgdl")), lengths, use_stem, terms, postings, bounds, entries)


def add_segment(spark: SparkSession, folder: str, fresh: DataFrame, gone: DataFrame, before: DataFrame, use_stem: bool) -> None:
    """Writes a segment for the documents of fresh(path, title, ...) and the deletions of gone(path). before has the same
    documents as they were (those that were), so that counts follow without reading the index. Only these are tokenised."""
    index = build_index(fresh, use_stem)
    _write_entries(index, folder, cut=False)
    own = _segment(spark, folder, "entries")["entries"].groupBy("path").agg(F.sum(F.size("at")).alias("dl"))
    docs = fresh.select("path").distinct().join(own, "path", "left").select("path", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"), F.lit(False).alias("gone"))
    left = gone.select("path").distinct().join(fresh.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("dl"), F.lit(True).alias("gone"))
    docs.unionByName(left).write.mode("overwrite").parquet(f"{folder}/docs")
    _write_counts(spark, folder, build_index(before, use_stem))


def merge_segments(spark: SparkSession, folders: list[str], target: str, oldest: bool) -> None:
    """Writes neighbouring segments as one. Deletions are kept unless the oldest segment is among them."""
    index, parts = read_index(spark, folders, True), [_segment(spark, f) for f in folders]
    _write_entries(index, target)
    every = reduce(DataFrame.unionByName, [p["docs"].withColumn("at", F.lit(i)) for i, p in enumerate(parts)])
    last = every.groupBy("path").agg(F.max_by(F.struct("dl", "gone"), "at").alias("x")).select("path", "x.dl", "x.gone")
    (last.where("NOT gone") if oldest else last).write.mode("overwrite").parquet(f"{target}/docs")
    terms = reduce(DataFrame.unionByName, [p["terms"] for p in parts]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))
    terms.where("df <> 0 OR cnt <> 0").write.mode("overwrite").parquet(f"{target}/terms")
    totals = reduce(DataFrame.unionByName, [p["totals"] for p in parts]).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{target}/totals")


def tail_to_merge(sizes: list[int], fan: int = MERGE_FAN) -> int:
    """How many of the last segments are to become one: those of the last one's tier or below, once they are fan."""
    tier = lambda n: int(math.log(max(1, n), fan))
    top, k = tier(sizes[-1]) if sizes else 0, 0
    while k < len(sizes) and tier(sizes[-1 - k]) <= top:
        k += 1
    return k if k >= fan else 0


def postings(index: Index) -> DataFrame:
    """term, path, field, tf: entries as they stand, and where documents share a path their sums."""
    if index.entries is None or index.repeats():
        return index.tokens.groupBy("term", "path", "field").agg(F.count(F.lit(1)).alias("tf"))
    return index.entries.select("term", "path", "field", F.size("at").cast("long").alias("tf"))


def term_counts(index: Index) -> DataFrame:
    """term, df, cnt"""
    if index.entries is not None and not index.repeats():
        return index.entries.groupBy("term").agg(F.count_if("lead").alias("df"), F.sum(F.size("at")).alias("cnt"))
    one = index.tokens.groupBy("term", "path").agg(F.count(F.lit(1)).alias("tf"))
    return one.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cnt"))


def vocabulary(index: Index, limit: int = MOST_VOCABULARY) -> DataFrame:
    """term, df, cnt: the most widespread terms first."""
    return (term_counts(index) if index.terms is None else index.terms).orderBy(F.desc("df"), "term").limit(limit)


def _starts(prefix: str) -> Column:
    """A range of terms, which the statistics of a sorted table can rule out."""
    end = prefix[:-1] + chr(ord(prefix[-1]) + 1) if ord(prefix[-1]) < 0xD7FF else None
    inside = (F.col("term") >= prefix) & (F.col("term") < end) if end else F.col("term") >= prefix
    return inside & F.col("term").startswith(prefix)


def _occurrences(index: Index, p: Phrase, counted: bool = False) -> DataFrame:
    """path, field, start of each place where the phrase stands; counted: path, field, n of a single term, from stored entries."""
    rows = (index.entries if counted else index.tokens).where(F.col("field").isin(*p.fields) if p.fields else F.lit(False))
    if not p.terms:
        return rows.where("false").select("path", "dl", "field", F.col("pos").alias("start"))
    last = len(p.terms) - 1
    tests = [(_starts(p.terms[i]) if p.prefix and i == last else F.col("term") == t) for i, t in enumerate(p.terms)]
    if "part" in rows.columns:  # folders and row groups of the phrase's terms only
        named = [F.col("part") == _part(F.lit(t)) for t in (p.terms[:last] if p.prefix else p.terms)]
        if p.prefix:  # the dictionary names the folders of the range's terms: TERM_FOLDERS numbers at most
            named.append(F.col("part").isin(*[r[0] for r in index.terms.where(_starts(p.terms[last])).select(_part(F.col("term"))).distinct().collect()]))
        rows = rows.where(reduce(Column.__or__, named) & reduce(Column.__or__, tests))
    if counted:
        return rows.where(tests[0]).select("path", "dl", "field", F.size("at").alias("n"))
    if last == 0:
        found = rows.where(tests[0]).select("path", "dl", "field", F.col("pos").alias("start"))
    else:
        offsets = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
        found = rows.select("path", "dl", "field", "pos", F.explode(offsets).alias("o")).withColumn("start", F.col("pos") - F.col("o"))
        found = found.groupBy("path", "dl", "field", "start").agg(F.count_distinct("o").alias("n")).where(F.col("n") == last + 1).drop("n")
    return found.where("start = 0") if p.first else found


def _near(found: list[DataFrame], group: list[Phrase]) -> list[DataFrame]:
    """Occurrences of phrases of one NEAR group, in documents and fields where all stand close together."""
    spots = None
    for k, df in enumerate(found):
        one = df.groupBy("path", "field").agg(F.collect_set("start").alias(f"s{k}"))
        spots = one if spots is None else spots.join(one, ["path", "field"])
    most = group[0].distance

    def within(k: int, low: Column, high: Column) -> Column:
        if k == len(found):
            return high - low <= most + sum(len(p.terms) for p in group[:1])
        return F.exists(f"s{k}", lambda x: within(k + 1, F.least(low, x), F.greatest(high, x)))

    ok = spots.where(F.exists("s0", lambda x: within(1, x, x))).select("path", "field")
    return [df.join(ok, ["path", "field"], "left_semi") for df in found]


def score_query(index: Index, text: str, weights: dict | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """path, score of the documents that match; idf and average length are those of the whole index."""
    weights = weights or WEIGHTS
    phrases, tree = parse_query(text, stem if index.stem else lambda t: t)
    plain = [index.terms is not None and index.entries is not None and len(p.terms) == 1 and not p.first and p.near <= 0 for p in phrases]
    found = [_occurrences(index, p, c) for p, c in zip(phrases, plain, strict=True)]
    alone = list(found)  # a phrase's document count doesn't depend on its neighbours
    for g in {p.near for p in phrases if p.near > 0}:
        at = [i for i, p in enumerate(phrases) if p.near == g]
        if len(at) > 1:
            for i, df in zip(at, _near([found[i] for i in at], [phrases[i] for i in at]), strict=True):
                found[i] = df
    weight = F.lit(0.0)
    for f, w in weights.items():
        weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
    parts = None
    for i, df in enumerate(found):
        one = df.select("path", "dl", F.lit(i).alias("i"), (weight * F.col("n") if plain[i] else weight).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    hits = parts.groupBy("path", "dl", "i").agg(F.sum("w").alias("f"))
    seen = hits.groupBy("i").agg(F.count(F.lit(1)).alias("n_i"))
    if any(p.near > 0 for p in phrases):
        every = [df.select("path", F.lit(i).alias("i")) for i, df in enumerate(alone)]
        seen = reduce(DataFrame.unionByName, every).groupBy("i").agg(F.count_distinct("path").alias("n_i"))
    idf = F.log((F.col("n") - F.col("n_i") + 0.5) / (F.col("n_i") + 0.5))
    seen = seen.crossJoin(index.totals).withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf))  # one row a phrase
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(seen), "i")
    scored = scored.groupBy("path").agg(F.sum(part).alias("score"), F.collect_set("i").alias("found"))

    def test(t: tuple) -> Column:
        if t[0] == "p":
            return F.array_contains("found", t[1])
        left, right = test(t[1]), test(t[2])
        return left & right if t[0] == "and" else left | right if t[0] == "or" else left & ~right

    return scored.where(test(tree)).select("path", "score")


def apply_filters(catalog: Catalog, hits: DataFrame, path_prefix: str | None = None, types: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    docs = catalog.documents
    prefix = (path_prefix or "").strip("/")
    if prefix:
        docs = docs.where((F.col("parent_path") == prefix) | F.col("parent_path").startswith(prefix + "/"))
    if types:
        docs = docs.where(F.col("type").isin(*types))
    if tags := [t for t in tags or () if t]:
        docs = docs.join(catalog.tags.where(F.col("tag").isin(*tags)).select("path"), "path", "left_semi")
    return hits.join(docs.select("path", "title", "type", "description", "body"), "path")


def correct_tokens(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """token, term: for words(token) the nearest term that starts alike; by distance, then the most widespread."""
    most = F.when(F.length("token") == SHORTEST, 1).otherwise(2)
    near = words.join(vocabulary, F.col("token").substr(1, 1) == F.col("term").substr(1, 1))
    near = near.where(F.abs(F.length("token") - F.length("term")) <= most).withColumn("d", F.levenshtein("token", "term")).where(F.col("d") <= most)
    best = Window.partitionBy("token").orderBy("d", F.desc("df"), "term")
    return near.withColumn("r", F.row_number().over(best)).where("r = 1").select("token", "term")


def corrected_query(index: Index, text: str) -> str | None:
    words = text.lower().split()
    if not 1 <= len(words) <= MOST_TOKENS or not all(re.fullmatch(r"[a-z]{%d,}" % SHORTEST, w) for w in words):
        return None
    table = index.tokens.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], "token string")
    best = {r["token"]: r["term"] for r in correct_tokens(vocabulary(index), table).collect()}
    return " ".join(f'"{best[w]}"' for w in words) if all(w in best for w in words) else None


def search(catalog: Catalog, index: Index, text: str, limit: int = 20, max_headings: int = 1, heading_depth: int = 1, weights: dict | None = None, k1: float = 1.2, b: float = 0.75, **filters) -> dict:
    """results, total_matches, truncated, corrected: the fallback is tried once, when the filtered total is 0."""
    corrected = None
    for attempt in (text, None):
        if attempt is None:
            corrected = corrected_query(index, text)
            if corrected is None:
                break
            plain = Index(index.tokens, index.totals, index.lengths, False, index.terms)  # its terms are index terms already
            hits = apply_filters(catalog, score_query(plain, corrected, weights, k1, b), **filters)
        else:
            hits = apply_filters(catalog, score_query(index, attempt, weights, k1, b), **filters)
        total = hits.count()
        if total:
            break
    if not total:
        return {"results": [], "total_matches": 0, "truncated": False, "corrected": corrected}
    page = hits.orderBy(F.desc("score"), "path").limit(limit).join(outline(catalog, heading_depth, max_headings), "path", "left")
    rows = page.select("path", display_title(F.col("title"), F.col("path")).alias("title"), "type", "description", "score", excerpt(F.col("body"), F.lit(text)).alias("excerpt"), F.coalesce("outline", F.array().cast("array<string>")).alias("outline"))
    found = [r.asDict() for r in rows.orderBy(F.desc("score"), "path").collect()]
    return {"results": found, "total_matches": total, "truncated": total > len(found), "corrected": corrected}
