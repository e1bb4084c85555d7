"""Commits and index segments cost what has changed, and read as if all had been written anew."""

import os
import random

from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.schema import TABLES, Catalog
from quillspark.sources.snapshot import SnapshotStore

WORDS = "alpha beta gamma delta running cafés naïve license revenue orders zebra".split()


def catalog(spark, docs):
    """Documents of docs (path -> body) with a heading, a tag and a link each."""
    empty = {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()}
    if not docs:
        return Catalog(**empty)
    rows = spark.createDataFrame(list(docs.items()), "path string, body string")
    documents = rows.select("path", F.lit("").alias("parent_path"), F.upper("path").alias("title"), F.lit("Note").alias("type"), F.lit(None).cast("string").alias("description"), "body", F.col("body").alias("plain_text"), F.length("body").cast("long").alias("file_size"), F.lit(1).cast("long").alias("modified_at"), F.md5("body").alias("content_hash"), F.lit("ok").alias("parse_status"), F.lit(False).alias("has_front_matter"))
    made = {"documents": documents, "tags": rows.select("path", F.lit("t").alias("tag")), "headings": rows.select("path", F.lit(1).alias("level"), F.substring("body", 1, 5).alias("title"), F.lit("a").alias("anchor"), F.lit(1).alias("pos"))}
    made["links"] = rows.select(F.col("path").alias("src"), F.lit("p0.md").alias("dst"), *[F.lit(None).cast("string").alias(c) for c in ("anchor", "external_url", "relation")], F.lit(1).alias("pos"))
    return Catalog(**empty | made)


def files(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.startswith(".")}


def tables(c):
    return {name: sorted(map(repr, t.collect())) for name, t in c.each()}


def test_a_commit_writes_what_it_touches(spark, tmp_path):
    """One document of 10,000: under 2 % of the bytes; older versions stay readable until they are pruned."""
    body = lambda i, n: " ".join(random.Random(i * 7 + n).choices(WORDS, k=60))
    docs = {f"p{i}.md": body(i, 0) for i in range(10_000)}
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(catalog(spark, docs))
    first, old, whole = store.current(), store.read(), files(store.folder)
    changed = {"p77.md": "quite other words"}
    store.update(catalog(spark, changed), spark.createDataFrame([("p5.md",)], "path string").where("false"))
    added = {f: n for f, n in files(store.folder).items() if f not in whole}
    assert sum(added.values()) < 0.02 * sum(whole.values()) and all(files(store.folder)[f] == n for f, n in whole.items())
    assert old.documents.where("path = 'p77.md'").head()["body"] == docs["p77.md"] and old.documents.count() == 10_000
    assert store.read().documents.where("path = 'p77.md'").head()["body"] == "quite other words"
    store.update(catalog(spark, {"new.md": "n"}), spark.createDataFrame([("p5.md",), ("none.md",)], "path string"))
    assert store.current() != first and store.read().documents.count() == 10_000 and store.read().links.where("src = 'p5.md'").isEmpty()
    store.prune(keep=1)
    want = {p: changed.get(p, b) for p, b in docs.items() if p != "p5.md"} | {"new.md": "n"}
    assert tables(store.read()) == tables(catalog(spark, want))


def test_a_commit_that_breaks_off_changes_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.write(catalog(spark, {"a.md": "x", "b.md": "y"}))
    broken = catalog(spark, {"a.md": "z"})
    broken.links = broken.links.withColumn("dst", F.raise_error(F.lit("lost")).cast("string"))
    try:
        store.update(broken, spark.createDataFrame([], "path string"))
        raise AssertionError("it went through")
    except Exception as e:
        assert "lost" in str(e)
    assert sorted(r["body"] for r in store.read().documents.collect()) == ["x", "y"]
    store.prune(keep=1)
    assert tables(store.read()) == tables(catalog(spark, {"a.md": "x", "b.md": "y"}))


def index_rows(index):
    part = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    n, avgdl = index.totals.select("n", "avgdl").head()
    terms = index.terms if index.terms is not None else search.term_counts(index)
    return part(index.tokens, "path", "field", "pos", "term"), part(index.lengths, "path", "dl"), part(terms, "term", "df", "cnt"), n, round(avgdl or 0, 9)


def test_segments_read_as_a_fresh_build(spark, tmp_path):
    """20 random updates, with merges on the way: rows, lengths, counts of terms and totals are those of a fresh build."""
    rng = random.Random(4)
    page = lambda docs: search.searchable(catalog(spark, docs))
    docs = {f"p{i}.md": " ".join(rng.choices(WORDS, k=12)) for i in range(30)}
    root, segments, sizes = str(tmp_path), ["base"], [30]
    search.write_index(search.build_index(page(docs)), f"{root}/base")
    merges = 0
    for step in range(20):
        fresh = {f"p{rng.randrange(40)}.md": " ".join(rng.choices(WORDS, k=rng.randrange(9))) for _ in range(rng.randrange(3))}
        gone = [p for p in rng.sample(sorted(docs), 2) if p not in fresh][: rng.randrange(3)] + ["never.md"] * (step % 5 == 0)
        before = {p: docs[p] for p in [*fresh, *gone] if p in docs}
        search.add_segment(spark, f"{root}/s{step}", page(fresh), spark.createDataFrame([(p,) for p in gone], "path string"), page(before), True)
        segments, sizes = [*segments, f"s{step}"], [*sizes, max(1, len(fresh) + len(gone))]
        docs = {p: b for p, b in docs.items() if p not in gone} | fresh
        if k := search.tail_to_merge(sizes, 4):
            merges += 1
            search.merge_segments(spark, [f"{root}/{s}" for s in segments[-k:]], f"{root}/m{step}", k == len(segments))
            segments[-k:], sizes[-k:] = [f"m{step}"], [sum(sizes[-k:])]
        if step == 9:
            assert index_rows(search.read_index(spark, [f"{root}/{s}" for s in segments], True)) == index_rows(search.build_index(page(docs)))
    folders = [f"{root}/{s}" for s in segments]
    assert merges >= 2 and len(folders) < 10
    got = search.read_index(spark, folders, True)
    assert index_rows(got) == index_rows(search.build_index(page(docs)))
    search.merge_segments(spark, folders, f"{root}/all", True)
    assert index_rows(search.read_index(spark, f"{root}/all", True)) == index_rows(search.build_index(page(docs)))
    built = search.build_index(page(docs))
    hits = lambda i: sorted((r["path"], round(r["score"], 9)) for r in search.score_query(i, "cafe OR licens*").collect())
    assert hits(got) == hits(built) and hits(built)


def test_tiers():
    assert search.tail_to_merge([1000] + [1] * 7) == 0 and search.tail_to_merge([1000] + [1] * 8) == 8
    assert search.tail_to_merge([8] * 8) == 8 and search.tail_to_merge([64, 8, 1]) == 0 and search.tail_to_merge([]) == 0
