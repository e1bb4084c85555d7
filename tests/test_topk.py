"""The best k without all postings: the page of scoring everything, and how much was read for it."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.topk import top_k

KIND = "path string, title string, description string, headings string, body string, type string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Two segments over 1,500 documents: a word in nearly all of them, words in ever fewer, and lengths that differ much."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]

    def page(i):
        body = rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.choice([5, 20, 60, 300]))
        return (f"p{i}.md", rng.choice(words) if rng.random() < 0.3 else "", "", "", " ".join(body + ["common"] * rng.randrange(1, 4)), "Note")

    rows = [page(i) for i in range(1500)]
    root = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    search.write_index(search.build_index(docs), f"{root}/a")
    changed = [page(i) for i in range(0, 1500, 50)]
    paths = spark.createDataFrame([(r[0],) for r in changed], "path string")
    search.add_segment(spark, f"{root}/b", spark.createDataFrame(changed, KIND), paths.where("false"), docs.join(paths, "path", "left_semi"), True)
    return search.read_index(spark, [f"{root}/a", f"{root}/b"], True)


def pages(index, text, k):
    row = lambda r: (r["path"], round(r["score"], 9))
    got = top_k(index, text, k)
    want = search.score_query(index, text).orderBy(F.desc(F.round("score", 9)), "path").limit(k).collect()
    return [row(r) for r in got.rows.collect()], [row(r) for r in want], got


def test_same_pages(index):
    """Queries of one to three words, of every frequency; k below, about and above the number of matches."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["common", "unheard"]
    for n in range(12):
        text = rng.choice([" ", " OR ", " AND "]).join(rng.sample(words, rng.randrange(1, 4)))
        got, want, _ = pages(index, text, rng.choice([1, 5, 10, 2000]))
        assert got == want, text


def test_common_terms_are_read_in_part(index):
    for text in ("common", "w0", "w1"):
        got, want, page = pages(index, text, 5)
        assert got == want and 0 < page.read < page.held / 3, (text, page.read, page.held)
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((part" in plan or "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan, plan


def test_other_queries_are_scored_whole(index):
    for text in ('"w1 w2"', "w5*", "title:w3", "w1 NOT w2", "w1 AND (w2 OR w3)"):
        got, want, page = pages(index, text, 7)
        assert got == want and page.read == -1


def test_a_prefix_is_a_range(index):
    found = search.score_query(index, "w5*")
    plan = found.sparkSession._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "term:string" in x and "field:string" in x]
    assert scans and all("GreaterThanOrEqual(term,w5), LessThan(term,w6)" in x for x in scans), plan
    assert any("PartitionFilters" in x and "part" in x.split("PartitionFilters")[1].split("\n")[0] for x in scans), plan


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("REBALANCE")


def test_unstemmed_postings_shuffle_nothing(spark, tmp_path):
    """Entries are made within a document and sorted within a task; where documents share a path they are summed."""
    rows = [("a.md", "Alpha", None, "beta", "alpha beta alpha", "Note"), ("b.md", "", None, None, None, "Note"), ("c.md", None, "x", "", "beta", "")]
    kind = lambda df: sorted(map(tuple, df.select("term", "path", "field", "tf").collect()))
    built = search.build_index(spark.createDataFrame(rows, KIND), use_stem=False)
    found = search.postings(built)
    want = sorted(map(tuple, built.tokens.groupBy("term", "path", "field").count().collect()))
    assert kind(found) == want and ("alpha", "a.md", "body", 2) in want and _shuffles(found) == 0
    assert _shuffles(built.entries.sortWithinPartitions("term")) == 0
    stored = search.write_index(built, f"{tmp_path}/one")
    assert kind(search.postings(stored)) == want and _shuffles(search.postings(stored)) == 0
    again = search.build_index(spark.createDataFrame([*rows, rows[0]], KIND), use_stem=False)
    want = sorted(map(tuple, again.tokens.groupBy("term", "path", "field").count().collect()))
    assert kind(search.postings(again)) == want and ("alpha", "a.md", "body", 4) in want
    assert kind(search.postings(search.write_index(again, f"{tmp_path}/two"))) == want


def test_an_unstemmed_index_is_written_once(spark, tmp_path):
    """One table of entries, from which tokens, postings and single terms' scores follow."""
    rng = random.Random(5)
    rows = [(f"{i}.md", rng.choice("abc"), "", "b" * (i % 3), " ".join(rng.choices("abcdef", k=rng.randrange(40))), "Note") for i in range(200)]
    built = search.build_index(spark.createDataFrame(rows, KIND), use_stem=False)
    stored = search.write_index(built, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bounds", "docs", "entries", "terms", "totals"]
    part = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert part(stored.tokens, "path", "dl", "field", "pos", "term") == part(built.tokens, "path", "dl", "field", "pos", "term")
    assert part(stored.terms, "term", "df", "cnt") == part(search.term_counts(built), "term", "df", "cnt")
    for text in ("a b", "a OR f", "b*", '"a b"', "title:a NOT c", "a NEAR b"):
        assert pages(stored, text, 500)[:2] == (pages(built, text, 500)[1],) * 2
