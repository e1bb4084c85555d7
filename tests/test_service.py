"""Files in, answers out; ranking against SQLite's own FTS5."""

import os
import sqlite3

import pytest

from quillspark.config import Config
from quillspark.errors import NotFound
from quillspark.operators import search
from quillspark.service import CatalogService
from quillspark.sources.ingest import discover
from quillspark.sources.snapshot import SnapshotStore

FILES = {
    "metrics/revenue.md": "---\ntype: Metric\ntitle: Monthly Revenue\ntags: [finance]\nowner: Ann\n---\n# Definition\n\nRevenue of a month from [orders](../datasets/orders.md#x).\n\n## Calculation\n\nSum.\n",
    "metrics/churn.md": "---\ntype: Metric\ntitle: Churn\ntags: [finance, customer]\ntyped_links:\n  version: 1\n  links:\n    - {target: /metrics/revenue.md, relation: depends-on}\n---\n# Definition\n\nCustomers cancel. See [revenue](revenue.md) and [gone](missing.md).\n",
    "datasets/orders.md": "---\ntype: Dataset\ntitle: Orders\n---\nBack to [churn](/metrics/churn.md).\n",
    "bad.md": "---\ntype: [x\n---\nbody\n",
    "index.md": "# Root\n",
}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for name, content in FILES.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(content)
    s = CatalogService(spark, Config(roots=(str(root),)), str(tmp_path_factory.mktemp("store")))
    first = s.scan()
    assert first["files_added"] == 5 and first["parse_partial"] == 1
    return s


def test_rescan_sees_edits(service, spark):
    root = service.config.roots[0]
    assert service.scan()["files_unchanged"] == 5
    with open(f"{root}/index.md", "a") as f:
        f.write("\nmore\n")
    again = service.scan()
    assert again["files_modified"] == 1 and service.get_stats()["document_count"] == 5
    assert service.catalog.links.count() == 5


def test_index_is_stored_and_follows(service, spark):
    """The stored index of a snapshot that came by steps is that of all its documents."""
    folder = service.store.extra("index_stemmed")
    assert folder and service.index.terms is not None
    rows = lambda i: sorted(tuple(r) for r in i.tokens.select("path", "field", "pos", "term").collect())
    built = search.build_index(search.searchable(service.catalog))
    assert rows(service.index) == rows(built) and tuple(service.index.totals.select("n", "avgdl").head()) == tuple(built.totals.head())
    plan = search.score_query(service.index, "revenue")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan, plan


def test_watch_applies_events(service, spark, tmp_path):
    root = service.config.roots[0]
    with open(f"{root}/late.md", "w") as f:
        f.write("---\ntype: Note\n---\nlatecomer [x](index.md)\n")
    with open(f"{root}/unseen.tmp.md", "w") as f:
        f.write("x")
    with open(f"{root}/.gitignore", "w") as f:
        f.write("unseen*\n")
    events = spark.createDataFrame([("2024-01-01 00:00:00", "late.md"), ("2024-01-01 00:00:01", "bad.md"), ("2024-01-01 00:00:01", "unseen.tmp.md")], "ts string, path string").selectExpr("CAST(ts AS timestamp) AS ts", "path", "'modify' AS kind")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string, kind string").parquet(str(tmp_path / "in"))
    service.watch(str(tmp_path / "cp"), stream, available_now=True).awaitTermination(100)
    assert service.document_exists("late.md") and not service.document_exists("unseen.tmp.md")
    assert service.search("latecomer")["total_matches"] == 1
    for name in ("late.md", "unseen.tmp.md", ".gitignore"):
        os.remove(f"{root}/{name}")
    service.apply_paths(spark.createDataFrame([("late.md",)], "path string"))
    assert service.search("latecomer")["total_matches"] == 0 and service.get_stats()["document_count"] == 5


def test_a_broken_commit_changes_nothing(service, spark):
    store, before = service.store, service.store.current()
    store.files.create("_commits/0000009999", "v3-half")
    assert store.current() == before and store.read().documents.count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        store.files.create("_commits/0000009999", "x.")
    store.files.delete("_commits/0000009999")
    store.prune(keep=1)
    assert store.current() == before and len(store.commits()) == 1 and store.read().documents.count() == 5
    assert service.index.tokens.count() and service.search("revenue")["total_matches"] == 2


def test_older_snapshots_are_read(spark, tmp_path):
    """A version without newer tables and columns: nulls and empty tables."""
    store = SnapshotStore(spark, str(tmp_path))
    assert store.read().documents.count() == 0
    spark.createDataFrame([("a.md", "t")], "path string, title string").write.parquet(f"{tmp_path}/v1-x/documents")
    store.files.create("_commits/0000000001", "v1-x.")
    old = store.read()
    assert old.documents.select("path", "content_hash").collect() == [("a.md", None)] and old.sections.count() == 0
    store.write(old)
    assert store.current().startswith("v4-") and store.read().documents.count() == 1


def test_answers(service):
    assert service.get_document("metrics/revenue.md", ["metadata", "links", "backlinks", "headings"])["custom"] == {"owner": "Ann"}
    assert service.get_section("metrics/revenue.md", "calc")["content"] == "Sum."
    with pytest.raises(NotFound, match="metrics/churn.md"):
        service.get_document("metrics/chrun.md")
    assert [r["path"] for r in service.query_metadata({"type": "Metric", "tags_contains": "finance"})["results"]] == ["metrics/churn.md", "metrics/revenue.md"]
    assert service.browse("metrics")["index_document"] == "metrics/index.md"
    assert {n["path"] for n in service.traverse("datasets/orders.md")["nodes"]} >= {"metrics/churn.md", "metrics/revenue.md"}
    assert {r["relation"] for r in service.get_backlinks("metrics/revenue.md")} == {None, "depends-on"}


def test_validation(service):
    report = service.validate_report()
    found = {c["check"]: c["status"] for c in report["checks"]}
    assert found["broken_links"] == "warn" and found["invalid_yaml"] == "fail" and found["typed_link_conflicts"] == "warn" and found["circular_references"] == "warn"
    assert report["exit_status"] == 1


def test_search(service):
    got = service.search("revenues", types=["Metric"])
    assert [r["path"] for r in got["results"]] == ["metrics/revenue.md", "metrics/churn.md"]
    typo = service.search("montly reveneu")
    assert typo["corrected"] and typo["results"][0]["path"] == "metrics/revenue.md"
    assert service.search("quantum entanglement")["total_matches"] == 0


ROWS = [("a.md", "Needle", "", "Overview", "Brief text.", "Note"), ("b.md", "Body Match", "", "Overview", "needle " * 10, "Note"), ("c.md", "Tie", "x", "Same", "tieonly running cafés", "Note"), ("d.md", "Tie", "", "Same", "tieonly needles foo-bar", "Metric")]


@pytest.mark.parametrize("text", ["needle", "tieonly", "runs", "cafe", '"foo bar"', "title:tie", "metric", "needle tieonly", "needle OR tieonly", "needle NOT tieonly", "need*", "body:^needle", "NEAR(tieonly needles, 3)", "{title body}:needle"])
def test_ranks_as_fts5(spark, text):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, title, description, headings, body, concept_type, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    want = db.execute("SELECT path, -bm25(t, 0, 10, 5, 2, 1, 0) AS s FROM t WHERE t MATCH ? ORDER BY s DESC, path", (text,)).fetchall()
    docs = spark.createDataFrame(ROWS, "path string, title string, description string, headings string, body string, type string")
    got = search.score_query(search.build_index(docs), text).collect()
    assert sorted((r["path"], pytest.approx(r["score"], rel=1e-9)) for r in got) == sorted(want)


def test_folds_accents(spark):
    rows = [(t, t, "", "", "", "") for t in ("École Général", "LICENSES of cafés", "naïve publishing", "Über Straßen", "señores publicados", "", "?!")]
    docs = spark.createDataFrame(rows, "path string, title string, description string, headings string, body string, type string")
    index = search.build_index(docs, use_stem=False)
    got = sorted((r["path"], r["pos"], r["term"], r["dl"]) for r in index.tokens.collect())
    want = {"École Général": "ecole general", "LICENSES of cafés": "licenses of cafes", "naïve publishing": "naive publishing", "Über Straßen": "uber straßen", "señores publicados": "senores publicados"}
    assert got == sorted((t, i, w, len(ws.split())) for t, ws in want.items() for i, w in enumerate(ws.split()))
    assert {r["path"]: r["dl"] for r in index.lengths.collect()} == {t: len(want.get(t, "").split()) for t, *_ in rows}


#: Files of nested ignore rules, and what they leave of the files below.
IGNORES = {"": "*.draft.md\n/build\n!keep.draft.md\n", "docs": "/local\n!special.draft.md\ntmp/\n", "docs/deep": "*.md\n!only.md\n", "a+b": "x.md\n"}
LEFT = {"a.md": True, "a.draft.md": False, "keep.draft.md": True, "build/x.md": False, "docs/build/x.md": True, "docs/local/x.md": False, "local/x.md": True, "docs/special.draft.md": True, "docs/other.draft.md": False,
        "docs/sub/special.draft.md": True, "special.draft.md": False, "docs/tmp/x.md": False, "tmp/x.md": True, "docs/deep/x.md": False, "docs/deep/only.md": True, "docs/deep/er/x.md": False, "docs/deep/er/only.md": True, "a+b/x.md": False, "aab/x.md": True}


def test_nested_ignore_files(spark, tmp_path):
    for path in LEFT:
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text("x")
    for folder, rules in IGNORES.items():
        (tmp_path / folder / ".gitignore").write_text(rules)
    found = {r["path"] for r in discover(spark, str(tmp_path), Config()).select("path").collect()}
    assert found == {p for p, left in LEFT.items() if left}
    named = {r["path"] for r in discover(spark, str(tmp_path), Config(), [*LEFT, "none.md"]).select("path", "content").collect()}
    assert named == found


def test_an_index_of_an_older_form_is_built_anew(service):
    folders = service.store.extra("index_stemmed")
    assert folders and service._segments() == folders
    for f in folders:
        os.rename(f"{f}/entries", f"{f}/tokens")
    try:
        service._index = None
        assert service._segments() == [] and service.index.terms is None
    finally:
        for f in folders:
            os.rename(f"{f}/tokens", f"{f}/entries")
        service._index = None
