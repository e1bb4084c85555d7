import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common, exact_dedup, jaccard_join, language_id
from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import ODD, SF, brute_groups, docs


def test_pipeline_keeps_what_it_should(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.columns) == {*first.columns, "block", "slot", "place"} and out["doc_id"].is_unique
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    kept = out.sort_values("doc_id")
    groups = brute_groups([texts[i] for i in kept["doc_id"]], 5, 8, 10)
    assert all(g == i for i, (_, g) in enumerate(groups))  # no near copies are left
    assert len(out) > 0.8 * len(texts)


def test_stages_survive_odd_rows(spark):
    d = docs(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert set(d.columns) <= set(stage(spark, d, SF).columns)
        assert stage(spark, d.where("false"), SF).count() == 0


@pytest.mark.parametrize("bits", [0, 1, common.MAP_BITS])
def test_stages_drop_rows_not_ids(spark, monkeypatch, bits):
    """Null and repeated ids: of the rows of one id only those go that have to, and equal rows are copies; the same
    whether the map of rows that may go is full or hardly filled."""
    monkeypatch.setattr(common, "MAP_BITS", bits)
    say = lambda seed: " ".join(f"the {seed}{i} of and that with" for i in range(12))
    kind = "doc_id long, text string, lang string, source string"
    left = lambda n, rows: sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[n][1](spark, spark.createDataFrame([(i, t, "en", "s") for i, t in rows], kind), SF).collect()), key=str)
    want = lambda *rows: sorted(rows, key=str)
    a, b, c = say("a"), say("b"), say("c")
    assert left(0, [(None, a), (None, ""), (7, b), (7, "12 %%")]) == want((None, a), (7, b))
    assert left(1, [(None, a), (None, b), (None, b), (1, a), (7, a), (7, c), (7, c)]) == want((1, a), (None, b), (7, c))
    near = c + " end"
    assert left(2, [(None, a), (None, b), (None, b), (1, a), (7, a), (7, c), (7, near), (9, ""), (9, "")]) in (want((1, a), (None, b), (7, x), (9, ""), (9, "")) for x in (c, near))
    leak = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    assert left(3, [(None, a), (None, leak), (7, b), (7, leak)]) == want((None, a), (7, b))


@pytest.mark.parametrize("bits", [6, 18, common.MAP_BITS])
def test_drop_keys_against_sets(spark, monkeypatch, bits):
    """Every bit position and piece of the map is read where it was set: exactly the named rows go."""
    monkeypatch.setattr(common, "MAP_BITS", bits)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    key = common.row_key(docs, "text")
    named = lambda which: docs.where(which).select(key.alias("key"))
    got = common.drop_keys(docs, key, named("doc_id % 7 = 0"))
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(20_000) if i % 7]
    twice = docs.unionByName(docs)
    got = common.drop_keys(twice, key, named("doc_id % 7 = 0"), named("doc_id % 7 = 1"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted([i for i in range(20_000) if i % 7 > 1] * 2 + [i for i in range(20_000) if i % 7 == 1])
    assert common.drop_keys(docs, key, named("false")).count() == 20_000


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        columns, key = sorted(want.columns), want.columns[0]
        assert sorted(got.columns) == columns
        a, b = (x.sort_values(key).reset_index(drop=True)[columns].astype(object) for x in (got, want))
        assert a.where(a.notna(), None).equals(b.where(b.notna(), None)), name


def test_small_batches(spark, monkeypatch):
    """Maps get batches of a few rows of text, behind a shuffle too; a row beyond the bound still comes whole, and the
    session's own setting is back afterwards, also after an error."""
    monkeypatch.setattr(common, "BATCH_BYTES", 100_000)
    rows = spark.range(3000).select(F.expr("repeat('x', IF(id = 7, 400000, 1000))").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"rows": [len(b)], "chars": [int(b["text"].str.len().sum())]})

    for table in (rows, rows.repartition(3, "text")):
        with common.small_batches(spark):
            got = common.written(table.mapInPandas(sizes, "rows long, chars long"), "sizes").collect()
        assert sum(r["rows"] for r in got) == 3000 and sum(r["chars"] for r in got) == 2999 * 1000 + 400_000
        assert sum(r["chars"] > 110_000 for r in got) == 1 and max(r["rows"] for r in got) <= 110
    before = spark.conf.get(common._BATCH_CONF)
    with pytest.raises(ZeroDivisionError), common.small_batches(spark):
        raise ZeroDivisionError
    assert spark.conf.get(common._BATCH_CONF) == before != "100000"


def test_stages_map_texts_in_small_batches(spark, monkeypatch):
    """The maps over texts run while a stage is made, so what it gives has none left that a caller would run otherwise."""
    ran, real = [], common.written
    seen = lambda df, label: ran.append((label, int(spark.conf.get(common._BATCH_CONF).rstrip("b")), "MapInPandas" in df._jdf.queryExecution().toString())) or real(df, label)
    for module in (common, jaccard_join, language_id):
        monkeypatch.setattr(module, "written", seen)
    d = docs(spark, ["the cat and the dog of that house with a hat", "one two three four five six seven"])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, SF)
        assert "MapInPandas" not in out._jdf.queryExecution().toString(), name
    maps = [(label, most) for label, most, mapped in ran if mapped]
    assert {"language", "gone", "sets", "members"} <= {label for label, _ in maps}
    assert all(most == common.BATCH_BYTES for _, most in maps), maps


def test_components_without_links_take_no_python_workers(spark):
    none = jaccard_join.components(spark.range(3).selectExpr("id AS a", "id AS b"))
    assert none.count() == 0 and none.dtypes == [("node", "bigint"), ("label", "bigint")]
    assert "ExistingRDD" not in none._jdf.queryExecution().toString()


def test_components_add_to_known_ones(spark):
    """Links that come later, between known components, within them and to nodes not seen before, give what all links at
    once would give; where nothing new is joined, known labels stay."""
    rng = np.random.default_rng(3)
    parts = [[(int(a), int(b)) for a, b in rng.integers(0, 400, (n, 2))] for n in (150, 80, 60)]
    parts.append([(7, 7)])
    labels, root, up = None, {}, lambda x: x if root.setdefault(x, x) == x else up(root[x])
    for part in parts:
        for a, b in part:
            if a != b:
                x, y = sorted((up(a), up(b)))
                root[y] = x
        labels = jaccard_join.components(spark.createDataFrame(part, "a long, b long"), labels)
        got = {r["node"]: r["label"] for r in labels.collect()}
        assert len(got) == labels.count() and got == {n: up(n) for n in root}


def test_arrays_are_summed_in_few_jobs(spark):
    """The driver runs a job for each group at most, not for each of the many partitions without one."""
    parts = spark.range(100, numPartitions=2).select(F.expr("unhex(lpad(hex(id), 2, '0'))").alias("x"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("summed", "summed")
    try:
        total = common.summed(parts, "x", np.zeros(1, np.uint8), np.add)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert total.tolist() == [sum(range(100)) % 256]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("summed")) <= common.SUM_GROUPS + 2


def test_stages_send_no_late_broadcasts(spark, monkeypatch):
    """Scratch tables of the stages are made while a shuffled side is not sent to the driver; the setting is unset after."""
    ran, real = [], common.written
    for module in (common, exact_dedup, jaccard_join, language_id):
        monkeypatch.setattr(module, "written", lambda df, label: ran.append((label, spark.conf.get(common._LATE_CONF, None))) or real(df, label))
    d = docs(spark, ["the cat and the dog of that house with a hat", "one two three four five six seven"])
    for _, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, d, SF)
        assert spark.conf.get(common._LATE_CONF, None) is None
    assert {"language", "digests", "members", "gone"} <= {label for label, _ in ran} and all(most == "-1" for _, most in ran), ran
