import os
import time

from quillspark.streaming import watch

KIND = "ts timestamp, path string, kind string"


def event(spark, folder, path, at="2024-01-01 00:00:00"):
    rows = spark.createDataFrame([(at, path, "modify")], "ts string, path string, kind string")
    rows.selectExpr("CAST(ts AS timestamp) AS ts", "path", "kind").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(KIND).parquet(folder)


def until(test, seconds=40.0):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.1)
    return test()


def test_stream_delivers_each_path_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a.md", "create"), ("2024-01-01 00:00:30", "a.md", "modify"), ("2024-01-01 00:10:00", "b.md", "create"), ("2024-01-01 00:10:00", "x.tmp", "create")]
    events = spark.createDataFrame(rows, "ts string, path string, kind string").selectExpr("CAST(ts AS timestamp) AS ts", "path", "kind")
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch.watch(stream(spark, str(tmp_path / "in")), lambda df, epoch: seen.extend(r[0] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["a.md", "b.md"]
    assert watch.debounce(watch.accepted(events)).count() == 2


def test_a_failing_batch_comes_again(spark, tmp_path):
    source, tries, seen = str(tmp_path / "in"), [], []

    def apply(df, epoch):
        tries.append(epoch)
        if len(tries) <= 2:
            raise OSError("store is away")
        seen.append(sorted(r[0] for r in df.collect()))

    for path, at in (("a.md", "2024-01-01 00:00:00"), ("b.md", "2024-01-01 00:00:09")):
        event(spark, source, path, at)
        watch.watch(stream(spark, source), apply, str(tmp_path / "cp"), tries=2).awaitTermination(60)
    assert seen == [["a.md", "b.md"]] and len(tries) == 3


def test_lone_late_and_restless_events(spark, tmp_path):
    """A lone event needs no later one; an event half an hour behind is applied; a restless time is one batch."""
    source, seen = str(tmp_path / "in"), []
    event(spark, source, "first.md", "2024-01-01 12:00:00")
    gap = 3.0
    q = watch.watch(stream(spark, source), lambda df, _: seen.append((time.time(), sorted(r[0] for r in df.collect()))), str(tmp_path / "cp"), gap=gap, available_now=False, every=0.2)
    try:
        assert until(lambda: len(seen) == 1) and seen[0][1] == ["first.md"]
        event(spark, source, "late.md", "2024-01-01 11:30:00")
        assert until(lambda: len(seen) == 2) and seen[1][1] == ["late.md"]
        for k in range(5):  # never quiet for the gap
            event(spark, source, f"r{k % 3}.md")
            last = time.time()
            time.sleep(0.5)
        assert until(lambda: len(seen) == 3) and seen[2][1] == ["r0.md", "r1.md", "r2.md"]
        assert seen[2][0] - last >= gap * 0.9
        time.sleep(2 * gap)
        assert len(seen) == 3 and q.isActive
    finally:
        q.stop()


def test_restart_finds_what_waited(spark, tmp_path):
    """A query that ends while paths wait, and one whose batch broke off after it was entered: nothing lost, one batch."""
    source, folder, seen = str(tmp_path / "in"), str(tmp_path / "cp"), []
    event(spark, source, "a.md")
    ledger = watch.Ledger(spark, folder + "-ledger")
    q = watch.watch(stream(spark, source), lambda df, _: seen.append("early"), folder, gap=3600, available_now=False, every=0.2)
    assert until(lambda: ledger.entries())
    q.stop()
    assert not seen and [r[0] for r in ledger.paths(ledger.entries()).collect()] == ["a.md"]
    name = next(iter(ledger.entries()))
    assert not ledger.add(name, spark.createDataFrame([("again.md",)], "path string"), 1)
    spark.createDataFrame([("half.md",)], "path string").write.parquet(f"{folder}-ledger/epoch-77")  # no mark: not whole
    event(spark, source, "b.md")
    q = watch.watch(stream(spark, source), lambda df, _: seen.append(sorted(r[0] for r in df.collect())), folder, gap=1, available_now=False, every=0.2)
    try:
        assert until(lambda: seen) and seen == [["a.md", "b.md"]]
        assert until(lambda: not ledger.entries())
    finally:
        q.stop()


def test_listings_and_reconciling(spark, tmp_path):
    """Changes without events are found by listing; what waits when reconciling begins is not applied again."""
    state, seen, whole = {"a.md": (1, 1), "b.md": (2, 2)}, [], []
    listing = lambda: spark.createDataFrame([(p, *v) for p, v in state.items()], "path string, size long, modified_at long")
    known = lambda: spark.createDataFrame([("a.md", 1, 1), ("gone.md", 5, 5)], "path string, size long, modified_at long")
    take = lambda df, _: seen.append(sorted(r[0] for r in df.collect()))
    q = watch.watch(None, take, str(tmp_path / "cp"), gap=1, available_now=False, every=0.3, listing=listing, known=known, spark=spark)
    try:
        assert until(lambda: len(seen) == 1) and seen[0] == ["b.md", "gone.md"]
        state["a.md"] = (1, 7)
        del state["b.md"]
        assert until(lambda: len(seen) == 2) and seen[1] == ["a.md", "b.md"]
        time.sleep(3)
        assert len(seen) == 2
    finally:
        q.stop()
    source = str(tmp_path / "in")
    event(spark, source, "x.md")
    q = watch.watch(stream(spark, source), take, str(tmp_path / "cp2"), gap=3600, available_now=False, every=0.3, reconcile=lambda: whole.append(1), reconcile_seconds=2)
    try:
        assert until(lambda: whole) and until(lambda: not watch.Ledger(spark, str(tmp_path / "cp2-ledger")).entries())
        assert len(seen) == 2
    finally:
        q.stop()
    assert os.path.isdir(tmp_path / "cp2-ledger")


def test_sessions_meet_as_slots(spark):
    """Only the ends of stretches of slots come together in one task, and sessions that cross them are whole."""
    events = spark.range(5000).selectExpr("timestamp_seconds(id * 7 + (id div 100) * 1000) AS ts", "concat('p', id % 30, '.md') AS path")
    got = watch.debounce(events).collect()
    assert len(got) == 50 and {r["n_events"] for r in got} == {100} and {r["n_paths"] for r in got} == {30}
    assert watch.debounce(events.where("false")).count() == 0


def test_sessions_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(watch, "STRETCH", 4)
    import numpy as np

    at = np.cumsum(np.random.default_rng(3).choice([1, 5, 9, 10, 11, 12, 40], 400)).tolist()
    events = spark.createDataFrame([(t,) for t in at], "t long").selectExpr("timestamp_seconds(t) AS ts", "'a.md' AS path")
    want, start, n = [], at[0], 1
    for a, b in zip(at, at[1:] + [10**9], strict=True):
        if b - a > 10:
            want.append((start, a + 10, n))
            start, n = b, 0
        n += 1
    got = watch.debounce(events, 10).selectExpr("unix_seconds(session_start) AS s", "unix_seconds(session_end) AS e", "n_events").collect()
    assert sorted(map(tuple, got)) == want
