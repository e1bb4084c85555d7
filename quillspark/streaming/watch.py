"""Change events: debounced batches, reconcile ticks, latest states, and applying batches to a snapshot."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.paths import gitignored, ignored
from ..sources.snapshot import HadoopFolder

LOG = logging.getLogger(__name__)
Rules = Sequence[tuple[str, bool]]
#: Slots of time that are looked at together.
STRETCH = 4096


def accepted(events: DataFrame, patterns: tuple[str, ...] = (), rules: Rules = (), only_md: bool = True) -> DataFrame:
    """Events of Markdown files that no pattern ignores and no .gitignore rule, whatever their kind."""
    keep = ~ignored(F.col("path"), patterns) & ~gitignored(F.col("path"), list(rules))
    return events.where(keep & F.col("path").endswith(".md") if only_md else keep)


def sessions(events: DataFrame, gap: int = 60) -> DataFrame:
    """slot, session_start, session_end, n_events: which quiet-bounded session of all events each slot of gap seconds lies in.

    Events of one slot are never parted by a gap, so slots are counted first, combined before the shuffle. Stretches of
    STRETCH slots are cut into runs each by itself; a run that touches neither end of its stretch is a session, and only
    the first and last runs of all stretches meet in one task: two rows per stretch of time, however many events.
    """
    wide = gap * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def numbered(rows: DataFrame, window: WindowSpec, name: str) -> DataFrame:
        near = micros("first") - F.lag(micros("last")).over(window) <= wide
        return rows.withColumn("near", near).withColumn(name, F.sum(F.when(F.col("near"), 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, 0)))

    slots = events.where(F.col("ts").isNotNull()).groupBy(_slot(gap).alias("slot")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    slots = numbered(slots.withColumn("stretch", F.floor(F.col("slot") / F.lit(STRETCH))), Window.partitionBy("stretch").orderBy("slot"), "run")
    runs = slots.groupBy("stretch", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    runs = runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("stretch"))))
    ends = numbered(runs.where("edge"), Window.orderBy("stretch", "run"), "session")
    whole = Window.partitionBy("session")
    ends = ends.select("stretch", "run", F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"), F.sum("n").over(whole).alias("n"))
    merged = ends.unionByName(runs.where("NOT edge").select(*ends.columns))
    end = F.col("last") + F.expr(f"INTERVAL {gap} SECONDS")
    return slots.select("slot", "stretch", "run").join(merged, ["stretch", "run"]).select("slot", F.col("first").alias("session_start"), end.alias("session_end"), F.col("n").alias("n_events"))


def _slot(gap: int) -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(gap * 1_000_000))


def batches(events: DataFrame, gap: int = 60) -> DataFrame:
    """session_start, path: the distinct paths of each session."""
    seen = events.select(_slot(gap).alias("slot"), "path").distinct()
    return seen.join(sessions(events, gap).select("slot", "session_start"), "slot").select("session_start", "path").distinct()


def debounce(events: DataFrame, gap: int = 60) -> DataFrame:
    """session_start, session_end, n_events, n_paths: one batch per quiet period of all events together."""
    whole = sessions(events, gap).drop("slot").distinct()
    paths = batches(events, gap).groupBy("session_start").agg(F.count("path").alias("n_paths"))
    return whole.join(paths, "session_start", "left").select("session_start", "session_end", "n_events", F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


def reconcile_ticks(events: DataFrame, every: str = "600 seconds") -> DataFrame:
    """Tumbling windows in which anything happened: each calls for a full rescan."""
    return events.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("tick"), "n_events")


def latest_state(events: DataFrame) -> DataFrame:
    """path, last_ts, last_kind, n_events: the last event of each path; ties go to the larger kind."""
    last = events.groupBy("path").agg(F.max(F.struct("ts", "kind")).alias("x"), F.count(F.lit(1)).alias("n_events"))
    return last.select("path", F.col("x.ts").alias("last_ts"), F.col("x.kind").alias("last_kind"), "n_events")


def classify(changed: DataFrame, on_disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, change for changed(path): by what exists now and what the catalog holds."""
    there = on_disk.select("path").distinct().withColumn("now", F.lit(True))
    known = indexed.select("path").distinct().withColumn("then", F.lit(True))
    both = changed.select("path").distinct().join(there, "path", "left").join(known, "path", "left")
    change = F.when(F.col("now") & F.col("then"), "modified").when(F.col("now"), "added").when(F.col("then"), "deleted")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def listing_changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """path of each file that came, went, or has another size or time, of two listings(path, size, modified_at)."""
    old = then.select("path", F.col("size").alias("_size"), F.col("modified_at").alias("_at"), F.lit(True).alias("_then"))
    both = now.select("path", "size", "modified_at", F.lit(True).alias("_now")).join(old, "path", "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_at").eqNullSafe(F.col("_at")) & F.col("_now").eqNullSafe(F.col("_then"))
    return both.where(~same).select("path")


class Ledger:
    """Changed paths that wait to be applied, in a folder that outlives the query that fills it.

    An entry is a table of paths and, once that is whole, a mark that names it and when it arrived (by the clock of the
    driver, not by the events' own times, so no event is ever too late). What a stream delivers again after a failure
    finds its mark and is not entered twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = HadoopFolder(spark, folder)

    def entries(self) -> dict[str, int]:
        """Name of each whole entry and when it arrived, in milliseconds."""
        return {name: int(at) for name, _, at in (n.partition("@") for n in self.files.names("marks"))}

    def add(self, name: str, paths: DataFrame, now: int) -> bool:
        """Enters paths(path) unless they are none or there already."""
        if name in self.entries() or paths.isEmpty():
            return False
        paths.select("path").distinct().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.files.create(f"marks/{name}@{now}", "")
        return True

    def paths(self, names: Iterable[str]) -> DataFrame:
        """The distinct paths of some entries."""
        return self.spark.read.schema("path string").parquet(*[f"{self.folder}/{n}" for n in names]).distinct()

    def drop(self, entries: dict[str, int]) -> None:
        for name, at in entries.items():
            self.files.delete(f"marks/{name}@{at}")
            self.files.delete(name)

    def last(self, what: str) -> int | None:
        """When something was last done, in milliseconds."""
        return max((int(n) for n in self.files.names(f"last-{what}") if n.isdigit()), default=None)

    def done(self, what: str, at: int) -> None:
        before = [n for n in self.files.names(f"last-{what}") if n.isdigit() and int(n) < at]
        if not self.files.exists(f"last-{what}/{at}"):
            self.files.create(f"last-{what}/{at}", "")
        for n in before:
            self.files.delete(f"last-{what}/{n}")

    def compare(self, name: str, listing: DataFrame, known: Callable[[], DataFrame], now: int) -> bool:
        """Enters what has changed since the last listing (the first time: since known()), and keeps the new one."""
        before = sorted(n for n in self.files.names("") if n.startswith("listing-") and self.files.exists(f"{n}/_SUCCESS"))
        path = f"listing-{now:015d}"
        listing.select("path", "size", "modified_at").write.mode("overwrite").parquet(f"{self.folder}/{path}")
        read = lambda n: self.spark.read.schema("path string, size long, modified_at long").parquet(f"{self.folder}/{n}")
        found = self.add(name, listing_changes(read(path), read(before[-1]) if before else known()), now)
        for n in before if found or not before else [path]:
            self.files.delete(n)
        return found


def watch(
    events: DataFrame | None, apply: Callable[[DataFrame, int], object], checkpoint: str, patterns: tuple[str, ...] = (), rules: Rules = (), gap: float = 0.0, tries: int = 3, available_now: bool = True, every: float = 1.0,
    listing: Callable[[], DataFrame] | None = None, known: Callable[[], DataFrame] | None = None, poll_seconds: float | None = None, reconcile: Callable[[], object] | None = None, reconcile_seconds: float = 600.0, spark: SparkSession | None = None,
):
    """A streaming query that hands changed paths to apply, together, once nothing has changed for gap seconds.

    Paths come from events(ts, path, kind) and, where listing() gives the files as they are now, from comparing it with
    the last listing every poll_seconds. They wait in a ledger beside the checkpoint. A tick comes with every trigger
    (each `every` seconds), whether there are events or not, so a lone event is applied after gap and one trigger, all
    that changed in one restless time comes as one batch, and no event is dropped for its time stamp.

    Every reconcile_seconds reconcile() has to bring everything up to date; what waited before it began is then done. A
    failing batch is tried again, then waits for the next trigger; the stream goes on. A restart finds the ledger and
    the checkpoint, so nothing is lost; a batch that broke off comes again, and applying it is idempotent.
    With available_now the query ends after what is there, and applies it without waiting.
    """
    spark = spark or events.sparkSession
    ledger = Ledger(spark, f"{checkpoint.rstrip('/')}-ledger")
    source = None if events is None else accepted(events, patterns, rules).select("path")
    if not available_now or source is None:
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load().select(F.lit(None).cast("string").alias("path"))
        source = ticks if source is None else source.unionByName(ticks)

    def due(what: str, seconds: float, now: int) -> bool:
        last = ledger.last(what)
        if last is None:
            ledger.done(what, now)
        return last is not None and now - last >= seconds * 1000

    def batch(df: DataFrame, epoch: int) -> None:
        now = int(time.time() * 1000)
        df = df.where("path IS NOT NULL").persist()
        try:
            ledger.add(f"epoch-{epoch}", df, now)
        finally:
            df.unpersist()
        if listing is not None and (poll_seconds is None or due("poll", poll_seconds, now)):
            ledger.compare(f"poll-{epoch}", listing(), known, now)
            ledger.done("poll", now)
        if reconcile is not None and due("reconcile", reconcile_seconds, now):
            waiting = ledger.entries()
            if _tried(lambda: reconcile(), tries, f"reconciling at batch {epoch}"):
                ledger.drop(waiting)
                ledger.done("reconcile", now)
        waiting = ledger.entries()
        if waiting and (available_now or int(time.time() * 1000) - max(waiting.values()) >= gap * 1000):
            if _tried(lambda: apply(ledger.paths(waiting), epoch), tries, f"batch {epoch}"):
                ledger.drop(waiting)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{max(1, int(every * 1000))} milliseconds")).start()


def _tried(act: Callable[[], object], tries: int, what: str) -> bool:
    for tried in range(1, tries + 1):
        try:
            act()
            return True
        except Exception:
            LOG.exception("%s failed, try %s of %s", what, tried, tries)
    return False
