"""Shared helpers of the training-data operators: scratch tables, hot-key lookups, word and shingle hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes A-Z to a-z, all else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that one Python worker remembers the hash of before it starts afresh.
WORD_CACHE = 400_000


#: Bits of the map that says which rows may have to go: 8 MB on each executor, whatever the corpus.
MAP_BITS = 26
#: Bytes of one Arrow batch within small_batches. The executor's JVM and Python hold a batch in several copies each.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_LATE_CONF = "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Groups, and so tasks, in which summed brings arrays together ahead of the driver.
SUM_GROUPS = 8
#: Bits in one piece of the map (what bitmap_construct_agg gives).
_PIECE = 15
#: Scratch tables written within the innermost written_alone of this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a single machine
    (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quill-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


@contextmanager
def _with_conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting `name` is value within, and what it was, or unset, after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession):
    """What runs within hands Python batches of about BATCH_BYTES, instead of up to 64 MB; a larger row is a batch of its own.

    Only the size of batches differs, never a result. The setting is the session's, and is put back.
    """
    return _with_conf(spark, _BATCH_CONF, str(BATCH_BYTES))


def no_late_broadcasts(spark: SparkSession):
    """What runs within joins shuffled sides where they lie, however small one turns out.

    Adaptive execution would collect that side to the driver, after both were shuffled: each time a hash table, its blocks
    and a thread there, for a sort that is spared. Sides known to be small beforehand are still broadcast, unshuffled.
    """
    return _with_conf(spark, _LATE_CONF, "-1")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """written(make()), without the scratch tables that making it took."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = written(make(), label)
    finally:
        _MADE.reset(token)
    if (outer := _MADE.get()) is not None:
        outer.append(made[-1])
    spark = out.sparkSession
    for name in made[:-1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later plan reads."""
    for table in tables:
        session = table.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup_spread(rows: DataFrame, table: DataFrame, keys: list[str], spread_by: list[str], fan: int = 256, how: str = "left") -> DataFrame:
    """rows joined with table (unique on keys) where one key may hold a third of the rows.

    Rows are salted by a hash of spread_by; each (salt, key) asks the table once, so a hot key reaches it as at most
    fan rows, and the answers join back on (salt, key). No row is dropped; null keys find nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(fan)))
    asked = salted.select("_salt", *keys).distinct().join(table, keys, "inner")
    return salted.join(asked, ["_salt", *keys], how).drop("_salt")


def row_key(docs: DataFrame, *columns: str) -> Column:
    """A string that tells rows apart by doc_id and columns (128 bits of hash) and sorts by doc_id, null last.

    Equal rows share it. It is computed alike wherever docs is read, so nothing has to be numbered or stored.
    """
    own = F.col("doc_id")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        name = F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        name = F.concat(own.cast("string"), F.lit("\0"))
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]  # the hash passes over nulls
    prints = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in ("one", "two")]
    return F.concat(F.coalesce(name, F.lit("\U0010ffff")), *prints)


def may_be_in(docs: DataFrame, key: Column, names: DataFrame) -> DataFrame:
    """docs with _row_key and _may, which is false only where the key is not in names(_row_key)."""
    at = F.xxhash64("_row_key").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    piece, bit = F.shiftright(at, _PIECE), at.bitwiseAND(F.lit((1 << _PIECE) - 1))
    bits = names.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    rows = docs.withColumn("_row_key", key).withColumn("_piece", piece)
    return rows.join(F.broadcast(bits), "_piece", "left").withColumn("_may", own).drop("_piece", "_bits")


def drop_keys(docs: DataFrame, key: Column, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in gone(key), and with one row for each key in again(key); all columns stay.

    A map of fixed size, broadcast, says which rows may have to go; only their texts are shuffled, to be joined with
    the keys themselves. So the same plan serves every size: what is shuffled are the rows that go and those that
    share their bits, which are few up to some 2**MAP_BITS / 8 keys and in the end all rows.
    """
    if again is not None and again.isEmpty():
        again = None
    names = gone if again is None else gone.unionByName(again)
    names = written(names.select(F.col("key").alias("_row_key")).distinct(), "gone")
    rows = may_be_in(docs, key, names)
    kept = rows.where("NOT _may").unionByName(rows.where("_may").join(names.hint("merge"), "_row_key", "left_anti"))
    if again is not None:
        names = written(again.select(F.col("key").alias("_row_key")).distinct(), "again")
        one = rows.where("_may").dropDuplicates(["_row_key"])  # before the join, so copies are dropped ahead of the shuffle
        kept = kept.unionByName(one.join(names.hint("merge"), "_row_key", "left_semi"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_ones(docs: DataFrame, key: Column, found: DataFrame, label: str) -> DataFrame:
    """docs with the rows that found(key, kept, copies) keeps; where copies, only one of the rows of a key."""
    odd = found.groupBy("key").agg(F.first("kept").alias("kept"), F.first("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    odd = written(odd.where("NOT kept OR (copies AND n > 1)").select("key", "kept"), label)
    return drop_keys(docs, key, odd.where("NOT kept").select("key"), odd.where("kept").select("key"))


def summed(parts: DataFrame, column: str, start: np.ndarray, how) -> np.ndarray:
    """The arrays that tasks give in a binary column, brought together by `how`: in groups first, so SUM_GROUPS reach the
    driver, one at a time. They come from as many tasks: an iterator runs a job for each partition, empty ones too."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = start.copy()
        for x in group[column]:
            total = how(total, np.frombuffer(x, start.dtype).reshape(start.shape))
        return pd.DataFrame({column: [total.tobytes()]})

    total = start.copy()
    grouped = parts.select(column).groupBy(F.pmod(F.xxhash64(column), F.lit(SUM_GROUPS))).applyInPandas(add, f"{column} binary")
    for r in grouped.coalesce(SUM_GROUPS).toLocalIterator():
        total = how(total, np.frombuffer(r[column], start.dtype).reshape(start.shape))
    return total


class WordHash(dict):
    """64-bit hash of a word, remembered; xxhash is stable across workers and machines."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; null and empty give none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def word_hashes(words: list[bytes], seen: WordHash) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def gram_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; order matters."""
    n = len(hashed) - k + 1
    out = mix(hashed[:n] + np.uint64(k))
    for j in range(1, k):
        out = mix(out ^ hashed[j : j + n])
    return out


def shingle_set(text: str | None, k: int, seen: WordHash) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; fewer words: the whole sequence as one; no words: empty.

    64-bit hashes stand for shingles: two different shingles of one document pair agree with probability below 1e-12.
    """
    hashed = word_hashes(words_of(text), seen)
    if not len(hashed):
        return hashed
    return np.unique(gram_hashes(hashed, min(k, len(hashed))))
