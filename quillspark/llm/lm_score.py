"""Stupid-backoff language-model scores, computed relationally.

Each task packs its documents into blocks, compressed. A block explodes its texts into 1- to 3-grams and sends every
distinct n-gram with its count once to the n-gram's hash partition (two packed columns, sorted, not a row an n-gram); the
partition merges the count tables of all blocks and answers each block with the corpus counts in the order in which it
asked. The block then looks its n-grams up, leaves each document's own occurrences out, and sums log scores per document.
A frequent n-gram enters a partition once a block, so frequency causes no skew; blocks are filled in the order of rows,
so repeated and null identifiers cause none either.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, gram_hashes, word_hashes, words_of, written

ORDER = 3
#: What a step down to a shorter n-gram costs.
BACKOFF = 0.4
#: Characters of text in a block and of corpus per hash partition, at least.
BLOCK_CHARS = 6_000_000
#: Keys that a message from a block to a partition holds on average, at least.
MESSAGE_KEYS = 50
LEAST_PARTS = 12
PACKED = "block long, ids array<string>, sizes binary, texts binary"
ASKED = "block long, part int, keys binary, counts binary"


def block_chars(chars: float) -> int:
    """Blocks times partitions is the number of messages; with blocks as the root of the corpus it grows as the corpus.

    A text gives about a key for 3 characters. 6 million characters up to 240 GB of text, 120 million at 100 TB.
    """
    return max(BLOCK_CHARS, int(math.sqrt(3 * MESSAGE_KEYS * chars)))


def packed_texts(texts: list[str | None]) -> tuple[bytes, bytes]:
    """Bytes of each text (null: 0), and all of them compressed together."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.array([len(x) for x in raw], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def unpacked_texts(sizes: bytes, texts: bytes) -> list[str]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(texts)
    return [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *ends], ends, strict=False)]


def pack_blocks(docs: DataFrame, chars: int) -> DataFrame:
    """docs(id string, text) as a row per block of about so many characters; a longer text is a block of its own.

    Blocks are numbered by partition and place in it, so a task that is run again makes the same ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b["id"], b["text"], strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 8
                if size >= chars:
                    yield pd.DataFrame([(block, ids, *packed_texts(texts))], columns=["block", "ids", "sizes", "texts"])
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield pd.DataFrame([(block, ids, *packed_texts(texts))], columns=["block", "ids", "sizes", "texts"])

    return docs.mapInPandas(run, PACKED)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit n-gram keys [order, token] (of the n-gram that ends there), which of them exist, token counts."""
    seen = WordHash()
    hashed = [word_hashes(words_of(t), seen) for t in texts]
    lengths = np.array([len(h) for h in hashed], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *hashed])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = np.zeros((ORDER, len(flat)), np.uint64)
    for n in range(1, ORDER + 1):
        if len(flat) >= n:
            keys[n - 1, n - 1 :] = gram_hashes(flat, n)
    return keys, place >= np.arange(ORDER)[:, None], lengths


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin."""
    return np.flatnonzero(np.append(len(x) > 0, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _edges(parts: int) -> np.ndarray:
    """Smallest key of each hash partition."""
    return np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)


def packed_keys(keys: np.ndarray, low: int) -> bytes:
    """Sorted distinct keys as differences, byte plane by byte plane; only the highest plane is worth compressing."""
    gaps = np.diff(np.concatenate([np.array([low], np.uint64), keys]))
    wide = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + len(keys).to_bytes(4, "little") + planes[: wide - 1].tobytes() + zlib.compress(planes[wide - 1].tobytes(), 1)


def unpacked_keys(data: bytes, low: int) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:5], "little")
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : wide - 1] = np.frombuffer(data, np.uint8, n * (wide - 1), 5).reshape(wide - 1, n).T
    planes[:, wide - 1] = np.frombuffer(zlib.decompress(data[5 + n * (wide - 1) :]), np.uint8)
    return np.cumsum(planes.view(np.uint64)[:, 0], dtype=np.uint64) + np.uint64(low)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as a byte each, those from 255 on in full behind."""
    small = zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)
    return len(small).to_bytes(4, "little") + small + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    counts = np.frombuffer(zlib.decompress(data[4 : 4 + n]), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[4 + n :], np.int64)
    return counts


def score_block(keys: np.ndarray, real: np.ndarray, lengths: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
    """n_tokens, logsum without the corpus size, and how many tokens fell to the unigram level.

    totals are the corpus counts of the block's distinct keys, in their order.
    """
    owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key, doc = keys[real], np.tile(owner, (ORDER, 1))[real]
    order = np.argsort(key, kind="stable")  # an n-gram's documents stay in their order
    first = _runs(key[order])
    start = np.union1d(first, _runs(doc[order]))
    spread = lambda starts, values: np.repeat(values, np.diff(np.append(starts, len(order))))
    rest = spread(first, totals) - spread(start, np.diff(np.append(start, len(order))))
    left = np.zeros((ORDER, len(owner)), np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = rest
    left[real] = back
    one, two, three = left
    before = lambda x: np.append(np.zeros(min(1, len(x)), np.int64), x[:-1])
    top = np.minimum(place, ORDER - 1)  # steps down from the longest n-gram that the place allows
    safe = lambda a, b: np.log(np.maximum(a, 1)) - np.log(np.maximum(b, 1))
    # a context's own count, without this document, is at least that of the n-grams that begin with it
    log3, log2, log1 = safe(three, before(two)), safe(two, before(one)), np.log(np.maximum(one, 1))
    use3, use2 = (place >= 2) & (three > 0), (place >= 1) & (two > 0)
    use2 &= ~use3
    low = ~use3 & ~use2
    step = np.log(BACKOFF)
    score = np.where(use3, log3, np.where(use2, log2 + step * (top - 1), log1 + step * top))
    total = lambda x: np.bincount(owner.astype(np.int64), weights=x, minlength=len(lengths))
    return pd.DataFrame({"n_tokens": lengths, "logsum": total(score), "low": total(low).astype(np.int64)})


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_score (natural log, summed), mean_log_score per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Counts come from all rows but the scored one: with N tokens
    in all others, a trigram scores c3/c2, else 0.4 times the bigram's c2/c1, else 0.4 times c1/N, and a word that no
    other row has counts as one occurrence. Null and empty texts: 0 tokens, score 0, mean null. Repeated rows see each
    other. An empty table gives an empty result; other columns aren't read. A document is one task's unit, so its tokens
    must fit a worker (about 100 bytes each).
    """
    kind = dict(docs.dtypes)[id_col]
    chars = docs.select(F.sum(F.length(text_col).cast("double"))).head()[0] or 0
    size = block_chars(chars)
    edges = _edges(max(LEAST_PARTS, int(chars // size) + 1))
    blocks = pack_blocks(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), size)

    def ask(block: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, real, _ = _grams(unpacked_texts(group["sizes"][0], group["texts"][0]))
        keys = np.sort(keys[real])
        first = _runs(keys)
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        ends = np.append(np.searchsorted(keys, edges), len(keys))
        out = [(int(block[0]), p, packed_keys(keys[i:j], edges[p]), packed_counts(counts[i:j])) for p, (i, j) in enumerate(itertools.pairwise(ends)) if j > i]
        return pd.DataFrame(out, columns=["block", "part", "keys", "counts"])

    def answer(part: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked_keys(x, edges[part[0]]) for x in group["keys"]]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat)
        first = _runs(flat[order])
        del flat
        counts = np.concatenate([unpacked_counts(x) for x in group["counts"]])
        sums = np.add.reduceat(counts[order], first)
        counts[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        return pd.DataFrame({"block": group["block"], "part": group["part"], "totals": [packed_counts(t) for t in np.split(counts, ends)]})

    def look_up(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, real, lengths = _grams(unpacked_texts(group["sizes"][0], group["texts"][0]))
        totals = np.concatenate([np.zeros(0, np.int64), *map(unpacked_counts, answers.sort_values("part")["totals"])])
        out = score_block(keys, real, lengths, totals)
        out.insert(0, "id", group["ids"][0])
        return out

    answers = blocks.groupBy("block").applyInPandas(ask, ASKED).groupBy("part").applyInPandas(answer, "block long, part int, totals binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(look_up, "id string, n_tokens long, logsum double, low long")
    scored = written(scored, "lm")
    n = scored.agg(F.sum("n_tokens")).head()[0] or 0
    rest = F.greatest(F.lit(n) - F.col("n_tokens"), F.lit(1)).cast("double")
    score = F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.col("logsum") - F.col("low") * F.log(rest))
    scored = scored.select(F.col("id").cast(kind).alias("id"), "n_tokens", score.alias("log_score"))
    return scored.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    scores = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select(F.col("id").alias("doc_id"), "n_tokens", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i-1] END AS b, CASE WHEN i > 2 THEN w[i-2] END AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, c IS NOT NULL AS has3, b IS NOT NULL AS has2,
  CASE WHEN c IS NOT NULL THEN count(*) OVER (PARTITION BY c, b, a) - count(*) OVER (PARTITION BY doc_id, c, b, a) ELSE 0 END AS c3,
  CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, a) - count(*) OVER (PARTITION BY doc_id, b, a) ELSE 0 END AS c2,
  count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS c1,
  count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM t),
x AS (SELECT *, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1 FROM k),
s AS (SELECT doc_id, sum(CASE WHEN has3 AND c3 > 0 THEN ln(c3) - ln(greatest(p2, 1))
   WHEN has2 AND c2 > 0 THEN ln(c2) - ln(greatest(p1, 1)) + ln(0.4) * has3::INT
   ELSE ln(greatest(c1, 1)) - ln(greatest(n, 1)) + ln(0.4) * (has3::INT + has2::INT) END) AS z FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_tokens, round(coalesce(z, 0), 3) AS log_score, CASE WHEN len(w) > 0 THEN round(z / len(w), 5) END AS mean_log_score
FROM d LEFT JOIN s USING (doc_id)
"""
