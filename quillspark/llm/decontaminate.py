"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A stretch of WINDOW characters of a benchmark item that occurs in a document with at most e edits shares at least
WINDOW - q + 1 - q*e character q-grams with it, and these lie on at most e + 1 neighbouring diagonals. Documents are
scanned once against an index of the items' q-grams; shared q-grams are counted in overlapping diagonal bands;
regions that reach the bound are verified by a banded edit-distance alignment.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_keys, lookup_spread, row_key, written

Q = 10
#: Characters of an item that must be found again (all of a shorter item, if it has LEAST at least).
WINDOW = 100
LEAST = 40
#: Edits allowed in a stretch, as a share of its length.
EDITS = 0.06
#: Item characters in one index; a larger benchmark is taken block by block against all documents.
BLOCK_CHARS = 4 << 20
#: Document characters scanned at a time, and their overlap beside the longest item.
PIECE = 1 << 20
FILTER_BITS = 22
SPACES = re.compile(r"\s+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return SPACES.sub(" ", text.lower()).strip() if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def q_hashes(points: np.ndarray) -> np.ndarray:
    n = len(points) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(Q):
        out = (out + points[j : j + n] + np.uint64(1)) * _MULTIPLIER
        if j % 4 == 3:
            out ^= out >> np.uint64(29)
    return out ^ (out >> np.uint64(32))


class Index:
    """q-grams of the items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, code_points(t)) for i, text in items if len(t := normal(text)) >= LEAST]
        hashes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, p) in enumerate(self.items):
            h = q_hashes(p)
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.keys, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        self.longest = max([0, *(len(p) for _, p in self.items)])
        size = np.array([min(WINDOW, len(p)) for _, p in self.items], np.int64)
        self.window, self.edits = size, (size * EDITS).astype(np.int64)
        self.bound = np.maximum(1, size - Q + 1 - Q * self.edits)

    def seeds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the document, diagonal) of each shared q-gram."""
        h = q_hashes(points)
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        none = np.zeros(0, np.int64)
        if not len(at) or not len(self.keys):
            return none, none, none
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        many = self.many[k]
        doc = np.repeat(at, many)
        slot = np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return self.owner[slot], doc, doc - self.place[slot]

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, band's first diagonal, document place of the first seed) of regions that meet the bound."""
        item, doc, diagonal = self.seeds(points)
        if not len(item):
            return []
        enough = np.bincount(item, minlength=len(self.items)) >= self.bound
        keep = enough[item]
        item, doc, diagonal = item[keep], doc[keep], diagonal[keep]
        if not len(item):
            return []
        step = self.edits[item] + 1
        band = diagonal // step
        item, doc, band = np.concatenate([item, item]), np.concatenate([doc, doc]), np.concatenate([band, band - 1])
        order = np.lexsort((doc, band, item))
        item, doc, band = item[order], doc[order], band[order]
        new = np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (doc[1:] != doc[:-1]))
        item, doc, band = item[new], doc[new], band[new]
        last = np.arange(len(item)) + self.bound[item] - 1
        inside = last < len(item)
        i, last = np.flatnonzero(inside), last[inside]
        near = (item[last] == item[i]) & (band[last] == band[i]) & (doc[last] - doc[i] <= self.window[item[i]] + self.edits[item[i]] - Q)
        i = i[near]
        return list(zip(item[i].tolist(), (band[i] * (self.edits[item[i]] + 1)).tolist(), doc[i].tolist(), strict=True))

    def verify(self, points: np.ndarray, item: int, diagonal: int, start: int) -> tuple[int, int, int] | None:
        """(edits, start, end in the document) of the best stretch near the region, if it is within the budget.

        All stretches of the item that can hold the region's first q-gram are aligned at once; column k of the band
        is diagonal + k - e, the start in the document is free, and rows are the stretch's characters.
        """
        p, w, e = self.items[item][1], int(self.window[item]), int(self.edits[item])
        low = max(0, start - diagonal - w - 2 * e)
        begins = np.arange(low, min(len(p) - w, start - diagonal + 2 * e) + 1)
        if not len(begins):
            return None
        width = 4 * e + 3
        shift = np.arange(width) - e
        origin = begins[:, None] + diagonal + shift[None, :]
        cost = np.zeros((len(begins), width), np.int32)
        ramp = np.arange(width, dtype=np.int32)
        for r in range(w):
            at = origin + r
            ok = (at >= 0) & (at < len(points))
            differs = np.where(ok, points[np.clip(at, 0, len(points) - 1)] != p[begins + r][:, None], True)
            step = cost + differs
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
        best = np.unravel_index(int(cost.argmin()), cost.shape)
        if cost[best] > e:
            return None
        end = int(origin[best] + w)
        return int(cost[best]), max(0, end - w), min(len(points), end)

    def leaks(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item id -> (edits, start, end in the normalised text) for each item that is found in the text."""
        points, out = code_points(text), {}
        overlap = self.longest + WINDOW
        for begin in range(0, max(1, len(points)), PIECE):
            piece = points[begin : begin + PIECE + overlap]
            for item, diagonal, start in self.regions(piece):
                name = self.items[item][0]
                if name not in out and (found := self.verify(piece, item, diagonal, start)):
                    out[name] = (found[0], found[1] + begin, found[2] + begin)
        return out


def _blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in order of their identifier; those of one identifier stay together."""
    block, size = [], 0
    for r in bench.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        if size >= BLOCK_CHARS and r[0] != block[-1][0]:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1] or "")
    if block:
        yield block


def _scanner(block: list[tuple[int, str]], only_hits: bool):
    """A map that puts n_items and items in the place of text."""
    index = Index(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [index.leaks(normal(t)) for t in b["text"]]
            items = [",".join(f"{i}:{e}:{s}:{z}" for i, (e, s, z) in sorted(x.items(), key=lambda y: (y[0] is not None, y[0]))) for x in found]
            out = b.drop(columns="text").assign(n_items=[len(x) for x in found], items=items)
            yield out[out["n_items"] > 0] if only_hits else out

    return run


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of docs: id, contaminated, n_items, items ("item:edits:start:end" by item, joined by commas).

    Text is lower-cased and its white space runs are one space; offsets count code points of that form. Null and
    empty texts, and items of fewer than LEAST characters, are never part of a leak. Items that share an identifier (null
    too, which comes first) count as one. Repeated rows are answered each. Empty tables: nothing is contaminated. One map
    over the documents per block of the benchmark, one block at a time on the driver.
    """
    kind = dict(docs.dtypes)[id_col]
    prints = F.concat(*[F.hex(F.xxhash64(F.lit(seed), F.col(text_col).isNull(), F.col(text_col))) for seed in ("one", "two")])
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(bench, item_col, "text")
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        whole = slim.mapInPandas(_scanner(first, False), "id string, n_items long, items string")
    else:  # an answer depends on the text alone
        marked, parts = docs.select(prints.alias("print"), F.col(text_col).alias("text")), []
        for n, block in enumerate(itertools.chain([first, second], blocks)):
            hits = written(marked.mapInPandas(_scanner(block, True), "print string, n_items long, items string"), "leaks")
            parts.append(hits.dropDuplicates(["print"]).withColumn("block", F.lit(n)))
        found = functools.reduce(DataFrame.unionByName, parts).groupBy("print")
        found = found.agg(F.sum("n_items").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "items"))), lambda x: x["items"]), ",").alias("items"))
        rows = docs.select(F.col(id_col).cast("string").alias("id"), prints.alias("print"))
        whole = lookup_spread(rows, found, ["print"], ["id"]).select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))
    return whole.select(F.col("id").cast(kind).alias("id"), (F.col("n_items") > 0).alias("contaminated"), "n_items", "items")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage; all columns stay."""
    key = row_key(docs, "text")
    return drop_keys(docs, key, find_leaks(docs.select(key.alias("doc_id"), "text"), bench).where("contaminated").select(F.col("id").alias("key")))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")
