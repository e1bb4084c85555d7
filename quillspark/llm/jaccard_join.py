"""Exact n-gram Jaccard join by size: a heavy-light join.

Two sets of m <= z shingles with similarity t share at least ceil(2*t*m / (1+t)) shingles, c(m) for short. Light sets
(m up to a boundary) are joined by enumerating fixed-size subsets: each gives the hashes of its c(m)-subsets, and so
does any larger set that may be its partner. Heavy sets are joined by scanning inverted lists: a set enters the lists
of its rarest shingles, as many as no similar set can miss all of. The boundary minimises subsets enumerated plus list
entries scanned, estimated from the size histogram and the list lengths of the whole corpus.

Equal sets are one class and joined once. Members of lists are first verified against the pivot that they share most lists with; then only
members that are still in different components meet, in tiles of bounded size. Components are contracted in rounds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, discard, keep_ones, lookup_spread, mix, row_key, shingle_set, summed, written

#: Counters of shingle frequencies by hash: 2**SKETCH_BITS of 32 bits that saturate, so the order of lists costs 4 MB
#: whatever the corpus. At 2e13 shingles a counter holds 2e7 by chance, give or take what a common shingle exceeds by far.
SKETCH_BITS = 20
#: Bits that say which rows' texts are needed; more rows than that cost time, not results.
WANTED_BITS = 23
#: No set larger than this is joined by subsets.
LIGHT_MOST = 40
#: List entries that a task hands on at a time.
ENTRIES = 100_000
#: Members of a list that meet in one tile.
TILE = 512
#: Classes that are verified against one other in one group.
GROUP = 64
#: What rules pairs out: a histogram of BINS counts and PARITIES parity bits of a set's elements. An element that only one
#: of two sets has moves one count by one and flips one bit, so neither distance exceeds the number of such elements.
BINS, PARITIES = 64, 1024
DIGEST_BYTES = BINS + PARITIES // 8
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Similarity:
    """Jaccard threshold num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, s: int, z: int) -> int:
        """Shingles that sets of sizes s and z share at least if they are similar."""
        return -(-self.num * (s + z) // (self.num + self.den))

    def least(self, z: int) -> int:
        """Size of the smallest set that can be similar to a set of size z."""
        return -(-self.num * z // self.den)

    def holds(self, shared: int, s: int, z: int) -> bool:
        return self.den * shared >= self.num * (s + z - shared)

    def prefix(self, s: int) -> int:
        return s - self.least(s) + 1

    def subset_sizes(self, z: int, light: int) -> list[int]:
        """Sizes of the subsets that a set of size z gives, if sets up to light are joined by subsets."""
        return sorted({self.overlap(m, m) for m in range(max(1, self.least(z)), min(z, light) + 1)})

    def subsets(self, z: int, light: int) -> int:
        return sum(math.comb(z, c) for c in self.subset_sizes(z, light))


def class_id(a: np.ndarray) -> int:
    """A set's identity: 63 bits of a hash of all its shingle hashes."""
    return xxhash.xxh3_64_intdigest(a.tobytes(), seed=len(a)) >> 1


def subset_keys(a: np.ndarray, light: int, sim: Similarity) -> np.ndarray:
    """Keys of the set's fixed-size subsets: the sum of mixed elements, less those left out, tagged by size."""
    if sim.least(len(a)) > light:
        return np.zeros(0, np.uint64)
    m = mix(a ^ np.uint64(0x5851F42D4C957F2D))
    whole, out = m.sum(dtype=np.uint64), []
    for c in sim.subset_sizes(len(a), light):
        gone = len(a) - c
        if gone == 0:
            sums = np.array([whole])
        else:
            picks = np.array(list(itertools.combinations(range(len(a)), gone)), np.int64)
            sums = whole - m[picks].sum(axis=1, dtype=np.uint64)
        out.append(mix(sums ^ np.uint64((c * 2 + 1) << 40)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def list_keys(a: np.ndarray, light: int, sim: Similarity, sketch: np.ndarray) -> np.ndarray:
    """The set's rarest shingles by (frequency counter, hash)."""
    if len(a) <= light:
        return np.zeros(0, np.uint64)
    often = sketch[(a & np.uint64(len(sketch) - 1)).astype(np.int64)]
    return a[np.lexsort((a, often))[: sim.prefix(len(a))]]


def set_digest(a: np.ndarray) -> bytes:
    """Counts of elements by their top bits, saturating (which never widens a difference), then parities."""
    bins = np.minimum(np.bincount((a >> np.uint64(58)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)
    odd = np.bincount(((a >> np.uint64(40)) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return bins.tobytes() + np.packbits(odd.astype(bool)).tobytes()


def digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, DIGEST_BYTES)


def may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, sim: Similarity) -> np.ndarray:
    """False only where sizes n, m and digests x, y prove two sets too far apart."""
    most = (sim.den - sim.num) * (n + m)
    ok = np.minimum(n, m) * sim.den >= sim.num * np.maximum(n, m)
    ok &= _ONES[x[:, BINS:] ^ y[:, BINS:]].sum(axis=1, dtype=np.int64) * (sim.num + sim.den) <= most
    return ok & (np.abs(x[:, :BINS].astype(np.int16) - y[:, :BINS]).sum(axis=1, dtype=np.int64) * (sim.num + sim.den) <= most)


def _saturating(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.uint64) + y, 2**32 - 1).astype(np.uint32)


def _row_hash() -> Column:
    """Tells rows of docs(id, text) apart; equal only for repeated rows, but for chance."""
    return F.xxhash64(F.col("id").cast("string"), "text")


def _sets(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """A table of (id, h, cls, n, bins) for all rows (n = 0: no words), and the frequency counters of all shingles."""
    kind, docs = dict(docs.dtypes)["id"], docs.select(F.col("id").cast("string").alias("id"), _row_hash().alias("h"), "text")
    width = 1 << SKETCH_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, sketch = WordHash(), np.zeros(width, np.uint32)
        for b in batches:
            classes, sizes, bins = [], [], []
            for text in b["text"]:  # one set at a time, so a batch's sets are not all held
                a = shingle_set(text, k, seen)
                np.add.at(sketch, (a & np.uint64(width - 1)).astype(np.int64), np.uint32(1))
                classes.append(class_id(a) if len(a) else None)
                sizes.append(len(a))
                bins.append(set_digest(a) if len(a) else None)
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "cls": pd.array(classes, "Int64"), "n": sizes, "bins": bins, "sketch": None})
        if sketch.any():
            yield pd.DataFrame({"id": [None], "h": [0], "cls": pd.array([None], "Int64"), "n": [-1], "bins": [None], "sketch": [sketch.tobytes()]})

    table = written(docs.mapInPandas(run, "id string, h long, cls long, n int, bins binary, sketch binary"), "sets")
    rows = table.where("n >= 0").select(F.col("id").cast(kind).alias("id"), "h", "cls", "n", "bins")
    return rows, summed(table.where("n < 0"), "sketch", np.zeros(width, np.uint32), _saturating)


def light_boundary(sizes: dict[int, int], sketch: np.ndarray, sim: Similarity) -> int:
    """The size up to which subsets cost less than scanning lists."""
    entries = float(sketch.sum())
    noise = entries / len(sketch)
    # mean length of a shingle's list as an entry sees it, above what mere chance puts into one counter
    length = 1 + max(0.0, float((sketch.astype(float) ** 2).sum()) / max(1.0, entries) - noise - 1)
    best, cost_best = 0, math.inf
    for light in range(LIGHT_MOST + 1):
        cost = 0.0
        for z, n in sizes.items():
            if sim.least(z) <= light:
                cost += n * sim.subsets(z, light)
            if z > light:
                cost += n * sim.prefix(z) * min(length, 1000.0)
        if cost < cost_best:
            best, cost_best = light, cost
    return best


def _postings(docs: DataFrame, k: int, light: int, sim: Similarity, sketch: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, done = WordHash(), {}

        def table(keys: list, classes: list, sizes: list) -> pd.DataFrame:
            return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "cls": np.concatenate(classes), "n": np.concatenate(sizes)})

        for b in batches:
            keys, classes, sizes, held = [], [], [], 0
            for text in b["text"]:
                a = shingle_set(text, k, seen)
                if not len(a) or (c := class_id(a)) in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done[c] = True
                own = np.concatenate([subset_keys(a, light, sim), list_keys(a, light, sim, sketch)])
                keys.append(own)
                classes.append(np.full(len(own), c, np.int64))
                sizes.append(np.full(len(own), len(a), np.int32))
                held += len(own)
                if held >= ENTRIES:
                    yield table(keys, classes, sizes)
                    keys, classes, sizes, held = [], [], [], 0
            if classes:
                yield table(keys, classes, sizes)

    return docs.select("text").mapInPandas(run, "key long, cls long, n int")


def _pruned(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) that sizes and digests don't rule out. A class in very many pairs is looked up with salt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ok = may_be_similar(digests(b["bins_a"]), digests(b["bins_b"]), b["n_a"].to_numpy(np.int64), b["n_b"].to_numpy(np.int64), sim)
                yield b.loc[ok, ["a", "b"]]

    own = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("bins").alias(f"bins_{s}"))
    both = lookup_spread(pairs.join(own("b"), "b"), own("a"), ["a"], ["b"], fan=16, how="inner")
    return both.select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInPandas(run, "a long, b long")


def _texts_of(routes: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, packed) of the rows that routes(h) name: their whole texts, compressed, which is far less than their sets.

    A bitmap of fixed size says which rows may be wanted, so no other text is shuffled. A task gives a repeated row once.
    """
    width = 1 << WANTED_BITS

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(width, bool)
        for b in batches:
            bits[b["h"].to_numpy(np.int64) & (width - 1)] = True
        if bits.any():
            yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    packed = summed(routes.select("h").mapInPandas(mark, "bits binary"), "bits", np.zeros(width // 8, np.uint8), np.bitwise_or)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, done, press = np.unpackbits(packed).astype(bool), set(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            own, texts = [], []
            b = b[wanted[b["h"].to_numpy(np.int64) & (width - 1)]]
            for h, text in zip(b["h"], b["text"], strict=True):
                if text and h not in done:
                    if len(done) > 200_000:
                        done.clear()
                    done.add(h)
                    own.append(h)
                    texts.append(press.compress(text.encode("utf-8", "surrogatepass")))
            yield pd.DataFrame({"h": pd.Series(own, dtype="int64"), "packed": texts})

    return docs.select(_row_hash().alias("h"), "text").mapInPandas(pack, "h long, packed binary")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar, as a table.

    The b of one a form groups of GROUP, or of the root of their number where that is more, so that neither a group nor
    the copies of a grow with a's pairs. One row's text of each class goes to its groups, where a's set is built once
    and each b's is held against it as it comes by.
    """
    pairs = written(pairs, "pairs")
    c = F.col("c")
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(c > GROUP).select("a", F.ceil(c / F.greatest(F.lit(float(GROUP)), F.sqrt("c"))).alias("many"))
    dealt = lookup_spread(pairs, hot, ["a"], ["b"]).withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("many", F.lit(1))).cast("int"))
    routes = dealt.select("a", "part", F.explode(F.array("a", "b")).alias("cls")).distinct()
    routes = written(routes.join(classes.select("cls", "h"), "cls"), "routes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, unpack = WordHash(), zstandard.ZstdDecompressor()
        at, pivot = None, np.zeros(0, np.uint64)
        for b in batches:
            links = []
            for a, part, cls, packed in zip(b["a"], b["part"], b["cls"], b["packed"], strict=True):
                own = shingle_set(unpack.decompress(packed).decode("utf-8", "surrogatepass"), k, seen)
                if class_id(own) != cls:
                    continue  # another row of the same hash
                if cls == a:
                    at, pivot = (a, part), own
                elif at == (a, part) and sim.holds(len(np.intersect1d(pivot, own, assume_unique=True)), len(pivot), len(own)):
                    links.append((a, cls))
            yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    met = _texts_of(routes, docs).join(routes, "h").select("a", "part", "cls", "packed")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("cls") != F.col("a"))
    links = written(met.mapInPandas(run, "a long, b long"), "links")
    discard(pairs, routes)
    return links


def _tiled(members: DataFrame, sim: Similarity, single: bool) -> DataFrame:
    """Pairs (a, b) of members(key, cls, n, label, bins, m) of one list that may be similar and differ in label, by tiles.

    single: only the first of each member's pairs in a tile; a list of which that left out pairs is named by a row with
    unsettled, its key in a.

    A list of m members is cut into blocks of TILE by a hash, and every two blocks meet in one tile; a tile holds about
    2 * TILE rows however long the list is.
    """
    many = F.ceil(F.col("m") / F.lit(TILE)).cast("int")
    rows = members.withColumn("many", many).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("many")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "label", "bins")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(cls: np.ndarray, n: np.ndarray, label: np.ndarray, own: np.ndarray | None, bins: np.ndarray) -> tuple[np.ndarray, bool]:
        """The pairs, and whether there are others. own: the members' blocks where two blocks meet, else None."""
        out, others, step = [], False, max(1, 100_000 // len(cls))
        for top in range(0, len(cls), step):  # so many rows of the tile against all later ones
            x, y = np.nonzero(np.arange(top, min(top + step, len(cls)))[:, None] < np.arange(len(cls))[None, :])
            x += top
            keep = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * sim.den >= sim.num * np.maximum(n[x], n[y]))
            if own is not None:
                keep &= own[x] != own[y]
            x, y = x[keep], y[keep]
            if len(x):
                ok = np.flatnonzero(may_be_similar(bins[x], bins[y], n[x], n[y], sim))
                if single:
                    first = np.unique(x[ok], return_index=True)[1]
                    others |= len(first) < len(ok)
                    ok = ok[first]
                out.append(np.sort(np.column_stack([cls[x[ok]], cls[y[ok]]]), axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64), others

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def done(b: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
            """The pairs of all tiles that b holds whole, and the rows of the tile that may go on."""
            tile = b[["key", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(b)) if last else starts[1:]
            cls, label, own, n, bins = b["cls"].to_numpy(), b["label"].to_numpy(), b["own"].to_numpy(), b["n"].to_numpy(np.int64), digests(b["bins"])
            found, unsettled = [np.zeros((0, 2), np.int64)], set()
            for s, e in zip(starts, ends, strict=False):
                if e - s > 1:
                    some, others = pairs(cls[s:e], n[s:e], label[s:e], own[s:e] if tile[s, 1] != tile[s, 2] else None, bins[s:e])
                    found.append(some)
                    if others:
                        unsettled.add(tile[s, 0])
            out = pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"]).assign(unsettled=False)
            if unsettled:
                out = pd.concat([out, pd.DataFrame({"a": np.array(sorted(unsettled), np.int64), "b": 0, "unsettled": True})], ignore_index=True)
            return out, None if last else b.iloc[starts[-1] :]

        for b in batches:
            if len(b):
                out, rest = done(b if rest is None else pd.concat([rest, b], ignore_index=True), False)
                yield out
        if rest is not None:
            yield done(rest, True)[0]

    return rows.mapInPandas(run, "a long, b long, unsettled boolean").distinct()


def _renamed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links(a, b) between labels(node, label), each once, as a table; a node without a label keeps its name."""
    at = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"to_{s}"))
    moved = lookup_spread(links, at("a"), ["a"], ["b"], fan=64, how="left")
    moved = lookup_spread(moved, at("b"), ["b"], ["a"], fan=64, how="left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    return written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node -> label (the smallest node that links reach) for links(a, b), by rounds of hooking and contraction.

    known: what an earlier call gave for other links, which count too; only what the new links join is worked on.

    Each node hooks to its smallest neighbour if that is smaller; pointers are doubled until every tree is flat; links
    are renamed to roots, and those inside a tree vanish. A round at least halves what is left in practice. A node
    with very many links is counted before the shuffle and looked up with salt.
    """
    spark, total = links.sparkSession, known
    left = written(links.where("a <> b").distinct(), "links") if known is None else _renamed(links, known)
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "near")
        parent = both.groupBy("node").agg(F.least(F.min("near"), F.min("node")).alias("label"))
        parent = written(parent, "parents")
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            hop = written(lookup_spread(parent, up, ["label"], ["node"], fan=64, how="inner").select("node", F.col("higher").alias("label"), (F.col("higher") != F.col("label")).alias("moved")), "parents")
            discard(parent)
            parent = hop.select("node", "label")
            if not hop.where("moved").head(1):
                break
        rest = _renamed(left, parent)
        discard(left)
        if total is None:
            total = parent
        else:
            named = parent.select(F.col("node").alias("label"), F.col("label").alias("root"))
            older = lookup_spread(total, named, ["label"], ["node"], fan=64, how="left").select("node", F.coalesce("root", "label").alias("label"))
            total = written(older.unionByName(parent.join(total.select("node"), "node", "left_anti")), "labels")
            discard(parent)
        left = rest
    if total is None:
        total = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))  # no Python rows: they keep workers of their own
    return total


def jaccard_groups(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id that links of similarity >= num / den reach) per row of docs.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing: component_id is their
    own id. Fewer words than k make one shingle. Repeated rows are linked with each other. A null id is no smallest id
    unless its component has no other. An empty table gives an empty result; other columns aren't read.
    """
    sim, spark = Similarity(num, den), docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, sketch = _sets(docs, k)
    sizes = {r["n"]: r["count"] for r in rows.where(F.col("n").between(1, 2 * LIGHT_MOST)).groupBy("n").count().collect()}
    light = light_boundary(sizes, sketch, sim)
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.min("h").alias("h"))
    classes = written(classes, "classes")

    # a list is worth reading where two classes are in it; m counts a class once a task at most, so 2 means two classes.
    # Entries are dealt by key once, sorted once and counted as they come by; a long list spills.
    entries, own = _postings(docs, k, light, sim, sketch), Window.partitionBy("key")
    lists = entries.select("*", F.count(F.lit(1)).over(own).alias("m"), F.min("cls").over(own).alias("pivot"), F.max("cls").over(own).alias("last"))
    members = written(lists.where("pivot <> last").drop("last").dropDuplicates(["key", "cls"]), "members")

    # Lists of two are settled by their pair. Else a class first meets the pivot that it has most lists in common with.
    met = members.where("cls <> pivot").groupBy(F.col("pivot").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("m"))
    best = met.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    best = best.unionByName(met.where("m = 2").select("a", "b")).distinct()
    labels = components(_verified(_pruned(best, classes, sim), classes, docs, k, sim))
    # Lists whose members are not all in one component yet: first each class meets one likely member of another component
    # in each tile, which joins most of what belongs together; then, in lists of which that left out pairs, all pairs
    # that are still apart are settled.
    lists = members.where("m > 2")
    for single in (True, False):
        tagged = lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        tagged = written(tagged.select("key", "cls", "n", "m", "label"), "tagged")
        # lists are told apart by sums of four hashes of 32 bits: 128 bits, so that none is taken for another by chance
        halves = [part for h in (F.xxhash64("cls"), F.xxhash64("cls", F.lit("other"))) for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))]
        prints = [F.sum(p).alias(f"p{i}") for i, p in enumerate(halves)]
        mixed = tagged.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c"), *prints).where("x <> y")
        mixed = mixed.groupBy("x", "y", "c", "p0", "p1", "p2", "p3").agg(F.min("key").alias("key")).select("key")  # of lists with the same members one is read
        open_ = tagged.join(mixed, "key", "left_semi").join(classes.select("cls", "bins"), "cls")
        tiles = written(_tiled(open_, sim, single), "tiles")
        discard(tagged)
        more = _verified(tiles.where("NOT unsettled").select("a", "b"), classes, docs, k, sim)
        if not more.isEmpty():
            labels = components(more, labels)
        unsettled = tiles.where("unsettled").select(F.col("a").alias("key"))
        if unsettled.isEmpty():
            break
        lists = members.join(unsettled, "key", "left_semi")
    discard(members)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = written(named.select("cls", "least", "label"), "named")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = lookup_spread(named.select("cls", "label"), smallest, ["label"], ["cls"], how="inner").select("cls", "component_id")
    out = lookup_spread(rows, answer, ["cls"], ["id"], how="left")
    return out.select(F.col("id").cast(kind).alias("id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one row of each group of near copies, one with the smallest doc_id (null last); all columns stay.

    Rows without words are no copies of each other.
    """
    key = row_key(docs, "text")
    found = jaccard_groups(docs.select(key.alias("doc_id"), "text"), k, num, den)
    found = found.select(F.col("id").alias("key"), (F.col("id") == F.col("component_id")).alias("kept"), (F.col("n_shingles") > 0).alias("copies"))
    return keep_ones(docs, key, found, "near-copies")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    groups = jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)
    return groups.withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
