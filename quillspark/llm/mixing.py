"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt to blocks. A source with weight a/D gives its block j the release time
floor(j*D/a) and the deadline ceil((j+1)*D/a); earliest deadline first among released blocks then serves one block
a slot, and at every slot each source has had its weight times the slots so far, to within less than one block.
The schedule repeats every D slots, so one period is simulated on the driver (D steps, whatever the number of
documents) and every document finds its slot by arithmetic. When a source runs out its share goes to the others in
proportion, and a new period begins there; no document is dropped or repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_spread, written

#: Documents in a block.
BLOCK_DOCS = 16
#: Weight quanta in a period; more where there are many sources.
QUANTA = 4096
#: Without given weights, a source's weight follows its size to this power.
TEMPERATURE = 0.5
#: Rows of a hash range on average, at most, and ranges at least: each range of a source is ranked by itself.
RANGE_ROWS, LEAST_RANGES = 50_000, 4096
#: The schedule is only broadcast up to this size.
BROADCAST_BYTES = 16 << 20


def quanta(weights: dict, total: int) -> dict:
    """Integer shares of total by largest remainder, at least 1 each."""
    names = sorted(weights, key=str)
    whole = sum(weights.values())
    exact = {s: weights[s] / whole * (total - len(names)) for s in names}
    shares = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: total - sum(shares.values())]:
        shares[s] += 1
    return shares


def period(shares: dict, blocks: dict | None = None) -> dict:
    """source -> its slots in one period of sum(shares) slots, or up to the slot that serves the last of a source's blocks."""
    total = sum(shares.values())
    names = sorted(shares, key=str)
    future = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    slots: dict = {s: [] for s in names}
    for t in range(total):
        while future and future[0][0] <= t:
            _, i, j = heapq.heappop(future)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        slots[names[i]].append(t)
        if blocks and len(slots[names[i]]) == blocks[names[i]]:
            break
        if j + 1 < shares[names[i]]:
            heapq.heappush(future, ((j + 1) * total // shares[names[i]], i, j + 1))
    return slots


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """Rows (source, first block, end block, slot of the phase, D, share of D, slots in a period), phase by phase.

    A period is only simulated as far as the phase reaches."""
    left, done, at, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        total = QUANTA
        while total < 16 * len(left):
            total *= 2
        shares = quanta({s: weights[s] for s in left}, total)
        slots = period(shares, left)
        ended = [s for s, n in left.items() if n <= shares[s] and len(slots[s]) == n]  # within the first period
        if ended:
            length = slots[ended[0]][-1] + 1
        else:
            length = min((n - 1) // shares[s] * total + slots[s][(n - 1) % shares[s]] for s, n in left.items()) + 1
        full, rest = divmod(length, total)
        for s in list(left):
            n = full * shares[s] + sum(x < rest for x in slots[s])
            out.append((s, done[s], done[s] + n, at, total, shares[s], slots[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at += length
    return out


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """id, source, block, slot, place (in the block) per row; the mixed order is (slot, place).

    Sources are read in the order of a hash of the identifier. Null is a source of its own. Sources that weights
    doesn't name get its smallest weight; names without rows are ignored. Repeated rows take places of their own.
    An empty table gives an empty result. Only the list of sources with their sizes comes to the driver, and the schedule
    is made there: a period for each source that runs out, so sources are meant to be thousands at most (not hosts).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(id_col), F.lit("mix")).alias("h"))
    out = _placed(written(rows, "mix"), weights, block_docs)
    return out.select(F.col("id").alias(id_col), F.col("source").cast("string").alias("source"), "block", "slot", "place")


def mix_rows(docs: DataFrame, weights: dict | None = None, source_col: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with block, slot and place of each row; all columns stay as they are.

    Where docs has a column of such a name, ours is called block_mix, slot_mix or place_mix. Rows are told apart by all
    their columns, so repeated and null identifiers take places of their own. Else as in mix.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    parts = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    rows = docs.select(whole.alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(*parts, F.lit("mix")).alias("h"))
    taken = {c.lower() for c in docs.columns}
    own = [F.col(c).alias(c if c not in taken else f"{c}_mix") for c in ("block", "slot", "place")]
    return _placed(rows, weights, block_docs).select("id.*", *own)


def _placed(rows: DataFrame, weights: dict | None, block_docs: int) -> DataFrame:
    """rows(id, source, h) with block, slot and place; one shuffle of the rows, by source and range of h."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = rows.select("id", "source", name.alias("name"), "h")
    n = rows.count()
    ranges = max(LEAST_RANGES, 1 << (n // RANGE_ROWS).bit_length())
    rows = rows.withColumn("part", F.pmod(F.shiftright("h", 32), F.lit(ranges)))
    counts = rows.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"))
    sofar = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("name", "part", "n", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("before")), "mix-counts")
    sizes = {r["name"]: r["n"] for r in counts.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    if weights:
        least = min(weights.values())
        share = {s: float(weights.get(s[1:] if s else None, least)) for s in sizes}
    else:
        share = {s: float(n) ** TEMPERATURE for s, n in sizes.items()}
    plan = schedule({s: -(-n // block_docs) for s, n in sizes.items()}, share)
    by_source: dict[str, list] = {}
    for s, *phase in plan:
        by_source.setdefault(s, []).append(tuple(phase))
    phases = "array<struct<first:bigint,end:bigint,base:bigint,total:bigint,share:bigint,slots:array<bigint>>>"
    table = rows.sparkSession.createDataFrame(list(by_source.items()), f"name string, phases {phases}")

    near = Window.partitionBy("name", "part").orderBy("h")
    ranked = rows.withColumn("r", F.row_number().over(near)).join(counts.select("name", "part", "before").hint("merge"), ["name", "part"])  # both are dealt by it
    rank = F.col("before") + F.col("r") - 1
    ranked = ranked.select("id", "source", "name", "h", F.floor(rank / block_docs).alias("block"), (rank % block_docs).cast("long").alias("place"))
    size = 8 * sum(len(p[-1]) for p in plan)
    if size <= BROADCAST_BYTES:
        ranked = ranked.join(F.broadcast(table), "name")
    else:
        ranked = lookup_spread(ranked, table, ["name"], ["h"], how="inner")
    ranked = ranked.withColumn("p", F.expr("filter(phases, x -> x.first <= block AND block < x.end)[0]"))
    slot = F.expr("p.base + (block - p.first) div p.share * p.total + p.slots[cast((block - p.first) % p.share AS int)]")
    return ranked.select("id", "source", "block", slot.cast("long").alias("slot"), "place")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
