"""The best k documents of a query without reading all of its postings.

A stored index sorts a term's postings into steps of like count and document length, and says of each step how many
postings it has and what none of them exceeds: counts by field, and the least length. So a step's score is bounded before it is read. Two
passes: the steps of highest bounds give k documents whose scores so far no k-th best score is below; then only steps are
read whose bound, with the best of all other terms, reaches that. A document of a step that is left out cannot be among
the best k, so the scores of those that can are whole, and the page is that of scoring everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from .ftsquery import parse_query
from .search import WEIGHTS, Index, _part, score_query
from .tokens import FIELDS


@dataclass
class Page:
    rows: DataFrame  # path, score: the best first
    read: int  # postings of the steps that were read
    held: int  # postings of the query's terms


def _plain(phrases: list, tree: tuple) -> str | None:
    """"and" or "or" for queries of plain terms joined by that alone."""
    if any(len(p.terms) != 1 or p.prefix or p.first or p.near > 0 or set(p.fields) != set(FIELDS) for p in phrases):
        return None
    kinds = set()

    def walk(t: tuple) -> None:
        if t[0] != "p":
            kinds.add(t[0])
            walk(t[1])
            walk(t[2])

    walk(tree)
    return "or" if not kinds else kinds.pop() if len(kinds) == 1 and kinds <= {"and", "or"} else None


def top_k(index: Index, text: str, k: int = 20, weights: dict | None = None, k1: float = 1.2, b: float = 0.75) -> Page:
    """The first k rows of score_query by score, then path; scores equal to nine decimals are ties. Terms joined by AND or OR are read by steps of impact; for
    phrases, prefixes, fields, NEAR and NOT, and without a stored index, every match is scored."""
    weights = weights or WEIGHTS
    phrases, tree = parse_query(text, stem if index.stem else lambda t: t)
    kind = _plain(phrases, tree) if index.postings is not None else None
    terms = [p.terms[0] for p in phrases]
    if kind is None or not terms or len(set(terms)) < len(terms) or k1 < 0 or min(weights.values()) < 0:
        rows = score_query(index, text, weights, k1, b).orderBy(F.desc(F.round("score", 9)), "path").limit(k)
        return Page(rows, -1, -1)
    known = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(*terms)).collect()}
    n, avgdl = index.totals.select("n", "avgdl").head()
    idf = {}
    for t in terms:
        value = math.log((n - known.get(t, 0) + 0.5) / (known.get(t, 0) + 0.5))
        idf[t] = value if value > 0 else 1e-6
    worth = lambda: reduce(Column.__add__, [F.col(f"in_{f}") * F.lit(float(weights.get(f, 0.0))) for f in FIELDS])
    own_idf = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, float(idf[t]))]), F.col("term"))
    part = own_idf * worth() * (k1 + 1) / (worth() + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    # the same formula over the largest counts and the least length of a step bounds it; a hundred steps a term or so
    steps = index.bounds.where(F.col("term").isin(*terms)).groupBy("term", "impact").agg(F.sum("n").alias("n"), F.min("dl").alias("dl"), *[F.max(f"in_{f}").alias(f"in_{f}") for f in FIELDS])
    steps = sorted(((r["bound"], r["term"], r["impact"], r["n"]) for r in steps.select("term", "impact", "n", part.alias("bound")).collect()), reverse=True)
    held = sum(s[3] for s in steps)
    best = {t: max((s[0] for s in steps if s[1] == t), default=0.0) for t in terms}

    def scored(chosen: list[tuple]) -> DataFrame:
        by_term = {t: sorted(s[2] for s in chosen if s[1] == t) for t in terms}
        rows = index.postings.where(F.lit(False))
        if chosen:
            folders = reduce(Column.__or__, [F.col("part") == _part(F.lit(t)) for t, levels in by_term.items() if levels])
            rows = index.postings.where(folders & reduce(Column.__or__, [(F.col("term") == t) & F.col("impact").isin(*levels) for t, levels in by_term.items() if levels]))
        got = rows.select("path", part.alias("s")).groupBy("path").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("c"))
        return got.where(F.col("c") == len(terms)).drop("c") if kind == "and" else got.drop("c")

    first, count = [], dict.fromkeys(terms, 0)
    for s in steps:  # for each term the best steps, until they hold a few times k postings
        if count[s[1]] < 4 * k:
            first.append(s)
            count[s[1]] += s[3]
    if len(first) < len(steps):
        found = [r[0] for r in scored(first).select("score").orderBy(F.desc("score")).limit(k).collect()]
        least = found[-1] * (1 - 1e-9) if len(found) == k else 0.0
        first = [s for s in steps if s[0] + sum(v for t, v in best.items() if t != s[1]) >= least]
    rows = scored(first).orderBy(F.desc(F.round("score", 9)), "path").limit(k)
    return Page(rows, sum(s[3] for s in first), held)
