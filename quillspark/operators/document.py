"""Point lookups: a document with its parts, sections, outlines, response budgets, not-found hints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound, ValidationError
from ..functions.distance import osa_column
from ..functions.text import slugify, truncated
from ..schema import Catalog
from ..sources.ingest import with_existence

INCLUDES = ("metadata", "custom", "headings", "links", "backlinks", "body", "errors", "sections")
MOST_HINTS, MOST_EDITS = 4, 3


def backlinks(catalog: Catalog, path: str) -> DataFrame:
    """Links to a document from documents, in the order of source and anchor."""
    found = catalog.links.where(F.col("dst") == path).join(catalog.documents.select(F.col("path").alias("src"), F.col("title").alias("source_title")), "src")
    return found.select(F.col("src").alias("source_path"), "source_title", "anchor", "relation").orderBy("source_path", "anchor", "relation")


def forward_links(catalog: Catalog, path: str) -> DataFrame:
    found = with_existence(catalog.links.where(F.col("src") == path), catalog.documents)
    return found.orderBy(F.coalesce("dst", "external_url"), F.coalesce("anchor", F.lit("")), "pos").select("dst", "anchor", "external_url", "exists", "relation")


def outline(catalog: Catalog, depth: int, n: int) -> DataFrame:
    """path, outline: the first n headings of level up to depth, in order."""
    some = catalog.headings.where(F.col("level") <= depth).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("h"))
    return some.select("path", F.transform(F.slice("h", 1, n), lambda h: h["title"]).alias("outline") if n > 0 else F.array().cast("array<string>").alias("outline"))


def get_document(catalog: Catalog, path: str, include: list[str] | None = None, max_chars: int = 12_000, budget: int = 500_000) -> dict:
    """A document as a dict; raises NotFound with hints. Errors are always included."""
    include = list(include or ())
    for x in include:
        if x not in INCLUDES:
            raise ValidationError(f"unknown include: {x}")
    row = catalog.documents.where(F.col("path") == path).head()
    if row is None:
        raise NotFound(path, suggest_paths(catalog, path))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out = {k: row[k] for k in ("path", "title", "type", "description", "parse_status", "file_size", "modified_at", "content_hash")}
    if "body" in include:
        body = row["body"] or ""
        out |= {"body": body[:max_chars], "body_truncated": len(body) > max_chars}
    if "metadata" in include:
        out["tags"] = [r[0] for r in catalog.tags.where(F.col("path") == path).select("tag").distinct().orderBy("tag").collect()]
    if {"metadata", "custom"} & set(include):
        out["custom"] = {r["key"]: json.loads(r["value"]) for r in catalog.custom.where(F.col("path") == path).orderBy("key").collect()}
    if "headings" in include:
        out["headings"] = rows(catalog.headings.where(F.col("path") == path).orderBy("pos").select("level", "title", "anchor"))
    if "sections" in include and catalog.sections is not None:
        out["sections"] = rows(catalog.sections.where(F.col("path") == path).orderBy("pos").select("heading", "level", "content"))
    out["errors"] = rows(catalog.errors.where(F.col("path") == path).select("stage", "message", "line"))
    if "links" in include:
        out["links"] = rows(forward_links(catalog, path))
    if "backlinks" in include:
        out["backlinks"] = rows(backlinks(catalog, path))
    return fit_budget(out, budget)


def fit_budget(out: dict, most: int) -> dict:
    """The response within so many characters: parts are cut from their tails, then the longest body that fits."""
    size = lambda: len(json.dumps(out, ensure_ascii=False, default=str))
    if size() <= most:
        return out
    body = out.pop("body", None)
    out["response_truncated"] = True
    if body is not None:
        out |= {"body": "", "body_truncated": True}
    for part in ("backlinks", "links", "headings", "sections", "errors", "custom"):
        while out.get(part) and size() > most:
            out[part].popitem() if isinstance(out[part], dict) else out[part].pop()
    if body is not None:
        low, high = 0, len(body)
        while low < high:
            out["body"] = body[: (low + high + 1) // 2]
            low, high = (len(out["body"]), high) if size() <= most else (low, len(out["body"]) - 1)
        out["body"] = body[:low]
    return out


def find_sections(catalog: Catalog, queries: DataFrame, max_chars: int = 5000) -> DataFrame:
    """For queries(path, heading): the section by title without case, else by slug, else by prefix; first in order."""
    s, q = catalog.sections, queries.select("path", F.col("heading").alias("query"))
    both = s.join(q, "path")
    rank = F.when(F.lower("heading") == F.lower("query"), 1).when(slugify(F.col("heading")) == slugify(F.col("query")), 2).when(F.lower("heading").startswith(F.lower("query")), 3)
    best = both.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("path", "query").agg(F.min(F.struct("rank", "pos", "heading", "level", "content")).alias("x"))
    text, more = truncated(F.col("x.content"), max_chars)
    return best.select("path", "query", "x.heading", "x.level", text.alias("content"), more.alias("truncated"))


def unsafe_query(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    return not path or "://" in path or path[0] in "/\\" or path[1:2] == ":" or path[1:4].lower() == "%3a" or any(p in (".", "..") for p in parts)


def suggestions(catalog: Catalog, path: str) -> DataFrame:
    """Paths within MOST_EDITS edits (a swap is one), nearest first; a length band and a cheap distance come before the
    Python distance."""
    n = len(path)
    near = catalog.documents.select("path").where(F.length("path").between(n - MOST_EDITS, n + MOST_EDITS) & (F.col("path") != path))
    near = near.where(F.levenshtein("path", F.lit(path), 2 * MOST_EDITS) >= 0)
    near = near.withColumn("distance", osa_column(path, MOST_EDITS)("path")).where(F.col("distance") <= MOST_EDITS)
    return near.orderBy("distance", "path").limit(MOST_HINTS)


def suggest_paths(catalog: Catalog, path: str) -> list[str]:
    return [] if unsafe_query(path) else [r["path"] for r in suggestions(catalog, path).collect()]
