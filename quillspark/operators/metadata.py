"""Structured metadata queries: filters, projections, order, limit and the total."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import Catalog

COLUMNS = ("path", "title", "type", "description", "file_size", "modified_at", "parse_status", "parent_path", "content_hash", "body")
DEFAULT = ("path", "title", "type", "description", "file_size", "modified_at", "parse_status")
EXACT = ("type", "title", "parse_status")
NAME = re.compile(r"[A-Za-z0-9_.-]{1,128}")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise ValidationError(f"invalid field name: {name!r}")
    return name


def parse_filters(pairs: list[str], strict: bool = True) -> dict[str, str]:
    """key=value texts; the first '=' splits. Strictly, a key comes once; else the last one wins."""
    out: dict[str, str] = {}
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq or not key:
            raise ValidationError(f"filter must be key=value: {pair!r}")
        if strict and key in out:
            raise ValidationError(f"duplicate filter: {key}")
        out[key] = value
    return out


def check_filters(filters: dict) -> None:
    for key, value in filters.items():
        check_name(key)
        if key.endswith("_contains") and key != "tags_contains":
            raise ValidationError(f"unsupported filter: {key}")
        if not isinstance(value, str):
            raise ValidationError(f"filter value must be text: {key}")


def filtered(catalog: Catalog, filters: dict[str, str]) -> DataFrame:
    """Documents that meet all filters. Tags and custom values are semi-joins, so no row is doubled; a custom filter
    equals JSON text values only, never numbers or booleans."""
    check_filters(filters)
    docs, tests = catalog.documents, []
    for key in sorted(filters):
        value = filters[key]
        if key in EXACT:
            tests.append(F.col(key) == value)
        elif key == "path_prefix":
            tests.append(F.col("path").startswith(value))
    if tests:
        docs = docs.where(reduce(Column.__and__, tests))
    for key in sorted(filters):
        value = filters[key]
        if key == "tags_contains":
            docs = docs.join(catalog.tags.where(F.col("tag") == value).select("path"), "path", "left_semi")
        elif key not in EXACT and key != "path_prefix":
            same = catalog.custom.where((F.col("key") == key) & (F.col("value") == json.dumps(value, ensure_ascii=False)))
            docs = docs.join(same.select("path"), "path", "left_semi")
    return docs


def query_metadata(catalog: Catalog, filters: dict[str, str] | None = None, select: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(page, totals): the selected columns ordered by path, and total_matches with whether the page is all of it."""
    if limit < 0:
        raise ValidationError("limit must not be negative")
    names = [check_name(n) for n in (select or DEFAULT)]
    docs = filtered(catalog, filters or {})
    totals = docs.agg(F.count(F.lit(1)).alias("total_matches")).withColumn("truncated", F.col("total_matches") > limit)
    page = docs.orderBy("path").limit(limit)
    if "tags" in names:
        tags = catalog.tags.groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        page = page.join(tags, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    for n in dict.fromkeys(names):
        if n not in COLUMNS and n != "tags":
            values = catalog.custom.where(F.col("key") == n).groupBy("path").agg(F.min("value").alias(n))
            page = page.join(values, "path", "left")
    return page.orderBy("path").select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)]), totals
