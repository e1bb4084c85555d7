"""Hierarchical browsing, listings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Catalog


def subdirectories(catalog: Catalog, folder: str = "", depth: int = 1, limit: int = 100) -> DataFrame:
    """Folders with documents below `folder`, at most depth + 1 segments further down; none at depth 0."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    dirs = catalog.documents.where((F.col("parent_path") != folder.strip("/")) & F.col("parent_path").startswith(prefix)).select("parent_path").distinct()
    rest = F.size(F.split(F.col("parent_path").substr(F.lit(len(prefix) + 1), F.length("parent_path")), "/"))
    return dirs.where((rest <= depth + 1) & F.lit(depth > 0)).orderBy("parent_path").limit(limit)


def documents_in(catalog: Catalog, folder: str = "", limit: int = 100) -> DataFrame:
    return catalog.documents.where(F.col("parent_path") == folder.strip("/")).orderBy("path").limit(limit)


def index_document(folder: str) -> str | None:
    return f"{folder.strip('/')}/index.md" if folder.strip("/") else None


def browse(catalog: Catalog, folder: str = "", depth: int = 1, limit: int = 100) -> dict:
    dirs = [r[0] for r in subdirectories(catalog, folder, depth, limit).collect()]
    docs = documents_in(catalog, folder, limit).select("path", "title", "type", "description").collect()
    return {"path": folder, "directories": dirs, "documents": [r.asDict() for r in docs], "index_document": index_document(folder), "truncated": len(dirs) + len(docs) > limit}


def list_documents(catalog: Catalog, prefix: str = "", limit: int = 0) -> DataFrame:
    return catalog.documents.where(F.col("path").startswith(prefix)).orderBy("path").limit(limit)


def recently_modified(catalog: Catalog, limit: int = 20) -> DataFrame:
    return catalog.documents.orderBy(F.desc("modified_at"), "path").limit(limit)


def stats(catalog: Catalog) -> DataFrame:
    """One row: documents, those that didn't parse cleanly, links, headings, recorded errors."""
    one = catalog.documents.agg(F.count(F.lit(1)).alias("document_count"), F.count_if(F.col("parse_status") != "ok").alias("error_count"))
    for table, name in ((catalog.links, "link_count"), (catalog.headings, "heading_count"), (catalog.errors, "scan_error_count")):
        one = one.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one
