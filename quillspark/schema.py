"""Tables of a catalog."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

DOCUMENTS = "path string, parent_path string, title string, type string, description string, body string, plain_text string, file_size long, modified_at long, content_hash string, parse_status string, has_front_matter boolean"
TABLES = {
    "documents": DOCUMENTS,
    "tags": "path string, tag string",
    "headings": "path string, level int, title string, anchor string, pos int",
    "links": "src string, dst string, anchor string, external_url string, relation string, pos int",
    "custom": "path string, key string, value string",
    "errors": "path string, stage string, message string, line int",
    "tables": "path string, headers array<string>, rows array<array<string>>, alignments array<string>, pos int",
    "code_blocks": "path string, language string, filename string, content string, pos int",
    "sections": "path string, heading string, level int, content string, pos int",
}
#: The column of each table that names the document that a row belongs to.
OWNER = {name: "src" if name == "links" else "path" for name in TABLES}
VERSION = 4


@dataclass
class Catalog:
    documents: DataFrame
    tags: DataFrame
    headings: DataFrame
    links: DataFrame
    custom: DataFrame
    errors: DataFrame
    tables: DataFrame | None = None
    code_blocks: DataFrame | None = None
    sections: DataFrame | None = None

    def each(self):
        return ((f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None)
