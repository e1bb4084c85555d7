"""Files to catalog tables: discovery, decoding, parsing in Arrow batches, link resolution as columns and one join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import ParseError
from ..functions import paths
from ..functions.text import content_hash
from ..schema import Catalog
from . import markdown
from .frontmatter import read_yaml, split_front_matter, too_large
from .snapshot import HadoopFolder

ERROR = "array<struct<stage:string,message:string,line:int>>"
PARSED = (
    f"path string, body string, plain_text string, title string, type string, description string, tags array<string>, custom map<string,string>, parse_status string, errors {ERROR}, has_front_matter boolean, "
    "headings array<struct<level:int,title:string,anchor:string,pos:int>>, sections array<struct<heading:string,level:int,content:string,pos:int>>, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>,alignments:array<string>,pos:int>>, code_blocks array<struct<language:string,filename:string,content:string,pos:int>>, "
    "md_links array<string>, typed_links array<struct<target:string,relation:string,anchor:string>>"
)

#: What a file's row keeps beside what is parsed; as text in Python, where numbers beside nulls would be rounded.
META = ("size", "modified_at", "content_hash")


def discover(spark: SparkSession, root: str, config: Config, named: list[str] | None = None) -> DataFrame:
    """path (relative to root), size, modified_at (seconds), content of the Markdown files that neither the settings nor
    a .gitignore of the root or a folder below exclude; with named, of those among these paths that exist, without listing the rest."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
    if named is None:
        files = files.option("recursiveFileLookup", "true").load(root)
    else:
        folder = HadoopFolder(spark, base)
        there = [f"{base}/{p}" for p in named if folder.is_file(p)]
        files = files.load([re.sub(r"([{}\[\]*?\\,])", r"\\\1", p) for p in there]) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    at = F.length(F.lit(base.split(":", 1)[-1])) + 1
    raw = paths.percent_decode(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""))
    files = files.select(raw.substr(at + 1, F.length("path")).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_at"), "content")
    for p in config.exclude_patterns:
        files = files.where(~F.col("path").rlike(paths.glob_pattern(p)))
    deepest = folder_depth(files) if named is None else max((p.count("/") for p in named), default=0)
    if rules := ignore_rules(spark, root, deepest):
        files = files.where(~paths.gitignored(F.col("path"), rules))
    return files


def ignore_rules(spark: SparkSession, root: str, depth: int = 0) -> list[tuple[str, bool]]:
    """The rules of all .gitignore files in folders down to depth, those above first."""
    folder, out = HadoopFolder(spark, root), []
    for d in range(depth + 1):
        for name in folder.matching("*/" * d + ".gitignore"):
            out += paths.ignore_rules(folder.text(name), name.rpartition("/")[0])
    return out


def folder_depth(files: DataFrame) -> int:
    """How many folders the deepest of files(path) lies in."""
    return files.agg(F.max(F.size(F.split("path", "/")) - 1)).head()[0] or 0


def _read_front(text: str, config: Config) -> tuple[dict | None, str, list[dict]]:
    """The front matter, the body and the errors of a text."""
    front, body = None, text
    try:
        if found := split_front_matter(text, config.max_front_matter_size):
            body = found[1]
            front = read_yaml(found[0], config.max_yaml_input_size)
    except ParseError as e:
        return front, body, [{"stage": e.stage, "message": e.message, "line": e.line}]
    return front, body, []


def front_errors(head: str | None, size: float, config: Config) -> list[dict]:
    """The errors of a front matter, of which head is None where its size alone rules it out."""
    if head is None:
        e = too_large(config.max_front_matter_size, int(size))
        return [{"stage": e.stage, "message": e.message, "line": e.line}]
    return _read_front(head, config)[2]


def bad_file(stage: str) -> list[dict]:
    return [{"stage": stage, "message": "file is too large" if stage == "size" else "file is not valid UTF-8", "line": None}]


def parse_text(path: str, text: str, config: Config) -> dict:
    """One document's record; errors lower its status and never stop the others."""
    front, body, errors = _read_front(text, config)
    body = body.lstrip()
    record = markdown.parse(body)
    front = front or {}
    return {
        "path": path, "body": body, "title": front.get("title"), "type": front.get("type"), "description": front.get("description"),
        "tags": front.get("tags", []), "custom": front.get("custom", {}), "parse_status": "partial" if errors else "ok", "errors": errors,
        "has_front_matter": bool(front) or bool(errors), "md_links": record.pop("links"), "typed_links": front.get("typed_links", []),
    } | record


def parse_files(files: DataFrame, config: Config) -> DataFrame:
    """files(path, size, modified_at, content) -> one wide row per file, PARSED plus sizes, times and hash."""
    names = [c.split()[0] for c in PARSED.split(", ") if " " in c]
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    fits = F.col("size") <= config.max_file_size
    text = F.when(fits & valid, F.col("content").cast("string"))
    bad = F.when(~fits, F.lit("size")).when(~valid, F.lit("utf8"))
    slim = files.select("path", text.alias("text"), bad.alias("bad"), F.col("size").cast("string").alias("size"), F.col("modified_at").cast("string").alias("modified_at"), content_hash(F.col("content")).alias("content_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text, bad in zip(b["path"], b["text"], b["bad"], strict=True):
                record = parse_text(path, text or "", config)
                if bad:
                    record |= {"parse_status": "failed", "errors": bad_file(bad)}
                out.append(record)
            yield pd.DataFrame(out, columns=names).assign(**{c: b[c].to_numpy() for c in META})

    parsed = slim.mapInPandas(run, PARSED + "".join(f", {c} string" for c in META))
    return parsed.withColumns({c: F.col(c).cast("long") for c in META[:2]})


def read_errors(files: DataFrame, config: Config) -> DataFrame:
    """path, stage, message, line: the errors that parse_files finds, for checks of files whose contents nobody asks for.

    All of them come from sizes, encoding and front matter, so bodies stay in Spark and no Markdown is read: Python gets the
    beginning of a file in which split_front_matter finds what it finds in all of it, or the size of front matter that is
    too large. Each step is a projection of its own, so that Spark makes what several columns use once.
    """
    fits = F.col("size") <= config.max_file_size
    slim = files.select("path", fits.alias("fits"), F.when(fits, F.col("content").cast("string")).alias("text"))
    slim = slim.select("path", "fits", "text", F.is_valid_utf8("text").alias("valid"))
    bad = F.when(~F.col("fits"), F.lit("size")).when(~F.col("valid"), F.lit("utf8"))
    bare = F.when(F.col("text").startswith("\ufeff"), F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    slim = slim.select("path", bad.alias("bad"), F.when(F.col("valid"), bare).alias("bare"))
    opened = F.col("bare").startswith("---") & (F.length(F.substring("bare", 1, 6)) == 6)
    short = F.col("bare").startswith("------")
    slim = slim.select("path", "bad", "bare", F.when(opened & ~short, F.locate("\n---", F.col("bare"), 4)).when(opened, 0).alias("end"))  # null: no front matter
    found = F.when(F.col("end") > 0, F.substring(F.col("bare"), F.lit(1), F.col("end") + 3)).when(F.col("end") == 0, F.substring("bare", 1, 6))
    slim = slim.select("path", "bad", found.alias("found"), F.when(F.col("end") > 0, F.octet_length(found).cast("long") - 7).alias("front"))  # less two marks and a line break
    most = config.max_front_matter_size
    slim = slim.select("path", "bad", F.when(F.coalesce("front", F.lit(0)) <= most, F.col("found")).alias("head"), F.when(F.col("front") > most, F.col("front")).alias("front"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, bad, head, size in zip(b["path"], b["bad"], b["head"], b["front"].astype(float), strict=True):
                errors = bad_file(bad) if bad else front_errors(head, size, config) if head or size > 0 else []
                out += [(path, e["stage"], e["message"], e["line"]) for e in errors]
            yield pd.DataFrame(out, columns=["path", "stage", "message", "line"]).astype({"line": "Int32"})  # numbers beside nulls

    return slim.mapInPandas(run, "path string, stage string, message string, line int")


def edges(parsed: DataFrame) -> DataFrame:
    """Markdown and wiki links resolved, then typed links (a leading slash means the root)."""
    own = F.posexplode("md_links").alias("pos", "target")
    md = parsed.select(F.col("path").alias("src"), own)
    resolved = paths.resolve_link(F.col("src"), F.col("target"))
    external = paths.is_external(F.col("target"))
    base, anchor = F.substring_index("r", "#", 1), F.when(F.locate("#", F.col("r")) > 0, F.expr("substring(r, locate('#', r) + 1)"))
    md = md.withColumn("r", resolved).select(
        "src", F.when(~external, base).alias("dst"), F.when(~external, anchor).alias("anchor"), F.when(external, F.col("target")).alias("external_url"), F.lit(None).cast("string").alias("relation"), (F.col("pos") + 1).alias("pos")
    )
    typed = parsed.select(F.col("path").alias("src"), F.size("md_links").alias("n"), F.posexplode("typed_links").alias("pos", "t"))
    typed = typed.select("src", F.regexp_replace("t.target", "^/+", "").alias("dst"), F.col("t.anchor").alias("anchor"), F.lit(None).cast("string").alias("external_url"), F.col("t.relation").alias("relation"), (F.col("n") + F.col("pos") + 1).alias("pos"))
    return md.unionByName(typed)


def with_existence(links: DataFrame, documents: DataFrame) -> DataFrame:
    """exists: whether the target is a document now (external links always do); never stored, so never stale."""
    known = documents.select(F.col("path").alias("dst"), F.lit(True).alias("_known"))
    return links.join(known, "dst", "left").withColumn("exists", F.col("external_url").isNotNull() | F.coalesce("_known", F.lit(False))).drop("_known")


def to_catalog(parsed: DataFrame) -> Catalog:
    nested = lambda column: parsed.select("path", F.explode(column).alias("x")).select("path", "x.*")
    documents = parsed.select("path", paths.parent_path(F.col("path")).alias("parent_path"), "title", "type", "description", "body", "plain_text", F.col("size").alias("file_size"), "modified_at", "content_hash", "parse_status", "has_front_matter")
    return Catalog(
        documents=documents,
        tags=parsed.select("path", F.explode("tags").alias("tag")),
        headings=nested("headings"),
        links=edges(parsed),
        custom=parsed.select("path", F.explode("custom").alias("key", "value")),
        errors=nested("errors"),
        tables=nested("tables"),
        code_blocks=nested("code_blocks"),
        sections=nested("sections"),
    )
