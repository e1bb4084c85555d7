"""Catalog tables on disk: buckets of files, manifests that name them, and a log of commits of which the newest counts."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OWNER, TABLES, VERSION, Catalog

COMMITS, MANIFESTS = "_commits", "_manifests"
#: Buckets of a store, at least, and documents in one when all is written anew.
LEAST_BUCKETS, BUCKET_DOCUMENTS = 256, 4096


class HadoopFolder:
    """Small files of a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self.at(name)
        return fs.exists(path)

    def is_file(self, name: str) -> bool:
        fs, path = self.at(name)
        return fs.exists(path) and fs.getFileStatus(path).isFile()

    def names(self, name: str) -> list[str]:
        fs, path = self.at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def matching(self, glob: str) -> list[str]:
        """Names under the folder that a glob of it matches."""
        fs, path = self.at(glob)
        base = fs.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)).toUri().getPath()
        return sorted(s.getPath().toUri().getPath()[len(base) :].lstrip("/") for s in fs.globStatus(path) or [])

    def text(self, name: str) -> str | None:
        fs, path = self.at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a new file; fails where one of that name is."""
        fs, path = self.at(name)
        stream = fs.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        fs, path = self.at(name)
        fs.delete(path, True)


class SnapshotStore:
    """Readers resolve the newest commit once and see one version whole.

    Tables are cut into buckets by a hash of the document that a row belongs to. A version is a manifest: for each
    table, which folder holds each of its buckets. A commit writes the touched buckets anew and names the other ones
    where they are, so it costs what was touched. It is a numbered file that names a version, made when all of that is
    written; nothing is deleted for it, so whatever write breaks off leaves the last whole commit in force, and readers
    of older versions keep their files. Of two writers with the same number the second fails.

    Versions of older schemas (a folder of whole tables each) are read with null for columns and empty tables for tables
    that they lack; the next commit writes them anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = HadoopFolder(spark, folder)

    def commits(self) -> list[tuple[int, str]]:
        """(number, version) of whole commits, oldest first."""
        named = [(int(n), (self.files.text(f"{COMMITS}/{n}") or "").strip()) for n in self.files.names(COMMITS) if n.isdigit()]
        return [(n, text.removesuffix(".")) for n, text in named if text.endswith(".")]  # the last sign tells that it is whole

    def current(self) -> str | None:
        for n in reversed([x for x in self.files.names(COMMITS) if x.isdigit()]):
            if (text := (self.files.text(f"{COMMITS}/{n}") or "").strip()).endswith("."):
                return text.removesuffix(".")
        return None

    def manifest(self, version: str | None = None) -> dict | None:
        """buckets, tables (name -> bucket -> folder) and extras (name -> folders) of a version; none for older ones."""
        version = version or self.current()
        text = self.files.text(f"{MANIFESTS}/{version}") if version else None
        return json.loads(text) if text else None

    def read(self, buckets: list[int] | None = None) -> Catalog:
        """The current version, or of it only some buckets."""
        version = self.current()
        manifest = self.manifest(version)
        if manifest is None:
            return Catalog(**{name: self._whole_table(version, name, kind) for name, kind in TABLES.items()})
        return Catalog(**{name: self._table(manifest, name, buckets) for name in TABLES})

    def _whole_table(self, version: str | None, name: str, kind: str) -> DataFrame:
        if version is None or not self.files.exists(f"{version}/{name}"):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{version}/{name}")

    def _table(self, manifest: dict, name: str, buckets: list[int] | None) -> DataFrame:
        held = manifest["tables"].get(name, {})
        named = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        folders = [f"{self.folder}/{held[b]}/_bucket={b}" for b in named]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def extra(self, name: str) -> list[str]:
        """Folders of what belongs to the current version beside its tables."""
        return [f"{self.folder}/{f}" for f in (self.manifest() or {}).get("extras", {}).get(name, [])]

    def buckets_of(self, paths: DataFrame) -> list[int]:
        """The buckets that hold the documents of paths(path); a number per bucket comes to the driver, not a path."""
        return sorted(r[0] for r in paths.select(_bucket(F.col("path"), (self.manifest() or {})["buckets"])).distinct().collect())

    def _store(self, catalog: Catalog, buckets: int) -> dict[str, dict[str, str]]:
        """Writes tables by bucket; table -> bucket -> folder of what has rows."""
        out = {}
        for name, table in catalog.each():
            folder = f"data/{name}/{uuid.uuid4().hex}"
            rows = table.select(*[c.split()[0] for c in _columns(TABLES[name])]).withColumn("_bucket", _bucket(F.col(OWNER[name]), buckets))
            rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{folder}")
            out[name] = {n.partition("=")[2]: folder for n in self.files.names(folder) if n.startswith("_bucket=")}
        return out

    def _commit(self, manifest: dict) -> str:
        last = max([int(x) for x in self.files.names(COMMITS) if x.isdigit()], default=0)
        version = f"v{VERSION}-{uuid.uuid4().hex[:12]}"
        self.files.create(f"{MANIFESTS}/{version}", json.dumps(manifest))
        self.files.create(f"{COMMITS}/{last + 1:010d}", f"{version}.")
        return version

    def write(self, catalog: Catalog, **extras: list[str]) -> str:
        """Writes all tables anew and commits them; the number of buckets follows that of the documents."""
        count = catalog.documents.count()
        buckets = max(LEAST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, count / BUCKET_DOCUMENTS)))))
        return self._commit({"buckets": buckets, "tables": self._store(catalog, buckets), "extras": extras})

    def update(self, fresh: Catalog, gone: DataFrame, **extras: list[str]) -> str:
        """Commits the current version without the documents of gone(path) and those that fresh has, and fresh.

        Only the buckets of these documents are read and written; nothing is written of what they do not touch.
        """
        manifest = self.manifest()
        if manifest is None:
            return self.write(replace_documents(self.read(), fresh, gone), **extras)
        touched = gone.select("path").unionByName(fresh.documents.select("path")).distinct()
        hit = self.buckets_of(touched)
        stored = self._store(replace_documents(self.read(hit), fresh, gone), manifest["buckets"]) if hit else {}
        keep = lambda held: {b: f for b, f in held.items() if int(b) not in set(hit)}
        tables = {name: keep(manifest["tables"].get(name, {})) | stored.get(name, {}) for name in TABLES}
        return self._commit({"buckets": manifest["buckets"], "tables": tables, "extras": manifest["extras"] | extras})

    def prune(self, keep: int = 2) -> None:
        """Deletes all versions but those of the last commits, and files that none of these names; nothing else may
        still be read, and nothing be written meanwhile."""
        commits = self.commits()
        for n, version in commits[:-keep]:
            self.files.delete(f"{COMMITS}/{n:010d}")
            self.files.delete(f"{MANIFESTS}/{version}")
            self.files.delete(version)
        kept = [m for _, version in commits[-keep:] if (m := self.manifest(version))]
        named = {(f, b) for m in kept for held in m["tables"].values() for b, f in held.items()}
        for name in self.files.names("data"):
            for one in self.files.names(f"data/{name}"):
                folder = f"data/{name}/{one}"
                for n in self.files.names(folder):
                    if n.startswith("_bucket=") and (folder, n.partition("=")[2]) not in named:
                        self.files.delete(f"{folder}/{n}")
        extras = {f for m in kept for folders in m["extras"].values() for f in folders}
        for name in self.files.names("extras"):
            for one in self.files.names(f"extras/{name}"):
                if f"extras/{name}/{one}" not in extras:
                    self.files.delete(f"extras/{name}/{one}")


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _columns(kind: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(kind):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(kind[start:i].strip())
            start = i + 1
    return [*out, kind[start:].strip()]


def replace_documents(old: Catalog, fresh: Catalog, gone: DataFrame) -> Catalog:
    """old without the documents of `gone(path)` and those that fresh has, and fresh: children go with their document."""
    out = {}
    touched = gone.select("path").unionByName(fresh.documents.select("path")).distinct()
    new = dict(fresh.each())
    for name, table in old.each():
        left = table.join(touched.withColumnRenamed("path", OWNER[name]), OWNER[name], "left_anti")
        out[name] = left.unionByName(new[name].select(*left.columns)) if name in new else left
    return Catalog(**out)


def export_json(catalog: Catalog) -> DataFrame:
    """path and one JSON text per document with tags, headings, custom values and links nested."""
    listed = lambda t, key, alias, *cols: t.groupBy(F.col(key).alias("path")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(alias))
    docs = catalog.documents.drop("plain_text")
    for part in (
        catalog.tags.groupBy("path").agg(F.sort_array(F.collect_list("tag")).alias("tags")),
        listed(catalog.headings, "path", "headings", "pos", "level", "title", "anchor"),
        catalog.custom.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("custom")),
        listed(catalog.links, "src", "links", "pos", "dst", "anchor", "external_url", "relation"),
    ):
        docs = docs.join(part, "path", "left")
    return docs.select("path", F.to_json(F.struct("*")).alias("document"))
