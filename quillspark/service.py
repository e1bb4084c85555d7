"""The library's face: one object over a snapshot store."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import browse, document, graph, metadata, search, validate
from .operators.changes import detect_changes, summarize
from .schema import Catalog
from .sources.ingest import discover, folder_depth, ignore_rules, parse_files, to_catalog, with_existence
from .sources.snapshot import SnapshotStore, export_json, replace_documents
from .streaming import watch


#: Files that are opened by name when they have changed.
MOST_NAMED = 2000


class CatalogService:
    def __init__(self, spark: SparkSession, config: Config, store: str | None = None):
        self.spark, self.config = spark, config
        self.store = SnapshotStore(spark, store or config.store)
        self._catalog: Catalog | None = None
        self._index: search.Index | None = None

    @property
    def catalog(self) -> Catalog:
        if self._catalog is None:
            self._catalog, self._index = self.store.read(), None
        return self._catalog

    @property
    def index(self) -> search.Index:
        """The index stored with the current snapshot; built in memory for snapshots that have none."""
        if self._index is None:
            catalog = self.catalog
            if segments := self._segments():
                self._index = search.read_index(self.spark, segments, self.config.stem)
            else:
                self._index = search.build_index(search.searchable(catalog), self.config.stem)
        return self._index

    def _segments(self) -> list[str]:
        """The folders of the stored index; none where it was written in an older form, so that it is built anew."""
        held = self.store.extra(self._index_name)
        return held if all(self.store.files.exists(f"{f.removeprefix(f'{self.store.folder}/')}/entries") for f in held) else []

    @property
    def _index_name(self) -> str:
        return "index_stemmed" if self.config.stem else "index_plain"

    def _discovered(self, named: list[str] | None = None):
        files = None
        for root in self.config.roots:
            one = discover(self.spark, root, self.config, named)
            files = one if files is None else files.unionByName(one)
        return files

    def scan(self) -> dict:
        """Reads what is new or changed since the current snapshot, and commits a new one."""
        return self._apply(self._discovered(), None)

    def apply_paths(self, paths) -> dict:
        """Brings the documents of paths(path) up to date, as a scan of these alone; others stay as they are."""
        return self._apply(self._discovered().join(paths, "path", "left_semi"), paths)

    def _files_of(self, files, paths):
        """files of paths(path). Up to MOST_NAMED paths are opened by name; beyond, the roots are read and joined."""
        named = [r[0] for r in paths.limit(MOST_NAMED + 1).collect()]
        if len(named) > MOST_NAMED:
            return files.join(paths, "path", "left_semi")
        return self._discovered(named)

    def _apply(self, files, paths) -> dict:
        began = time.time()
        old = self.catalog
        now = files.select("path", F.col("size").alias("file_size"), "modified_at")  # a listing: contents are not read
        known = old.documents if paths is None else old.documents.join(paths, "path", "left_semi")
        changes = detect_changes(now, known).cache()
        touched = changes.where(F.col("change").isin("added", "modified")).select("path")
        gone = changes.where("change = 'deleted'").select("path")
        parsed = parse_files(self._files_of(files, touched), self.config).persist()
        fresh = to_catalog(parsed)
        try:
            if not changes.where("change <> 'unchanged'").isEmpty() or self.store.manifest() is None:
                self.store.update(fresh, gone, **{self._index_name: self._indexed(old, fresh, gone, touched)})
                self._catalog = self._index = None
            out = summarize(changes, fresh.documents, with_existence(fresh.links, self.catalog.documents)).head().asDict()
        finally:
            parsed.unpersist()
            changes.unpersist()
        return out | {"seconds": time.time() - began}

    def _indexed(self, old: Catalog, fresh: Catalog, gone, touched) -> list[str]:
        """The segments of the index that follow the change: one more, or fewer where some were due to be merged."""
        prefix, stem = f"extras/{self._index_name}", self.config.stem
        held = [f.removeprefix(f"{self.store.folder}/") for f in self._segments()]
        name = lambda rows: f"{prefix}/{rows}-{uuid.uuid4().hex}"
        at = lambda folder: f"{self.store.folder}/{folder}"
        rows_in = lambda folder: max(1, self.spark.read.parquet(f"{at(folder)}/docs").count())
        if not held:
            one = name(0)
            search.write_index(search.build_index(search.searchable(replace_documents(old, fresh, gone)), stem), at(one))
            return [one]
        before = self.store.read(self.store.buckets_of(gone.unionByName(touched)))
        before = search.searchable(before).join(gone.unionByName(touched), "path", "left_semi")
        one = name(1)
        search.add_segment(self.spark, at(one), search.searchable(fresh), gone, before, stem)
        held.append(one)
        if k := search.tail_to_merge([rows_in(f) for f in held]):
            one = name(k)
            search.merge_segments(self.spark, [at(f) for f in held[-k:]], at(one), k == len(held))
            held[-k:] = [one]
        return held

    def watch(self, checkpoint: str, events=None, available_now: bool = False, every: float = 1.0, poll_seconds: float | None = None):
        """Scans once, then keeps the catalog up to date: paths of a stream of events(ts, path, kind), or without one of
        a listing every poll_seconds, are applied once nothing has changed for the debounce time. Beside either, all is
        scanned anew every so often (the reconcile time)."""
        self.scan()
        c = self.config
        # as far as folders go now; what is ignored further down is left out when it is read
        rules = [r for root in c.roots for r in ignore_rules(self.spark, root, folder_depth(self.catalog.documents))]
        listing = None if events is not None else lambda: self._discovered().select("path", "size", "modified_at")
        known = lambda: self.catalog.documents.select("path", F.col("file_size").alias("size"), "modified_at")
        return watch.watch(
            events, lambda df, _: self.apply_paths(df), checkpoint, c.exclude_patterns, rules, c.debounce_ms / 1000, available_now=available_now, every=every,
            listing=listing, known=known, poll_seconds=poll_seconds, reconcile=None if available_now else self.scan, reconcile_seconds=c.reconcile_seconds, spark=self.spark,
        )

    def browse(self, folder: str = "", depth: int = 1, limit: int = 100) -> dict:
        return browse.browse(self.catalog, folder, depth, limit)

    def document_exists(self, path: str) -> bool:
        return bool(self.catalog.documents.where(F.col("path") == path).head(1))

    def get_document(self, path: str, include: list[str] | None = None, max_chars: int = 12_000) -> dict:
        return document.get_document(self.catalog, path, include, max_chars, self.config.max_response_chars)

    def get_section(self, path: str, heading: str, max_chars: int = 5000) -> dict | None:
        row = document.find_sections(self.catalog, self.spark.createDataFrame([(path, heading)], "path string, heading string"), max_chars).head()
        return row.asDict() if row else None

    def get_recently_modified(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in browse.recently_modified(self.catalog, limit).select("path", "title", "type", "modified_at").collect()]

    def get_links(self, path: str, relation: str | None = None) -> list[dict]:
        return [r.asDict() for r in graph.forward(self.catalog, path, relation).collect()]

    def get_backlinks(self, path: str, relation: str | None = None, limit: int = 50) -> list[dict]:
        return [r.asDict() for r in graph.backward(self.catalog, path, relation, limit).collect()]

    def traverse(self, path: str, depth: int = 3, max_nodes: int = 50, relations: list[str] | None = None) -> dict:
        depth, max_nodes = min(depth, self.config.max_graph_depth), min(max_nodes, self.config.max_graph_nodes)
        nodes, edges = graph.traverse(self.catalog, self.spark.createDataFrame([(path,)], "path string"), depth, max_nodes, relations)
        found = [r.asDict() for r in nodes.drop("start").orderBy("depth", "path").collect()]
        return {"nodes": found, "edges": [r.asDict() for r in edges.drop("start").orderBy("source", "target", "label").collect()], "truncated": len(found) >= max_nodes}

    def search(self, query: str, limit: int = 20, **filters) -> dict:
        c = self.config
        return search.search(self.catalog, self.index, query, limit, **({"max_headings": c.max_headings, "heading_depth": c.heading_depth} | filters), weights=c.weights, k1=c.k1, b=c.b)

    def query_metadata(self, filters: dict | None = None, select: list[str] | None = None, limit: int = 100) -> dict:
        page, totals = metadata.query_metadata(self.catalog, filters, select, limit)
        return {"results": [r.asDict() for r in page.collect()]} | totals.head().asDict()

    def validate(self):
        return validate.validate(self.catalog, self.config.require_index_files)

    def validate_report(self, limit: int = 10_000) -> dict:
        """The checks' counts, and the first issues by path; `validate` has all of them as a table."""
        issues = self.validate().cache()
        found = [r.asDict() for r in issues.orderBy("path", "category", "message").limit(limit + 1).collect()]
        return {"issues": found[:limit], "truncated": len(found) > limit, "checks": [r.asDict() for r in validate.report(issues).orderBy("check").collect()], "exit_status": validate.exit_status(issues)}

    def get_stats(self) -> dict:
        return browse.stats(self.catalog).head().asDict()

    def export_to_json(self, folder: str) -> None:
        export_json(self.catalog).select("document").write.text(folder)
