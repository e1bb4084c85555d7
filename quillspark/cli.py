"""Command line: python -m quillspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from .config import load_config
from .errors import CatalogError
from .operators.metadata import parse_filters


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("--config")
    p.add_argument("--root", action="append")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a, **k) for a, k in args]
    add("scan")
    add("browse", (("path",), {"nargs": "?", "default": ""}), (("--depth",), {"type": int, "default": 1}), (("--limit",), {"type": int, "default": 100}))
    add("get", (("path",), {}), (("--include",), {"action": "append"}), (("--max-chars",), {"type": int, "default": 12_000}))
    add("section", (("path",), {}), (("heading",), {}), (("--max-chars",), {"type": int, "default": 5000}))
    add("search", (("query",), {}), (("--path-prefix",), {}), (("--type",), {"action": "append", "dest": "types"}), (("--tag",), {"action": "append", "dest": "tags"}), (("--limit",), {"type": int, "default": 20}))
    add("metadata", (("--filter",), {"action": "append", "default": []}), (("--select",), {"action": "append"}), (("--limit",), {"type": int, "default": 100}))
    add("links", (("path",), {}), (("--relation",), {}))
    add("backlinks", (("path",), {}), (("--relation",), {}), (("--limit",), {"type": int, "default": 50}))
    add("traverse", (("path",), {}), (("--depth",), {"type": int, "default": 3}), (("--max-nodes",), {"type": int, "default": 50}), (("--relation",), {"action": "append", "dest": "relations"}))
    add("validate", (("--json",), {"action": "store_true"}))
    add("stats")
    add("export", (("folder",), {}))
    add("watch", (("checkpoint",), {}), (("--events",), {"help": "folder of Parquet files with ts, path, kind; without it, roots are scanned at intervals"}))
    return p


def run(service, args) -> tuple[object, int]:
    match args.command:
        case "scan":
            return service.scan(), 0
        case "browse":
            return service.browse(args.path, args.depth, args.limit), 0
        case "get":
            return service.get_document(args.path, args.include, args.max_chars), 0
        case "section":
            found = service.get_section(args.path, args.heading, args.max_chars)
            return found, 0 if found else 1
        case "search":
            return service.search(args.query, args.limit, path_prefix=args.path_prefix, types=args.types, tags=args.tags), 0
        case "metadata":
            return service.query_metadata(parse_filters(args.filter, strict=False), args.select, args.limit), 0
        case "links":
            return service.get_links(args.path, args.relation), 0
        case "backlinks":
            return service.get_backlinks(args.path, args.relation, args.limit), 0
        case "traverse":
            return service.traverse(args.path, args.depth, args.max_nodes, args.relations), 0
        case "validate":
            found = service.validate_report()
            return found, found["exit_status"]
        case "stats":
            return service.get_stats(), 0
        case "watch":
            events = service.spark.readStream.schema("ts timestamp, path string, kind string").parquet(args.events) if args.events else None
            return service.watch(args.checkpoint, events).awaitTermination(), 0
        case "export":
            return service.export_to_json(args.folder), 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .service import CatalogService

    try:
        config = load_config(args.config, roots=tuple(args.root) if args.root else None, store=args.store)
        service = CatalogService(SparkSession.builder.appName("quillspark").getOrCreate(), config)
        out, status = run(service, args)
    except CatalogError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return status


if __name__ == "__main__":
    sys.exit(main())
