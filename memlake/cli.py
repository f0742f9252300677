"""Command line: ``python -m memlake.cli ROOT COMMAND ...``; output is JSON lines."""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .apps.codesearch import LANGUAGES, CodeIndex
from .apps.memory import TIERS, Memory, Tools
from .apps.service import server
from .functions.jsonfilter import compile_filter
from .sources import ndjson
from .sources.store import Database
from .types import MemError


def _show(x) -> None:
    for r in x.toLocalIterator() if isinstance(x, DataFrame) else [x]:
        print(json.dumps(r.asDict(recursive=True) if hasattr(r, "asDict") else r, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="memlake")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, (kind, default) in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind, "default": default}))

    add("info")
    add("collections")
    add("stats", "collection")
    add("search", "collection", "vector", k=(int, 10), filter=(str, None))
    add("get", "collection", "id")
    add("compact", "collection")
    add("export", "collection", "path")
    add("import", "collection", "path", dimensions=(int, None), metric=(str, "cosine"))
    add("validate")
    add("remember", "content", tier=(str, "session"), ttl=(float, None))
    add("recall", "query", k=(int, 5), threshold=(float, 0.3), tier=(str, None))
    add("forget", "query", threshold=(float, 0.8), dry_run=(bool, False))
    add("memory-stats")
    add("cleanup")
    add("clear", tier=(str, None))
    add("index", "folder", languages=(str, None))
    add("code-stats")
    add("serve", host=(str, "127.0.0.1"), port=(int, 8080))
    add("tools")
    add("shell")
    add("code-search", "query", k=(int, 10), threshold=(float, 0.0))
    add("languages")
    return p


def shell(spark: SparkSession, root: str, lines: Iterable[str]) -> None:
    """Commands, one to a line, until ``quit`` or the end; errors are shown and the rest goes on."""
    for line in lines:
        words = shlex.split(line)
        if words[:1] in (["quit"], ["exit"]):
            return
        if words and words[0] != "shell":
            try:
                run(spark, [root, *words])
            except SystemExit:  # a line that can't be parsed
                pass


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    db = Database(spark, a.root)
    memory = lambda: Memory(db)
    tiers = [a.tier] if getattr(a, "tier", None) else None
    try:
        match a.command:
            case "info":
                _show({"root": a.root, "collections": len(db.collections()), "tiers": TIERS})
            case "collections":
                _show(db.listing())
            case "stats":
                _show(db.get_collection(a.collection).stats())
            case "search":
                where = compile_filter(json.loads(a.filter), dialect="cli") if a.filter else None
                _show(db.get_collection(a.collection).search([float(x) for x in a.vector.split(",")], a.k, where))
            case "get":
                rows = db.get_collection(a.collection).get(a.id).collect()
                _show(rows[0] if rows else {"error": "not found"})
                return 0 if rows else 1
            case "compact":
                _show(db.get_collection(a.collection).compact())
            case "export":
                _show({"exported": ndjson.export(db.get_collection(a.collection), a.path)})
            case "import":
                c = db.collection(a.collection, a.dimensions, a.metric) if a.dimensions else db.get_collection(a.collection)
                _show(ndjson.import_file(c, a.path))
            case "validate":
                _show(db.validate())
            case "remember":
                _show({"id": memory().remember(a.content, a.tier, a.ttl)})
            case "recall":
                _show(memory().recall(a.query, a.k, a.threshold, tiers))
            case "forget":
                _show({"forgotten": memory().forget(a.query, a.threshold, dry_run=a.dry_run)})
            case "memory-stats":
                _show(memory().stats())
            case "cleanup":
                _show({"removed": memory().cleanup_expired()})
            case "clear":
                memory().clear(tiers)
            case "index":
                _show(CodeIndex(db).index(a.folder, a.languages.split(",") if a.languages else None))
            case "code-stats":
                _show(CodeIndex(db).stats())
            case "serve":
                server(db, a.host, a.port).serve_forever()
            case "tools":
                Tools(memory()).serve(sys.stdin, sys.stdout)
            case "shell":
                shell(spark, a.root, sys.stdin)
            case "code-search":
                _show(CodeIndex(db).search(a.query, a.k, a.threshold))
            case "languages":
                _show(LANGUAGES)
    except (MemError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
