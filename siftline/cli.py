"""Command line: index, search, status, delete, click, config and serve over one collection."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from siftline.collection import Collection
from siftline.config import load
from siftline.errors import BadQuery, SiftlineError
from siftline.functions.text import parse_timestamp
from siftline.operators.search import Filters


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description="Index and search collections of text and code.")
    p.add_argument("--folder", default=os.environ.get("SIFTLINE_FOLDER", "siftline-data"), help="where the collection lies")
    p.add_argument("--config-file", default=os.environ.get("SIFTLINE_CONFIG"), help="a TOML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="index a tree of files")
    a.add_argument("path")
    a.add_argument("--name")
    a.add_argument("--tags")
    a.add_argument("--model")
    a.add_argument("--force", action="store_true")
    a.add_argument("--no-ignore", action="store_true")
    a = sub.add_parser("search", help="search what is indexed")
    a.add_argument("query")
    a.add_argument("--codebase")
    a.add_argument("-n", "--limit", type=int)
    a.add_argument("--vector-only", action="store_true")
    a.add_argument("-l", "--language")
    a.add_argument("--file-type")
    a.add_argument("--after")
    a.add_argument("--author")
    a.add_argument("--imports")
    a.add_argument("--fuzzy", action=argparse.BooleanOptionalAction)
    a.add_argument("--no-learning", action="store_true")
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("status", help="what is indexed")
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("delete", help="remove a codebase")
    a.add_argument("codebase")
    a = sub.add_parser("click", help="say that a result was used")
    a.add_argument("query")
    a.add_argument("chunk", type=int)
    a.add_argument("rank", type=int)
    a.add_argument("--codebase")
    sub.add_parser("config", help="show the settings in force")
    sub.add_parser("serve", help="answer JSON-RPC requests, one a line, on standard input")
    return p


def epoch(spark, text: str | None) -> int | None:
    if text is None:
        return None
    value = spark.createDataFrame([(text,)], "t string").select(parse_timestamp("t").alias("t")).first().t
    if value is None:
        raise BadQuery(f"no time: {text}")
    return value


def run(args: argparse.Namespace, spark=None, out=None) -> int:
    out = out or sys.stdout
    say = lambda *x: print(*x, file=out)
    config = load(args.config_file)
    if args.command == "config":
        say(json.dumps(dataclasses.asdict(config), indent=2))
        return 0
    if spark is None:
        from siftline.session import local_session

        spark = local_session()
        spark.sparkContext.setLogLevel("ERROR")
    c = Collection(spark, args.folder, config)
    if args.command == "index":
        say(json.dumps(c.index(os.path.abspath(args.path), args.name, args.model, args.tags, args.force, not args.no_ignore)))
    elif args.command == "search":
        filters = Filters(args.language, args.author, args.file_type, epoch(spark, args.after), args.imports)
        rows = c.search(args.query, args.codebase, args.limit, None if filters == Filters() else filters, args.vector_only, args.fuzzy, not args.no_learning)
        if args.json:
            say(json.dumps(rows))
        for r in () if args.json else rows:
            say(f"{r['rank']}. {r['codebase']} {r['file_path']}:{r['lines']} {r['score']} ({r['id']})")
    elif args.command == "status":
        rows = [r.asDict() for r in c.status().collect()]  # one row a codebase
        if args.json:
            say(json.dumps(rows))
        for r in () if args.json else rows:
            say(f"{r['name']} {r['codebase_id']} {r['path']} {r['files']} files, {r['chunks']} chunks")
    elif args.command == "delete":
        say(f"{c.delete(args.codebase)} chunks removed")
    elif args.command == "click":
        c.click(args.query, args.chunk, args.rank, args.codebase)
    elif args.command == "serve":
        from siftline.server import serve

        serve(c, sys.stdin, out)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except SiftlineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
