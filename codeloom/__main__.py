"""``python -m codeloom scan|query|notify``: an index from the command line."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from .plans.index import scan
from .plans.store import Store
from .plans.tools import Engine
from .plans.upkeep import notify, remember_head


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "query", "notify"):
        c = commands.add_parser(name)
        c.add_argument("root")
        c.add_argument("--index", required=True, help="folder of the index")
        if name == "scan":
            c.add_argument("--json", action="store_true")
        elif name == "query":
            c.add_argument("method")
            c.add_argument("params", nargs="?", default="{}", help="a JSON object")
        else:
            c.add_argument("agent")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    store, now = Store(spark, args.index), dt.datetime.now(dt.timezone.utc).isoformat()
    if args.command == "scan":
        got = scan(store, args.root, now)
        remember_head(store, args.root)
        print(json.dumps(got.as_dict()) if args.json else f"{got.files_indexed} files, {got.symbols} symbols, {got.relations} relations, {got.files_failed} failed, {got.elapsed_seconds} s")
        return 0
    if args.command == "notify":
        notify(store, args.root, args.agent, sys.stdin.read(), now)
        return 0
    print(json.dumps(Engine.of(store, args.root, now).call(args.method, json.loads(args.params))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
