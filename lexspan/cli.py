"""python -m lexspan.cli STORE ROOT... -- index | search TEXT | read KEY | list [DIR] | status"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .config import Settings
from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexspan")
    p.add_argument("store")
    p.add_argument("--root", action="append", default=[])
    p.add_argument("--settings")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--full", action="store_true")
    index.add_argument("--only", action="append")
    find = sub.add_parser("search")
    find.add_argument("text")
    find.add_argument("--limit", type=int)
    find.add_argument("--dir")
    find.add_argument("--ext")
    find.add_argument("--days", type=float)
    read = sub.add_parser("read")
    read.add_argument("key")
    read.add_argument("--offset", type=int, default=0)
    read.add_argument("--limit", type=int, default=4000)
    ls = sub.add_parser("list")
    ls.add_argument("dir", nargs="?", default="")
    ls.add_argument("--depth", type=int, default=1)
    ls.add_argument("--filter", default="")
    sub.add_parser("status")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexspan").getOrCreate()
    engine = Engine(spark, a.store, Settings.load(a.settings, {"roots": a.root} if a.root else {}))
    show = lambda rows: print("\n".join(json.dumps(r.asDict(), ensure_ascii=False, default=str) for r in rows))
    if a.command == "index":
        print(json.dumps(engine.sync(a.full, a.only), ensure_ascii=False))
    elif a.command == "search":
        show(engine.search(a.text, a.limit, dir=a.dir, ext=a.ext, days=a.days).collect())
    elif a.command == "read":
        show(engine.read(a.key, a.offset, a.limit).collect())
    elif a.command == "list":
        for part in engine.list(a.dir, a.depth, a.filter):
            show(part.collect())
    else:
        print(json.dumps(engine.status(), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
