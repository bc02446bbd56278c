"""python -m arborix demo | eval | benchmark --fixture F --gold G [--output O] | serve --folder D"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile

from pyspark.sql import SparkSession

from . import benchmark
from .engine import Engine
from .server import served


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="arborix")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("demo").add_argument("--folder", help="where tables are kept; a temporary folder if none is named")
    commands.add_parser("eval")
    bench = commands.add_parser("benchmark")
    for name in ("--fixture", "--gold"):
        bench.add_argument(name, required=True)
    bench.add_argument("--output", help="a file that must not be there yet")
    commands.add_parser("serve").add_argument("--folder", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("arborix").getOrCreate()
    if args.command == "serve":
        for line in served(Engine(spark, args.folder), sys.stdin):
            print(line, flush=True)
        return
    if args.command == "demo":
        out = benchmark.demo(spark, args.folder or tempfile.mkdtemp())
    elif args.command == "eval":
        out = benchmark.evaluate(spark)
    else:
        out = benchmark.run_benchmark(spark, args.fixture, args.gold)
    text = json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)
    if getattr(args, "output", None):
        with open(args.output, "x", encoding="utf-8") as f:
            f.write(text + "\n")
    print(text)


if __name__ == "__main__":
    main()
