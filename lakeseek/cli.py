"""Command line: build, inspect and drop indexes, augment a query table."""

from __future__ import annotations

import argparse
import sys

from lakeseek import __version__


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeseek")
    p.add_argument("--version", action="version", version=f"lakeseek {__version__}")
    p.add_argument("--root", default=None, help="folder of the indexes")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index").add_subparsers(dest="action", required=True)
    build = index.add_parser("build", help="index a lake")
    build.add_argument("name")
    build.add_argument("path")
    build.add_argument("--workers", type=int, default=4)
    build.add_argument("--max-cols", type=int, default=100)
    build.add_argument("--prune", action="store_true")
    build.add_argument("--update-support", action="store_true")
    build.add_argument("--category-indicators", action="store_true")
    stats = index.add_parser("stats")
    stats.add_argument("name")
    stats.add_argument("--tables", action="store_true")
    drop = index.add_parser("drop")
    drop.add_argument("name")
    drop.add_argument("--yes", action="store_true")
    a = sub.add_parser("augment", help="augment a CSV file from the lake")
    a.add_argument("index_name")
    a.add_argument("query")
    a.add_argument("--key", required=True)
    a.add_argument("--target", required=True)
    a.add_argument("--task", choices=["classification", "regression"], default="classification")
    a.add_argument("--top-k", type=int, default=20)
    a.add_argument("--metric")
    a.add_argument("--tol", type=float)
    a.add_argument("--corr-threshold", type=float)
    a.add_argument("--no-pruning", action="store_true")
    a.add_argument("--budget-seconds", type=float)
    a.add_argument("--raw", action="store_true", help="the file is prepared already")
    a.add_argument("-o", "--output")
    sub.add_parser("info", help="what can be chosen")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "info":
        from lakeseek.plans import registry
        from lakeseek.plans.config import SEARCHES

        for r in (registry.models, registry.strategies, registry.augmenters):
            print(f"{r.kind}s: {', '.join(r.names())}")
        print(f"tasks: {', '.join(SEARCHES)}")
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lakeseek.operators.prepare import prepare_query_table
    from lakeseek.plans.api import Augmenter
    from lakeseek.plans.config import EngineConfig
    from lakeseek.plans.index import LakeIndex

    spark = spark or SparkSession.builder.appName("lakeseek").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    index = LakeIndex(spark, args.name if args.command == "index" else args.index_name, EngineConfig.resolve(args.root))
    if args.command == "index" and args.action == "build":
        done = index.build(args.path, args.workers, args.max_cols, prune=args.prune, shares=args.category_indicators, update_support=args.update_support)
        print(f"{len(done)} tables indexed")
        for i, name, why in index.failed_tables:
            print(f"failed: {i} {name}: {why}", file=sys.stderr)
        return int(bool(index.failed_tables))
    if not index.exists():
        print(f"no index {index.name}", file=sys.stderr)
        return 1
    if args.command == "index" and args.action == "stats":
        s = index.stats()
        print(f"rows {s.rows}, tables {s.tables}, bytes {s.size_bytes}")
        if args.tables:
            for r in index.indexed_tables().orderBy("table_index").toLocalIterator():
                print(f"{r['table_index']} {r['table_name']}: {r['features']} features, {r['keys']} keys")
        return 0
    if args.command == "index":
        if not args.yes and input(f"drop {args.name}? [y/N] ").lower() != "y":
            return 1
        index.drop()
        return 0
    query = spark.read.option("header", True).option("inferSchema", True).csv(args.query)
    if not args.raw:
        ordered = query.withColumn("__order", F.monotonically_increasing_id())
        query = prepare_query_table(ordered, args.key, args.target, "__order", task=args.task)
    threshold = None if args.no_pruning else args.corr_threshold if args.corr_threshold is not None else ...
    result = Augmenter(index.read("features"), args.task, args.top_k, args.metric, args.tol, threshold=threshold, budget_seconds=args.budget_seconds).augment(query, args.key, args.target)
    for p in result.plan:
        print(f"{p['table_name']}.{p['feature']}")
    if args.output:
        result.table.write.mode("overwrite").option("header", True).csv(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
