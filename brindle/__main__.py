"""Command line: ``list``, ``run QUERY DATA OUT``, ``explain QUERY DATA``, ``render DATA OUT``.

``python -m brindle ...`` runs on this machine; under ``spark-submit`` (or with a
master in the configuration) the session given there is used.
"""

from __future__ import annotations

import argparse

from pyspark import SparkConf
from pyspark.sql import SparkSession

from brindle import catalogue
from brindle.operators import packing
from brindle.plans.ship import ship
from brindle.session import local_session
from brindle.sources.tables import table


def _session(app: str) -> SparkSession:
    given = SparkConf().contains("spark.master")
    return SparkSession.builder.appName(app).getOrCreate() if given else local_session(app=app)


def _render(spark: SparkSession, args: argparse.Namespace) -> None:
    """Windows with tokens and labels under OUT/windows, counters by episode under OUT/statistics; a strict run fails where blocks or threads were left out."""
    windows, statistics = packing.rendered(table(spark, args.data, "blocks"), args.window, args.overlap)
    windows.write.mode("errorifexists").parquet(f"{args.out}/windows")
    statistics.write.mode("errorifexists").json(f"{args.out}/statistics")
    total = statistics.where("episode is null").first()
    print(total.asDict())
    if args.strict and (total.skipped_blocks or total.errors):
        raise SystemExit(f"strict: {total.skipped_blocks} skipped blocks, {total.errors} unusable threads")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="brindle", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="write a query's result as Parquet; refuses to overwrite")
    run.add_argument("query")
    run.add_argument("data")
    run.add_argument("out")
    explain = sub.add_parser("explain", help="print a query's plan")
    explain.add_argument("query")
    explain.add_argument("data")
    render = sub.add_parser("render", help="training windows of the blocks and their statistics; refuses to overwrite")
    render.add_argument("data")
    render.add_argument("out")
    render.add_argument("--window", type=int, required=True)
    render.add_argument("--overlap", type=int, required=True)
    render.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    queries = catalogue.queries()
    if args.command == "list":
        print("\n".join(queries))
        return
    if args.command != "render" and args.query not in queries:
        parser.error(f"unknown query {args.query}")
    spark = _session(f"brindle {args.command}")
    ship(spark)
    if args.command == "render":
        _render(spark, args)
    elif args.command == "explain":
        queries[args.query](spark, args.data).explain("formatted")
    else:
        queries[args.query](spark, args.data).write.mode("errorifexists").parquet(args.out)


if __name__ == "__main__":
    main()
