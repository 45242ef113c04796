"""Command line: ``python -m colophon list``, ``query NAME --tables DIR [--out DIR]``, ``mine --pages DIR --out DIR``."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="colophon")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    ask = commands.add_parser("query", help="runs one query over a folder of Parquet tables")
    ask.add_argument("name")
    ask.add_argument("--tables", required=True)
    ask.add_argument("--out", help="writes Parquet there instead of showing twenty rows")
    mine = commands.add_parser("mine", help="reference lists, titles and a summary from page texts (doc, page, text)")
    mine.add_argument("--pages", required=True)
    mine.add_argument("--out", required=True)
    args = parser.parse_args(argv)

    from colophon import catalogue

    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("colophon").getOrCreate()
    if args.command == "query":
        if args.name not in catalogue.queries():
            parser.error(f"no query {args.name}")
        rows = catalogue.queries()[args.name](spark, args.tables)
        rows.write.mode("overwrite").parquet(args.out) if args.out else rows.show(truncate=False)
        return 0
    from colophon.operators.workflows import mining
    from colophon.sources.writers import write_csv, write_lines, write_summary

    out = mining(spark.read.parquet(args.pages), "doc", "page")
    for name in ("references", "distinct", "status"):
        write_csv(out[name], f"{args.out}/{name}", fixed=True)
    write_lines(out["titles"], "title", f"{args.out}/titles")
    write_summary(out["summary"], f"{args.out}/summary")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
