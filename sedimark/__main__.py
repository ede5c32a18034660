"""python -m sedimark list | explain NAME --tables DIR | run NAME --tables DIR [--out PATH] | sql NAME"""

from __future__ import annotations

import argparse


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    for name, text in (("explain", "the plan of a query"), ("run", "run a query; show it, or write parquet"), ("sql", "its SQL for DuckDB")):
        s = sub.add_parser(name, help=text)
        s.add_argument("name")
        if name != "sql":
            s.add_argument("--tables", required=True, help="folder of <table>.parquet")
        if name == "run":
            s.add_argument("--out", help="where to write parquet")
    return p


def main(args: list[str] | None = None) -> None:
    from sedimark.plans.registry import QUERIES, SQL

    a = build_parser().parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if a.name not in QUERIES:
        raise SystemExit(f"no query {a.name}; try list")
    if a.command == "sql":
        print(SQL.get(a.name, "-- SQL can't express it"))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[a.name](spark, a.tables)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(truncate=False)


if __name__ == "__main__":
    main()
