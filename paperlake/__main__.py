"""Command line: ``python -m paperlake list``, ``python -m paperlake query NAME TABLES [OUT]``, ``python -m paperlake sql TABLES TEXT``."""

from __future__ import annotations

import argparse
import os

from paperlake.queries import QUERIES
from paperlake.session import session
from paperlake.sqlfunctions import register


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperlake")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("tables")
    q.add_argument("out", nargs="?")
    s = sub.add_parser("sql")
    s.add_argument("tables")
    s.add_argument("text")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = session()
    if a.command == "sql":
        register(spark)
        for f in sorted(os.listdir(a.tables)):
            if f.endswith(".parquet"):
                spark.read.parquet(f"{a.tables}/{f}").createOrReplaceTempView(f.removesuffix(".parquet"))
        spark.sql(a.text).show(truncate=80)
        return 0
    df = QUERIES[a.name](spark, a.tables)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
