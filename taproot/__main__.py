"""python -m taproot QUERY FOLDER [--rows N] [--explain] [--out PATH]: one query on a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from taproot.queries import QUERIES


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="taproot", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("folder")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--explain", action="store_true", help="show the plan and run nothing")
    parser.add_argument("--out", help="write all rows there as Parquet")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    found = QUERIES[chosen.query](spark, chosen.folder)
    if chosen.explain:
        found.explain("formatted")
    elif chosen.out:
        found.write.mode("overwrite").parquet(chosen.out)
    else:
        found.show(chosen.rows, False)


if __name__ == "__main__":
    main()
