"""Compare each registered query with its SQL on one folder: python tests/tests_oracle.py DIR [NAME...]."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.sql(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:  # noqa: ANN001
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in args[1:] or sql:
        began = time.time()
        try:
            got, want = spark_rows(queries[name](spark, args[0])), oracle_rows(args[0], sql[name])
            same = got == want
            note = "" if same else f" columns {got[0]} {want[0]}; only spark {list((got[1] - want[1]).items())[:3]}; only sql {list((want[1] - got[1]).items())[:3]}"
        except Exception as problem:  # noqa: BLE001 - reported
            same, note = False, f" {type(problem).__name__}: {str(problem)[:600]}"
        bad += not same
        print(f"{'ok ' if same else 'BAD'} {name} {time.time() - began:.1f}s{note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
