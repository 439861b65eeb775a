"""Run queries against their SQL: ``python -m checks.compare [sf_dir] [name prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_rows(sf: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = []
    for row in rows:
        values = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else v + 0.0
            values.append(repr(v))
        clean.append(tuple(values))
    return sorted(columns), sorted(clean)


def compare(spark, name: str, sf: str) -> str:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    start = time.time()
    frame = QUERIES[name](spark, sf)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return f"rows {len(got[1])} ({took:.1f}s)"
    start = time.time()
    want = canonical(*oracle_rows(sf, ORACLES[name]))
    sql = time.time() - start
    if got == want:
        return f"ok {len(got[1])} ({took:.1f}s, sql {sql:.1f}s)"
    if got[0] != want[0]:
        return f"DIFFERS columns {got[0]} {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    return f"DIFFERS {len(got[1])} vs {len(want[1])}: only here {extra}, only in SQL {missing}"


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in QUERIES:
        if not wanted or any(name.startswith(w) for w in wanted):
            try:
                print(name, compare(spark, name, sf), flush=True)
            except Exception as error:
                print(name, "FAILED", type(error).__name__, str(error)[:600], flush=True)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main()
