"""Run a query and its SQL side by side; compare names, row counts and values."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


def difference(spark, con, folder: str, query, sql: str) -> str | None:
    """What differs, or None."""
    got = query(spark, folder)
    got_names, got_rows = table(got.columns, got.collect())
    result = con.execute(sql)
    want_names, want_rows = table([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}"
    for a, b in zip(got_rows, want_rows):
        if a != b:
            return f"{str(a)[:400]} != {str(b)[:400]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                verdict = difference(spark, con, folder, query, sql[name]) or "ok"
            else:
                verdict = f"{query(spark, folder).count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            verdict = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:24s} {time.time() - start:7.2f}s  {verdict}", flush=True)
