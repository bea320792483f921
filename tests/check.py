"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    return round(v, 12) if isinstance(v, float) and math.isfinite(v) else v


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same bag of rows under the same names."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    expected = Counter(
        tuple(_value(row[names.index(n)]) for n in order) for row in result.fetchall()
    )
    got = Counter(tuple(_value(v) for v in row) for row in df.select(*order).collect())
    if got != expected:
        extra, missing = list((got - expected).items())[:3], list((expected - got).items())[:3]
        return f"{sum(got.values())} vs {sum(expected.values())} rows; extra {extra} missing {missing}"
    return None


if __name__ == "__main__":
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if name not in oracles or (wanted and not any(name.startswith(w) for w in wanted)):
            continue
        start = time.time()
        try:
            problem = compare(run(spark, sf_dir), con, oracles[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:35s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", failed)
