"""Run a query on Spark and its SQL on DuckDB, and compare them as unordered rows.

As a script: python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df = df.assign(**{c: df[c].astype("datetime64[us]")})
        elif df[c].dtype == object and len(df) and hasattr(df[c].dropna().iloc[0] if df[c].notna().any() else 0, "isoformat"):
            df = df.assign(**{c: pd.to_datetime(df[c]).astype("datetime64[us]")})
        elif df[c].dtype.kind == "f":
            df = df.assign(**{c: df[c] + 0.0})
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame, ties: bool = True) -> str | None:
    """What differs, or None.

    Both sides round their reals. A value exactly between two roundings may go
    either way with the order of its sum, so with `ties` one unit of the eighth digit is allowed.
    """
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind and not {got[c].dtype.kind, want[c].dtype.kind} <= set("OTU"):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
        if got[c].dtype.kind in "iu" and got[c].dtype != want[c].dtype:
            return f"width of {c}: {got[c].dtype} != {want[c].dtype}"
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if ties and got[c].dtype.kind == "f":
            same |= (got[c] - want[c]).abs() < 1.5e-8
        if not same.all():
            at = (~same).idxmax()
            return f"{c}: {int((~same).sum())} rows differ, first\n{got.loc[at].to_dict()}\n{want.loc[at].to_dict()}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if name in oracles:
                bad = difference(got, con.execute(oracles[name]).df(), ties=False)
                print(f"{'FAIL' if bad else 'ok  '} {name} rows={len(got)} {took:.2f}s duck={time.time() - start:.2f}s {bad or ''}", flush=True)
            else:
                print(f"rows {name} rows={len(got)} {took:.2f}s", flush=True)
        except Exception as error:
            print(f"ERR  {name} {type(error).__name__}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()


if __name__ == "__main__":
    main()
