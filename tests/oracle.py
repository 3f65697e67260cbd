"""Runs registered queries beside their SQL and reports differences.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype("float64") + 0.0
        elif pd.api.types.is_integer_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64")
        elif len(df) and df[c].map(lambda v: isinstance(v, (int, float)) or v is None).all():
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when both hold the same rows in any order."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a, b = _normal(ours), _normal(theirs)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return (f"column {c}: {(~same).sum()} rows differ, first {a[c][i]!r} against {b[c][i]!r}; "
                    f"{a.loc[i].to_dict()} against {b.loc[i].to_dict()}")
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from strataframe import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            ours = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                result = f"rows only, {len(ours)}"
            else:
                problem = difference(ours, con.execute(sql[name]).df())
                bad += problem is not None
                result = problem or f"ok, {len(ours)} rows"
        except Exception as error:  # noqa: BLE001
            bad, took = bad + 1, time.time() - start
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {took:6.2f}s  {result}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
