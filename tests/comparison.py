"""Side-by-side run of a catalogue query and its SQL.

``python -m tests.comparison [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the given tables as views."""
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in order, missing values alike."""
    out = frame[sorted(frame.columns)].copy()
    for name in out.columns:
        kind = out[name].dtype
        if kind == object or str(kind) in ("str", "string", "boolean", "bool"):
            out[name] = [None if pd.isna(v) else str(v) for v in out[name]]
        else:
            out[name] = out[name].astype("float64")
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """First difference of two results, or nothing."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = normal(left), normal(right)
    for name in a.columns:
        same = (a[name] == b[name]) | (a[name].isna() & b[name].isna())
        if not same.all():
            at = int((~same).idxmax())
            return (
                f"{int((~same).sum())} of {len(a)} differ in {name}: "
                f"{a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
            )
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from yardgrid.session import local_session

    spark = local_session(8)
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            ours = queries[name](spark, folder).toPandas()
            spent = time.time() - start
            if name not in oracles:
                print(f"ROWS {name} {len(ours)} rows {spent:.1f}s {ours.head(1).to_dict('records')}", flush=True)
                continue
            start = time.time()
            theirs = connection.sql(oracles[name]).df()
            verdict = difference(ours, theirs)
            bad += verdict is not None
            state = "ok" if verdict is None else f"DIFF {verdict}"
            print(f"{name} {len(ours)} rows spark {spent:.1f}s sql {time.time() - start:.1f}s {state}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
