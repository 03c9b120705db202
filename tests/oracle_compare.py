"""Runs registered queries on Spark and DuckDB and compares rows and types.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SAME = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> str | None:
    """A description of the difference, or None."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    kinds = {c: t for c, t in df.dtypes}
    rel = con.sql(entry.oracle_sql()[name])
    if sorted(rel.columns) != columns:
        return f"columns {columns} vs {sorted(rel.columns)}"
    other = dict(zip(rel.columns, map(str, rel.types), strict=True))
    bad = [(c, kinds[c], other[c]) for c in columns if SAME.get(kinds[c], kinds[c]) != other[c]]
    if bad:
        return f"types {bad}"
    ours = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    theirs = sorted(map(repr, rel.select(*[f'"{c}"' for c in columns]).fetchall()))
    if ours == theirs:
        return None
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"rows {len(ours)} vs {len(theirs)}; only ours {sorted(a)[:2]}; only theirs {sorted(b)[:2]}"


if __name__ == "__main__":
    from lodeseek.session import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session, con = local_session("compare", cores="8"), duck(folder)
    failed = 0
    for name in sys.argv[2:] or list(entry.queries()):
        start = time.time()
        if name not in entry.oracle_sql():
            print(f"{name}: no SQL, {entry.queries()[name](session, folder).count()} rows")
            continue
        try:
            problem = compare(session, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - start:.1f}s)", flush=True)
    print("failed", failed)
