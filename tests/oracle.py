"""Compare registered queries with their SQL on the same Parquet files.

Run as a script: ``python tests/oracle.py FOLDER [QUERY ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from lanewise.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    """Columns by name, cells as text, rows sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def _text(value: object) -> str:
    if isinstance(value, float):
        return "NULL" if value != value else repr(value + 0.0)
    return "NULL" if value is None else str(value)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    started = time.time()
    frame = entry.queries()[name](spark, folder)
    ours = [tuple(row) for row in frame.collect()]
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(ours) > 0, f"{len(ours)} rows, rows only, {took:.1f}s"
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(frame.columns) != sorted(names):
        return False, f"columns differ: {sorted(set(frame.columns) ^ set(names))}"
    if len(ours) != len(theirs):
        return False, f"{len(ours)} rows against {len(theirs)}"
    pairs = zip(canonical(frame.columns, ours), canonical(names, theirs), strict=True)
    different = [(a, b) for a, b in pairs if a != b]
    if different:
        cells = {
            column: (a, b)
            for column, a, b in zip(sorted(names), *different[0], strict=True)
            if a != b
        }
        return False, f"{len(different)} of {len(ours)} rows differ, e.g. {cells}"
    return len(ours) > 0, f"{len(ours)} rows equal, {took:.1f}s"


def main(folder: str, names: list[str]) -> int:
    spark = local_session("oracle", 8, **{"spark.ui.showConsoleProgress": "false"})
    con = connect(folder)
    failed = 0
    for name in names or entry.queries():
        try:
            good, note = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {note}", flush=True)
        spark.catalog.clearCache()
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
