"""Run plans beside their SQL: ``python tests/oracle.py SF_DIR [key-prefix ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(repr(row[i]) for i in order) for row in rows))
    return [columns[i] for i in order], body


def compare(spark, con, key: str, folder: str) -> tuple[bool, str, int]:
    df = contract.queries()[key](spark, folder)
    return compare_frame(con, key, df)


def compare_frame(con, key: str, df) -> tuple[bool, str, int]:
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(key)
    if sql is None:
        return True, "rows only", len(mine[1])
    cursor = con.execute(sql)
    theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if mine == theirs:
        return True, "equal", len(mine[1])
    extra = [r for r in mine[1] if r not in set(theirs[1])][:2]
    lacking = [r for r in theirs[1] if r not in set(mine[1])][:2]
    note = f"cols {mine[0]} / {theirs[0]}; rows {len(mine[1])} / {len(theirs[1])}\n   spark {str(extra)[:500]}\n   sql   {str(lacking)[:500]}"
    return False, note, len(mine[1])


def main(folder: str, prefixes: list[str]) -> int:
    from quire.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    for key in contract.queries():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        begin = time.time()
        try:
            ok, note, rows = compare(spark, con, key, folder)
        except Exception as error:  # noqa: BLE001
            ok, note, rows = False, "".join(traceback.format_exception_only(error))[:900], -1
        print(f"{'ok  ' if ok else 'FAIL'} {key} rows={rows} {time.time() - begin:.1f}s {note if not ok or note != 'equal' else ''}", flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
