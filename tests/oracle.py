"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pactspark.plans import registry, standins  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in standins.NAMES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str):
    """(ok, spark rows, oracle rows, seconds, note)."""
    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return False, len(got), None, seconds, f"plan has {bad}"
    if name not in registry.SQL:
        return True, len(got), None, seconds, "rows only"
    result = con.sql(registry.SQL[name])
    want, want_cols = rows_of(list(result.columns), result.fetchall())
    have, have_cols = rows_of(df.columns, got)
    if want_cols != have_cols:
        return False, len(have), len(want), seconds, f"columns {have_cols} != {want_cols}"
    if want != have:
        missing = [r for r in want if r not in set(have)][:2]
        extra = [r for r in have if r not in set(want)][:2]
        return False, len(have), len(want), seconds, f"missing {missing} extra {extra}"
    return True, len(have), len(want), seconds, ""


if __name__ == "__main__":
    from pactspark.session import build_session

    registry.load_all()
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    names = [n for n in registry.QUERIES if not wanted or any(w in n for w in wanted)]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "20g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = []
    for name in names:
        try:
            ok, n, m, seconds, note = compare(spark, con, name, sf)
        except Exception as error:  # report and go on
            ok, n, m, seconds, note = False, None, None, 0, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, n, m, f"{seconds:.1f}s", note[:900], flush=True)
        if not ok:
            bad.append(name)
    print(len(names), "queries,", len(bad), "bad", bad)
