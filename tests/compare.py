"""Run registered queries in Spark and in DuckDB and compare the results cell by cell."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tidewell.bindings import RAW  # noqa: E402


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return tuple(sorted((k, cell(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if type(value).__name__ == "Decimal":
        return "decimal:" + str(value)
    return value


def compare(spark, con, name, plan, sql, folder) -> str | None:
    """None when equal, else what differs."""
    df = plan(spark, folder)
    rows = df.collect()
    if sql is None:
        return None
    got_cols = df.columns
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    order = sorted(got_cols)
    gi, wi = [got_cols.index(c) for c in order], [want_cols.index(c) for c in order]
    a = Counter(tuple(cell(r[i]) for i in gi) for r in rows)
    b = Counter(tuple(cell(r[i]) for i in wi) for r in want)
    kinds = {}
    for r in rows:
        for i, c in zip(gi, order):
            if r[i] is not None:
                kinds.setdefault(c, type(r[i]).__name__)
    for r in want:
        for i, c in zip(wi, order):
            if r[i] is not None and c in kinds and kinds[c] not in (type(r[i]).__name__,) and not (
                kinds[c] == "Row" or type(r[i]).__name__ == "dict"
            ):
                return f"type of {c}: {kinds[c]} vs {type(r[i]).__name__}"
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"rows {len(rows)} vs {len(want)}; {sum((a - b).values())} differ {order}: spark {left} sql {right}"
    if not rows:
        return "EMPTY on both sides"
    return None


def main() -> None:
    from tidewell.plans import QUERIES, SQL, load_all
    from tidewell.session import build_session

    sf, *only = sys.argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("compare")
    load_all()
    con = oracle(folder)
    bad = 0
    for name, plan in QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, plan, SQL.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        if problem:
            bad += 1
            print(f"BAD {name} {took:.1f}s {problem[:1200]}", flush=True)
        elif took > 3:
            print(f"slow {name} {took:.1f}s", flush=True)
    print(f"{len(QUERIES)} queries registered, {len(SQL)} with SQL, {bad} bad")


if __name__ == "__main__":
    main()
