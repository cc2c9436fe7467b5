"""Side-by-side check of a registered query against its DuckDB oracle.

Used by the tests and by hand (``python -m ledgerlens.plans.check [names]``).
Values are compared exactly (floats bit for bit, -0.0 == 0.0), as a
multiset of rows over columns sorted by name.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
from collections import Counter

from .catalog import QUERIES
from .oracle import ORACLE
from ..sources.tables import TABLE_NAMES


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm_value(r[i]) for i in order) for r in records]


def compare(spark, name: str, sf_dir: str, con=None, show: int = 5) -> dict:
    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = _rows(s_cols, [tuple(r) for r in df.collect()])
    out = {"name": name, "spark_rows": len(s_rows), "spark_cols": sorted(s_cols)}
    if name not in ORACLE:
        out["status"] = "rows-only"
        return out
    con = con or duck_connection(sf_dir)
    res = con.execute(ORACLE[name])
    d_cols = [c[0] for c in res.description]
    d_rows = _rows(d_cols, res.fetchall())
    out["duck_rows"] = len(d_rows)
    out["duck_cols"] = sorted(d_cols)
    cs, cd = Counter(map(repr, s_rows)), Counter(map(repr, d_rows))
    only_s = list((cs - cd).elements())
    only_d = list((cd - cs).elements())
    ok = sorted(s_cols) == sorted(d_cols) and not only_s and not only_d
    out["status"] = "match" if ok else "MISMATCH"
    if not ok:
        out["only_spark"] = sorted(only_s)[:show]
        out["only_duck"] = sorted(only_d)[:show]
        out["n_only_spark"] = len(only_s)
        out["n_only_duck"] = len(only_d)
    return out


def main(argv: list[str]) -> int:
    from ..session import build_session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or list(QUERIES)
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": "ERROR", "error": repr(exc)[:2000]}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
