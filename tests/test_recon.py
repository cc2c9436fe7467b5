"""Reconciliation inputs: what is stored has a row a label, never a row a line."""

import duckdb

from ledgerlens.plans import catalog
from ledgerlens.plans.oracle import ORACLE


def _tables(folder):
    c = duckdb.connect()
    made = {
        "supplier": "select i as s_suppkey from range(1, 9) r(i)",
        "orders": """select i as o_orderkey, i % 60 as o_custkey, case i % 3 when 0 then 'P' when 1 then 'O' else 'F' end as o_orderstatus,
          1000.25::double + i as o_totalprice, '1-URGENT' as o_orderpriority from range(300) r(i)""",
        "lineitem": """select i as l_orderkey, i % 250 as l_partkey, i % 8 + 1 as l_suppkey,
          cast(i % 7 + 1 as integer) as l_linenumber, cast(i % 50 + 1 as double) as l_quantity,
          case when i % 41 <> 0 then 900.5::double + i end as l_extendedprice, 0.05::double as l_discount, 0.02::double as l_tax,
          case i % 3 when 0 then 'A' else 'N' end as l_returnflag, 'O' as l_linestatus, timestamp '1995-01-01' as l_shipdate
          from range(2000) r(i)""",
    }
    for name, sql in made.items():
        c.execute(f"create table {name} as {sql}")
        c.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return c


def test_lines_are_not_stored(spark, tmp_path, monkeypatch):
    c = _tables(tmp_path)
    stored, write = {}, catalog.materialize

    def counted(df, name):
        out = write(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(catalog, "materialize", counted)
    got = catalog.recon_max_gap(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == c.execute(ORACLE["recon_max_gap"]).fetchall()
    assert stored["recon-swaps"] <= 4 * 9 and max(stored.values()) < 400


def test_sums_by_label(spark, tmp_path):
    c = _tables(tmp_path)
    for name in ("mtm_by_class_cpty", "aggregate_by_norm", "collateral_recon"):
        want = c.execute(ORACLE[name])
        columns = [d[0] for d in want.description]
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
