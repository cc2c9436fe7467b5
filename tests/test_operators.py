"""Operators on in-line DataFrames: FIXTURES.md B6-B10 and the S-corrections."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from ledgerlens.operators import dims, enrich, forwards, grid, mapping, perimeter, period, reconcile
from ledgerlens.operators.placement import sequential_index, top_k_per_group

CELLS = "source_file string, row_idx int, col_idx int, value string"


def _grid(spark, cells):
    c = spark.createDataFrame(cells, CELLS)
    h = grid.detect_headers(c, dims.expected_headers(spark))
    return c, h, grid.layout(c, h, dims.expected_headers(spark))


def test_b6_duplicate_labels_and_letters(spark):
    cells = [("f", 0, i, v) for i, v in enumerate(["Notional", "Notional", "Notional", "Notional.1", "Rate 3.5", "Unnamed: 5"])]
    cells += [("f", 1, i, "x") for i in range(6)]
    _, h, lay = _grid(spark, cells)
    assert rows(h, "header_row", "merged") == [(0, False)]
    got = rows(lay.orderBy("col_idx"), "letter", "label")
    assert got == [("A", "Notional"), ("B", "Notional (Leg2)"), ("C", "Notional (Leg3)"),
                   ("D", "Notional (Leg2)"), ("E", "Rate 3 (Leg6)"), ("F", "")]
    du = spark.createDataFrame([("DU",), ("A",), ("XFD",)], "l string")
    assert [r[0] for r in rows(du.select(grid.index_of("l")))] == [124, 0, 16383]
    assert grid.letter_to_index_py("DU") == 124


def test_header_search_rules(spark):
    # no expected label -> row 0 (S5); tie -> earlier row; merge only if strictly better
    c0, h0, _ = _grid(spark, [("a", 0, 0, "x"), ("a", 1, 0, "y")])
    assert rows(h0, "header_row", "merged", "body_start") == [(0, False, 1)]
    tie = [("b", 1, 0, "Class"), ("b", 2, 0, "Class"), ("b", 3, 0, "v")]
    assert rows(_grid(spark, tie)[1], "header_row") == [(1,)]
    two = [("c", 0, 0, "Leg"), ("c", 0, 1, "Class"), ("c", 1, 0, "Notional"), ("c", 2, 0, "1"), ("c", 2, 1, "2")]
    assert rows(_grid(spark, two)[1], "header_row", "merged", "body_start") == [(0, True, 2)]
    # S7: a blank lower cell is blank, the upper label stays
    blank = [("d", 0, 0, "Leg"), ("d", 0, 1, "Currency"), ("d", 1, 0, "Notional"), ("d", 1, 1, " "), ("d", 2, 0, "1"), ("d", 2, 1, "2")]
    _, h, lay = _grid(spark, blank)
    assert rows(h, "merged") == [(True,)]
    assert rows(lay.orderBy("col_idx"), "label") == [("Notional",), ("Currency",)]


def test_empty_body_columns_dropped(spark):
    cells = [("f", 0, 0, "Class"), ("f", 0, 1, "Currency"), ("f", 0, 2, "Notional"), ("f", 1, 0, "A"), ("f", 1, 2, "3")]
    _, _, lay = _grid(spark, cells)
    assert rows(lay.orderBy("col_idx"), "col_idx", "letter", "label") == [(0, "A", "Class"), (2, "C", "Notional")]


def test_leg_resolution(spark):
    cells = [("f", 0, i, v) for i, v in enumerate(["Notional Leg 1", "Notional Leg 2", "Notional"])] + \
            [("f", 1, i, "1") for i in range(3)]
    _, _, lay = _grid(spark, cells)
    assert rows(grid.leg_columns(lay, "Notional"), "leg1", "leg2", "total") == [("Notional Leg 1", "Notional Leg 2", "Notional")]
    single = [("g", 0, 0, "Notional"), ("g", 1, 0, "1")]
    _, _, lay2 = _grid(spark, single)
    assert rows(grid.leg_columns(lay2, "Notional"), "leg1", "leg2", "total") == [("Notional", None, None)]


def test_b7_thresholds(spark):
    cases = [("CMS Swap", None, 4.99, 0.005), ("CMS Swap", None, 5.0, 0.0075), ("CMS Swap", None, 12.0, 0.0075),
             ("Real Rate Swap", "HICPXT", 7.99, 0.009), ("Real Rate Swap", "HICPXT", 8.0, 0.0115),
             ("Real Rate Swap", " frcpixt ", 8.0, 0.011), ("Real Rate Swap", "OTHER", 3.0, None),
             ("Cross Currency Swap", None, 5.0, 0.016), ("Forward", None, 3.0, None), ("CMS Swap", None, None, None)]
    run = dt.date(2000, 1, 1)
    data = [(i, c, ix, None if y is None else dt.date.fromordinal(run.toordinal() + math.ceil(y * 365.25)))
            for i, (c, ix, y, _) in enumerate(cases)]
    df = spark.createDataFrame(data, "i int, classif string, index_rate string, end_date date")
    got = rows(enrich.attach_thresholds(df, dims.thresholds(spark), F.lit(run)).orderBy("i"), "threshold")
    assert [g[0] for g in got] == [c[3] for c in cases]
    # strict alert: gap equal to the threshold is no alert
    g = spark.createDataFrame([(0, "CMS Swap", None, dt.date(2001, 1, 1), 0.005), (1, "CMS Swap", None, dt.date(2001, 1, 1), -0.0051)],
                              "i int, classif string, index_rate string, end_date date, mtm_gap_pct double")
    assert [r[0] for r in rows(enrich.tolerance_alerts(g, dims.thresholds(spark), F.lit(run)).orderBy("i"), "alert")] == [None, "alerte"]


def _feed(spark, data):
    return spark.createDataFrame(data, "o int, free_text_1 string, book string, cp string, notional double, mtm_value double, mtm_diff double")


def test_b8_forwards(spark):
    f = _feed(spark, [
        (1, "BDFWD a", "601", "CP1", 0.0, 1.0, 0.1),        # notional 0 -> rejected
        (2, "BDFWD b", "601", "CP1", 100.0, 1.0, None),     # null diff -> rejected (S2)
        (3, "BDFWD c", "602.0", " ", 100.0, 1.0, 0.5),      # blank CP -> warning, gap 0.005 -> no alert
        (4, " bdfwd d", " 603", "CP", 100.0, 1.0, 0.51),    # gap 0.0051 -> alert
        (5, "BDFWD e", "604", "CP", 100.0, 1.0, 0.0),       # book 604 dropped
        (6, "IRS", "601", "CP", 100.0, 1.0, 0.0),           # not a forward
    ])
    sel = forwards.select_forwards(f)
    assert sorted(r[0] for r in rows(sel, "o")) == [1, 2, 3, 4]
    q = forwards.forward_quality(sel)
    got = {r[0]: r[1:] for r in rows(q, "o", "status", "message")}
    assert got[1] == ("rejected", "BDFWD a → données manquantes: NOTIONAL")
    assert got[2][0] == "rejected" and got[3] == ("warning", "BDFWD c → données manquantes: CP") and got[4] == ("ok", None)
    a = {r[0]: r[1:] for r in rows(forwards.forward_alerts(q), "o", "alert", "cp_out")}
    assert a == {3: (None, None), 4: ("alerte", "CP")}


def test_b9_aliases(spark):
    txt = "A = B # note\nC : D\nE\tF\n# skip\nA = Z"
    d = dict(rows(reconcile.parse_aliases(reconcile.alias_lines(spark, txt))))
    assert d == {"a": "Z", "b": "B", "c": "D", "e": "F", "d": "D", "f": "F", "z": "Z"}
    lab = spark.createDataFrame([(" foo   bar ",), ("a",), ("  ",)], "label string")
    out = reconcile.normalize_label(lab, "label", reconcile.parse_aliases(reconcile.alias_lines(spark, txt)), "n")
    assert sorted(rows(out, "label", "n"), key=str) == sorted([(" foo   bar ", "FOO BAR"), ("a", "Z"), ("  ", None)], key=str)


def test_b10_order_rules(spark):
    df = spark.createDataFrame([(None, "x", 3), (None, "y", 1), ("k", "z", 2), ("k", "w", 0)], "id string, v string, ord int")
    first = dict(rows(perimeter.dedup_first(df, ["id"], "ord"), "id", "v"))
    assert first == {None: "y", "k": "w"}  # null ids are equal
    last = dict(rows(enrich.last_wins(df, ["id"], "ord"), "id", "v"))
    assert last == {None: "x", "k": "z"}
    lab = spark.createDataFrame([("a", None, 0, 1.0), ("a", "L2", 1, None), ("a", "L3", 2, 2.0)], "k string, t string, ord int, v double")
    agg = rows(reconcile.aggregate_by_norm(lab, ["k"], ["t"], ["v"], "ord"), "t", "v")
    assert agg == [("L2", 3.0)]  # first non-null label, null-skipping sum
    recs = spark.createDataFrame([("f", 6, "a"), ("f", 7, "b"), ("f", 8, " "), ("f", 9, "c"), ("g", 2, "x")], "source_file string, row_idx int, code string")
    start = spark.createDataFrame([("f", 6), ("g", 1)], "source_file string, start_row int")
    kept = sorted(rows(grid.stop_at_blank(recs, "code", start), "source_file", "row_idx"))
    assert kept == [("f", 6), ("f", 7)]  # g: the start row itself is blank
    seq = sequential_index(spark.createDataFrame([(i,) for i in [5, 3, 9, 1]], "k int"), ["k"], name="n", start=2)
    assert sorted(rows(seq, "k", "n")) == [(1, 2), (3, 3), (5, 4), (9, 5)]  # no gaps


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1000)), min_size=1, max_size=40, unique_by=lambda t: t[1]))
def test_first_wins_invariant_to_partitioning(spark, data):
    df = spark.createDataFrame(data, "k int, ord int")
    a = sorted(rows(perimeter.dedup_first(df.withColumn("v", F.col("ord") * 2), ["k"], "ord")))
    b = sorted(rows(perimeter.dedup_first(df.repartition(7).withColumn("v", F.col("ord") * 2), ["k"], "ord")))
    expect = sorted({k: (k, min(o for kk, o in data if kk == k), 2 * min(o for kk, o in data if kk == k)) for k, _ in data}.values())
    assert a == b == expect


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(-1000, 1000)), min_size=1, max_size=20))
def test_period_gap_antisymmetry_and_totals(spark, data):
    cur = spark.createDataFrame(data, "classif string, total long").groupBy("classif").agg(F.sum("total").alias("total"))
    prev = spark.createDataFrame([(c, v // 2) for c, v in data[::2]], "classif string, total long").groupBy("classif").agg(F.sum("total").alias("total"))
    ab = dict(rows(period.compare_periods(cur, prev), "classif", "gap"))
    ba = dict(rows(period.compare_periods(prev, cur), "classif", "gap"))
    assert ab == {k: -v for k, v in ba.items()}
    t = rows(period.period_totals(cur, prev))[0]
    assert t[2] == t[0] - t[1] == sum(ab.values())


def test_reconcile_conserves_both_sides(spark):
    tmpl = spark.createDataFrame([("CMS Swap", "Bank A", 10.0, 1.0), ("Forward", "Bank B", 5.0, 2.0)],
                                 "classif string, counterparty string, mtm_own double, mtm_cpty double")
    col = spark.createDataFrame([(" bank a ", "IR swap, fixed/float", 7.0, 1.0, 0), ("Bank C", "Repo", 3.0, None, 1)],
                                "counterparty string, typology string, mtm_own double, mtm_cpty double, ord int")
    aliases = reconcile.parse_aliases(reconcile.alias_lines(spark, reconcile.DEFAULT_TYPOLOGY_ALIASES))
    cp = reconcile.parse_aliases(reconcile.alias_lines(spark, "x = y"))
    r = reconcile.reconcile(tmpl, col, cp, aliases)
    got = rows(reconcile.sort_recon(r), "norm_counterparty", "norm_typology", "gap_mtm_own", "present_template", "present_collateral")
    assert got == [("BANK A", "IR swap, fixed/float", 3.0, True, True), ("BANK B", "Forward", 5.0, True, False),
                   ("BANK C", "REPO", -3.0, False, True)]
    tot = rows(r.agg(F.sum("mtm_own_template"), F.sum("mtm_own_collateral")))[0]
    assert tot == (15.0, 10.0)
    assert rows(reconcile.max_gap(r), "max_abs_gap", "concordant") == [(5.0, False)]


def test_marks_missing_and_matched_cover_all(spark):
    feed = spark.createDataFrame([("A/1", 1.0, 0.5), ("A", 2.0, None), (" ", 1.0, 1.0), ("B/x", 0.0, 0.0)],
                                 "free_text_2 string, mtm_value double, mtm_diff double")
    marks = enrich.aggregate_marks(feed)
    assert sorted(rows(marks)) == [("A", 3.0, 0.5, 0.5), ("B", 0.0, 0.0, 0.0)]  # S9: per-row v-d
    rep = spark.createDataFrame([("A", 100.0, 10.0, 0.1), ("B", 50.0, 1.0, 0.02), ("C", 1.0, 1.0, 1.0)],
                                "code string, notional double, dirty_total double, dirty_pct double")
    e = enrich.enrich_marks(rep, marks)
    got = {r[0]: r[1:] for r in rows(e, "code", "matched", "mtm_gap", "mtm_gap_pct")}
    assert got == {"A": (True, 9.5, 0.095), "B": (True, 1.0, 0.02), "C": (False, None, None)}  # a 0.0 mark matches
    missing = {r[0] for r in rows(enrich.missing_codes(rep, marks), "code")}
    assert missing | {k for k, v in got.items() if v[0]} == {"A", "B", "C"}
    assert rows(enrich.unused_codes(marks, rep)) == []


def test_mapping_compiler_whitelist(spark):
    df = spark.createDataFrame([(10.0, 4.0, None)], "a double, b double, c double")
    env = {n: F.col(n) for n in "abc"}
    exprs = ["a / b", "_div(a, 0)", "-a + b * 2", "a / c", "a ** 2", "__import__('os')", "open('x')", "a +", "zz"]
    got = rows(df.select(*[mapping.compile_expr(e, env).alias(f"e{i}") for i, e in enumerate(exprs)]))[0]
    assert got == (2.5, None, -2.0, None, None, None, None, None, None)


def test_mapping_config_shipped(spark):
    m = mapping.compile_mapping(mapping.shipped_config())
    assert len(m.variables) == 11 and len(m.columns) == 29 and len(m.computed) == 9
    assert mapping.target_kind("Dirty Value (%)") == "number"  # S4
    assert mapping.target_kind("End Date") == "date" and mapping.target_kind("Class") == "text"


def test_top_k_per_group_exact(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(3)], "g string, o int")
    got = sorted(rows(top_k_per_group(df, ["g"], "o", 4, salt_buckets=8), "g", "o", "rank", "n_group"))
    assert got == [("a", i, i + 1, 500) for i in range(4)] + [("b", i, i + 1, 3) for i in range(3)]


def test_ctl5_run_date_argument_else_b3(spark):
    cells = spark.createDataFrame([("a", 2, 1, "19/09/2025"), ("b", 2, 1, "45919"), ("c", 0, 0, "x")], CELLS)
    got = dict(rows(enrich.run_date_of(cells), "source_file", "run_date"))
    assert got == {"a": dt.date(2025, 9, 19), "b": dt.date(2025, 9, 19), "c": None}
    given = dict(rows(enrich.run_date_of(cells, "2025-06-30"), "source_file", "run_date"))
    assert set(given.values()) == {dt.date(2025, 6, 30)}


def test_cells_and_numbered_rows_are_not_shuffled_for_small_tables(spark, tmp_path):
    """Cells meet the binding, and numbered rows their offsets, by a broadcast."""
    from ledgerlens.operators.placement import sequential_index

    x = spark.range(40_000).select(F.lit("a.xls").alias("source_file"), F.col("id").cast("int").alias("row_idx"),
                                   F.lit(0).alias("col_idx"), F.xxhash64("id").cast("string").alias("value"))
    x.write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    headers = spark.createDataFrame([("a.xls", 10)], "source_file string, body_start int")
    binding = cells.groupBy("source_file", "col_idx").agg(F.lit("x").alias("name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        for out, n in ((grid.to_records(cells, binding, F.broadcast(headers), ["x"]), 39_990),
                       (sequential_index(cells, ["row_idx"], ["source_file"]), 40_000)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
            assert out.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stop_at_blank_across_blocks(spark):
    """The cut lies in a later block; rows that come twice, blank keys and files without keys."""
    n = grid.BLOCK_ROWS
    keyed = spark.range(2 * n + 7).select(F.lit("a").alias("source_file"), (F.col("id") + 3).cast("int").alias("row_idx"), F.lit("k").alias("code"))
    odd = spark.createDataFrame([("a", 3, "k"), ("a", 2 * n + 10, " "), ("a", 2 * n + 11, "k"), ("a", 1, "k"), ("b", 5, "k")],
                                "source_file string, row_idx int, code string")
    start = spark.createDataFrame([("a", 3), ("b", 3)], "source_file string, start_row int")
    kept = grid.stop_at_blank(keyed.unionByName(odd), "code", start)
    assert kept.columns == ["source_file", "row_idx", "code", "start_row"]
    got = kept.agg(F.count(F.lit(1)), F.min("row_idx"), F.max("row_idx"), F.max("source_file")).first()
    assert tuple(got) == (2 * n + 8, 3, 2 * n + 9, "a")


def test_records_are_aggregated_once_per_bound_column(spark):
    """Columns that feed several names, names with several columns, cells that come
    twice, unmapped cells, a file without columns; row numbers beyond an int."""
    far = 2**40
    cells = spark.createDataFrame(
        [("a", 0, 0, "head"), ("a", 1, 0, "x"), ("a", 1, 0, "y"), ("a", 1, 2, "z"), ("a", 2, 9, "unmapped"), ("a", far, 1, "w"),
         ("a", far + 1, 0, None), ("b", 1, 0, "p"), ("b", 1, 1, "q"), ("c", 3, 0, "r"), ("no header", 1, 0, "s"), (None, 1, 0, "t"), ("a", None, 0, "u")],
        "source_file string, row_idx long, col_idx int, value string",
    )
    headers = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "source_file string, body_start int")
    binding = spark.createDataFrame(
        [("a", 0, "n"), ("a", 0, "m"), ("a", 1, "m"), ("a", 2, "two"), ("a", 0, "two"), ("a", 0, "n"), ("b", 1, "n"), ("b", 0, "other")],
        "source_file string, col_idx int, name string",
    )
    out = grid.to_records(cells, binding, headers, ["n", "m", "two", "absent"])
    assert out.columns == ["source_file", "row_idx", "n", "m", "two", "absent", "ord"]
    assert sorted(tuple(r[:6]) for r in rows(out)) == [
        ("a", 1, "y", "y", "z", None), ("a", 2, None, None, None, None), ("a", far, None, "w", None, None),
        ("a", far + 1, None, None, None, None), ("b", 1, "q", None, None, None), ("c", 3, None, None, None, None),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(CASE") == 3  # columns 0, 1 and 2 of a, not four names
    empty = grid.to_records(cells, binding.limit(0), headers, ["n"])
    assert sorted(tuple(r[:3]) for r in rows(empty.where("source_file <> 'a'"))) == [("b", 1, None), ("c", 3, None)]


def test_preview_maps_the_first_rows_only(spark):
    """The rows are known by their code cells (the greatest, where one comes twice)
    before cells become records; the preview is that of all records."""
    body = [("f", r, 0, c) for r, c in ((1, "n/a"), (2, "A"), (3, " "), (5, "B"), (5, "n/a"), (6, "C"), (7, "D"))] + [("g", 1, 1, "E"), ("g", 2, 1, "F")]
    body += [(f, r, 2, f"{r},5") for f in "fg" for r in range(1, 9)]
    cells = [("f", 0, 0, "Custom Attribute5 Value"), ("g", 0, 1, "Custom Attribute5 Value"), *[(f, 0, 2, "Notional") for f in "fg"]]
    c, h, lay = _grid(spark, cells + body)
    m = mapping.compile_mapping({"variables": {"v": {"source": "Notional"}}, "columns": [{"target": "Notional", "source_letter": "C"}]})
    for n, shown in ((2, [("f", 2), ("f", 6)]), (4, [("f", 2), ("f", 6), ("f", 7), ("g", 1)]), (99, [("f", 2), ("f", 6), ("f", 7), ("g", 1), ("g", 2)])):
        first = mapping.mapped_records(c, h, lay, m, first=n)
        assert sorted(rows(first, "source_file", "row_idx")) == shown
        got, every = (rows(mapping.preview(mapping.apply_mapping(r, m, preview=True)[0], n)) for r in (first, mapping.mapped_records(c, h, lay, m)))
        assert got == every and [r[:2] for r in got] == shown
    without_codes = c.where("row_idx = 0 or col_idx = 2")
    assert mapping.mapped_records(without_codes, h, lay, m, first=3).count() == 0


def _shuffled_bytes(spark):
    import pathlib

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p: p.stat().st_size for d in dirs for p in pathlib.Path(d.getPath()).glob("*/shuffle_*.data")}


def _left(spark, before, most, seconds=20):
    """Bytes of new shuffle files, when at most ``most`` are left (they are removed in the background)."""
    import time

    for _ in range(seconds * 4):
        left = sum(n for p, n in _shuffled_bytes(spark).items() if p not in before)
        if left <= most:
            break
        time.sleep(0.25)
    return left


def test_numbering_leaves_no_shuffle_of_its_rows(spark, tmp_path):
    """What the range shuffle wrote goes when the rows are stored; the setting is put back."""
    import gc

    spark.range(60_000).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).write.parquet(f"{tmp_path}/x")
    gc.collect()
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", _shuffled_bytes(spark)
    old = spark.conf.get(key)
    seq = sequential_index(spark.read.parquet(f"{tmp_path}/x"), ["k"], name="n")  # 60,000 x 64 characters
    assert _left(spark, before, 200_000) <= 200_000 and spark.conf.get(key) == old
    assert tuple(seq.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()) == (1, 60_000, 60_000)


def test_numbering_by_slices(spark):
    """A slice without rows, groups in some slices only, rows without a group; numbers of each group or going on."""
    data = [(g, i) for g, some in (("b", range(0, 90, 2)), ("a", range(40, 60)), ("c", [5])) for i in some] + [(None, 7)]
    df = spark.createDataFrame(data, "g string, i int").repartition(5)
    i = F.col("i")
    slices = [i < 30, (i >= 30) & (i < 31), (i >= 31) & (i < 50), i >= 50]
    known = sorted(r for r in data if r[0])
    on = {r: 3 + k for k, r in enumerate(known)}
    again = {r: 3 + k for g in "abc" for k, r in enumerate(x for x in known if x[0] == g)}
    for restart, expected in ((False, on), (True, again)):
        for cut in (None, slices):
            out = sequential_index(df, ["i"], ["g"], name="n", start=3, slices=cut, restart=restart)
            assert out.columns == ["g", "i", "n"]
            assert {tuple(r[:2]): r[2] for r in rows(out)} == expected and out.count() == len(expected)


def test_row_slices_hold_every_row_once(spark):
    far = 2**40
    cells = spark.createDataFrame(
        [("a", r, c, "v") for r in range(200) for c in range(3)] + [("b", far + r, 0, "v") for r in range(50)] + [("a", None, 0, "v")],
        "source_file string, row_idx long, col_idx int, value string")
    assert grid.row_slices(cells) is None and grid.row_slices(cells.where("row_idx < 0"), 1) is None
    near = cells.where("row_idx < 200")
    cut = grid.row_slices(near, 90)
    assert [near.where(s).count() for s in cut] == [90] * 6 + [60]
    assert [cells.where(s).count() for s in grid.row_slices(cells, 90)] == [600, 50]  # a bin of rows is not cut


def test_cells_become_placed_records_by_slices(spark, monkeypatch):
    """Report cells of rows placed by slices are those of rows placed at once; only
    code cells that hold, by file and row; cells of a slice are filtered where they are read."""
    body = [("f", r, 0, c) for r, c in ((1, "n/a"), (2, "A"), (3, " "), (5, "B"), (5, "n/a"), (6, "C"), (40, "D"))] + [("e", r, 1, f"E{r}") for r in (1, 2, 39)]
    body += [(f, r, 2, f"{r},5") for f in "ef" for r in range(1, 41)]
    cells = [("f", 0, 0, "Custom Attribute5 Value"), ("e", 0, 1, "Custom Attribute5 Value"), *[(f, 0, 2, "Notional") for f in "ef"]]
    c, h, lay = _grid(spark, cells + body)
    m = mapping.compile_mapping({"variables": {"v": {"source": "Notional"}}, "columns": [{"target": "Notional", "source_letter": "C"}],
                                 "computed": [{"target": "Dirty Value (%)", "expr": "v / 2"}]})
    header = ["Notional", "Dirty Value (%)"]
    rec = mapping.mapped_records(c, h, lay, m)
    at_once = mapping.report_cells(mapping.apply_mapping(rec, m, header)[0], header, 6, dt.date(2025, 9, 19))
    for n in (10, 1_000):
        slices = grid.row_slices(c, n)
        assert (slices is None) == (n == 1_000)
        placed = mapping.placed_records(rec, slices, start=7)
        assert sorted(rows(placed, "sheet_row", "source_file", "row_idx")) == [
            (7, "e", 1), (8, "e", 2), (9, "e", 39), (10, "f", 2), (11, "f", 6), (12, "f", 40)]
        report, _ = mapping.apply_mapping(placed, m, header, keep=("sheet_row",))
        assert sorted(map(str, rows(mapping.report_cells(report, header, 6, dt.date(2025, 9, 19))))) == sorted(map(str, rows(at_once)))


def test_report_cells_stores_little(spark, tmp_path, monkeypatch):
    """The numbered lines go when the cells are stored; the cells of one slice are read
    by their row numbers, and no shuffle of a slice outlives it."""
    import gc
    import pathlib

    from ledgerlens.plans import catalog, grid_queries, mapping_queries
    from ledgerlens.session import ensure_checkpoint_dir
    from ledgerlens.sources import cells as source

    assert "report_cells" in catalog.QUERIES
    sf = "/root/testdata/sf0.001"
    tables = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "ledgerlens-tables"
    old = set(tables.glob("*")) if tables.exists() else set()
    c = source.cells(spark, sf)
    new = {p.name.split("-")[0] for p in set(tables.glob("*")) - old}
    assert new == {"cells"}
    plan = mapping.mapped_records(c, *grid.prepare(c, dims.expected_headers(spark)), mapping.compile_mapping(mapping_queries.G_MAPPING))
    plan = plan.where((F.col("row_idx") >= 700) & (F.col("row_idx") < 900))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_idx,700)" in plan and "LessThan(row_idx,900)" in plan
    grid_queries._grid(spark, sf)
    expected = sorted(map(str, mapping_queries.report_cells(spark, sf).collect()))
    monkeypatch.setattr(grid, "CELLS_AT_ONCE", 9_000)
    gc.collect()
    before = _shuffled_bytes(spark)
    out = mapping_queries.report_cells(spark, sf)  # about 40,000 cells
    assert _left(spark, before, 60_000) <= 60_000
    assert len([f for f in out.inputFiles() if "/ranged-" in f and "/4/" in f]) >= 1  # five slices
    assert sorted(map(str, out.collect())) == expected
