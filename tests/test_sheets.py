"""Sheets in row form: header lookups, code column, first blank, positions, run date."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlens.operators import enrich
from ledgerlens.operators import sheets as SH
from ledgerlens.sources.sheets import ROWS_SCHEMA, read_sheet_rows


def sheet(spark, grid, name="a.xls", tab="S", no=0):
    return spark.createDataFrame([(name, tab, no, i, v) for i, v in enumerate(grid) if v is not None], ROWS_SCHEMA)


def test_label_rows_found_default_and_two_sheets(spark):
    a = sheet(spark, [["x"], ["n", " CODE  (DI) "], ["code"]])
    b = sheet(spark, [["x"], [None, "y"]], tab="T", no=1)
    late = sheet(spark, [["x"]] * 12 + [["code di"]], name="b.xls")
    h = SH.label_rows(a.unionByName(b).unionByName(late), SH.CODE_LABELS, default=3)
    assert sorted(rows(h)) == [("a.xls", "S", 1), ("a.xls", "T", 3), ("b.xls", "S", 3)]


def test_label_rows_in_one_column_of_the_whole_sheet(spark):
    a = sheet(spark, [["Counterparty"]] + [["x", "y"]] * 20 + [["x", " counterparty"]])
    assert rows(SH.label_rows(a, ["Counterparty"], default=0, search_rows=None, letter="B"), "header_row") == [(21,)]


def test_code_column_by_alias_order_first_column_and_missing(spark):
    a = sheet(spark, [["Code", "code di", "Code DI"], ["p", "q", "r"]])
    b = sheet(spark, [["Class"], ["p"]], name="b.xls")
    both = a.unionByName(b)
    h = SH.code_columns(both, SH.label_rows(both, SH.CODE_LABELS, default=0))
    assert sorted(rows(h)) == [("a.xls", "S", 0, 1), ("b.xls", "S", 0, None)]
    assert rows(SH.body(both, h).orderBy("source_file"), "code") == [("q",), (None,)]


@pytest.mark.parametrize("block", [2, 4096])
@pytest.mark.parametrize(
    ("codes", "kept"),
    [
        (["a", "b", None, "c"], 2),
        ([None, "a"], 0),
        (["a", " ", "b"], 1),
        (["a", "b", "c", "d", "e"], 5),
        (["a", "b", "c", "d", "missing", "f"], 4),
        (["a"] * 7 + [None] + ["b"] * 9, 7),
        ([], 0),
    ],
)
def test_until_first_blank(spark, monkeypatch, block, codes, kept):
    monkeypatch.setattr(SH, "BLOCK_ROWS", block)
    grid = [["Code DI"]] + [None if c == "missing" else [c] for c in codes]
    r = sheet(spark, grid)
    b = SH.body(r, SH.code_columns(r, SH.label_rows(r, SH.CODE_LABELS, default=3)))
    got = [x for (x,) in rows(SH.until_first_blank(b).orderBy("row_idx"), "code")]
    assert got == codes[:kept]


def test_first_blank_is_found_per_sheet(spark):
    r = sheet(spark, [["Code"], ["a"], [None], ["b"]]).unionByName(sheet(spark, [["Code"], ["c"], ["d"]], tab="T", no=1))
    b = SH.body(r, SH.code_columns(r, SH.label_rows(r, SH.CODE_LABELS, default=3)))
    assert sorted(rows(SH.until_first_blank(b), "sheet", "code")) == [("S", "a"), ("T", "c"), ("T", "d")]


def test_cells_beyond_the_width_and_na_tokens_are_null(spark):
    r = SH.blank_tokens(sheet(spark, [["1", "N/A"]]), ["N/A"])
    assert rows(r.select(SH.cell("A"), SH.cell("B"), SH.cell("DU"))) == [("1", None, None)]
    assert rows(SH.cells_of(r), "row_idx", "col_idx", "value") == [(0, 0, "1")]


@pytest.mark.parametrize(("b3", "want"), [("30/06/1995", "1995-06-30"), ("34880", "1995-06-30"), (None, None), ("x", None)])
def test_run_date_from_the_report_or_given(spark, b3, want):
    r = sheet(spark, [["a"], ["a"], ["Date", b3]])
    assert rows(enrich.run_date_of(SH.run_date_cells(r)).select(F.col("run_date").cast("string"))) == [(want,)]
    given = enrich.run_date_of(SH.run_date_cells(r), "2025-01-02")
    assert rows(given.select(F.col("run_date").cast("string"))) == [("2025-01-02",)]


def test_report_amounts_use_each_sheets_columns(spark):
    def line(width, **cells):
        from ledgerlens.operators.grid import letter_to_index_py as at

        by = {at(k): v for k, v in cells.items()}
        return [by.get(i) for i in range(width)]

    main = sheet(spark, [["t"], line(50, B="Classif DI"), line(50, B="K", E="P", AN="1", AW="2")], tab=SH.REPORT_SHEETS[0][0])
    fwd = sheet(spark, [["t"], line(6, C="P", E="3"), line(4, C="Q")], tab="BND FWD", no=1)
    out = SH.union_all(SH.report_amounts(main.unionByName(fwd), lambda c: c.cast("double")))
    assert sorted(rows(out), key=str) == [("Forward", "P", 3.0, None), ("Forward", "Q", None, None), ("K", "P", 1.0, 2.0)]


def test_reader_keeps_sheets_apart_and_can_take_the_first(spark, tmp_path):
    path = str(tmp_path / "rows")
    sheet(spark, [["a"]]).unionByName(sheet(spark, [["b"]], tab="T", no=1)).write.parquet(path)
    assert read_sheet_rows(spark, path).count() == 2
    assert rows(read_sheet_rows(spark, path, first_sheet=True), "sheet") == [("S",)]


def test_body_rows_are_not_regrouped(spark):
    """Rows reach their record by one join with a table of one row per sheet."""
    r = sheet(spark, [["Code"], ["a"]])
    h = SH.code_columns(r, SH.label_rows(r, SH.CODE_LABELS, default=3))
    plan = SH.body(r, h).select(SH.cell("A"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") <= 4


def test_source_status(spark):
    from ledgerlens.sources import files

    listing = spark.createDataFrame([("in", "IR_1.xls"), ("in", None), ("old", "x.csv")], "folder string, file_name string")
    wanted = [("in", "IR_*.xls"), ("in", "*.zip"), ("gone", "*.zip")]
    assert sorted(rows(files.source_status(listing, wanted))) == [
        ("gone", "*.zip", 0, "missing source"), ("in", "*.zip", 0, "no match"), ("in", "IR_*.xls", 1, "found")]
    assert sorted(rows(files.source_status(listing.limit(0), wanted), "status")) == [("missing source",)] * 3


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_read_cells(spark, tmp_path, fmt):
    from ledgerlens.sources.cells import CELLS_SCHEMA, read_cells

    path = str(tmp_path / fmt)
    cells = spark.createDataFrame([("a.xls", 0, 1, "Class"), ("a.xls", 1, 1, "1,5")], CELLS_SCHEMA)
    (cells.write.option("header", True).csv if fmt == "csv" else cells.write.parquet)(path)
    assert sorted(rows(read_cells(spark, path, fmt))) == sorted(rows(cells))


def test_rows_are_not_shuffled_to_their_sheet(spark, tmp_path):
    """Rows meet the per-sheet tables by a broadcast, whatever the rows' own size."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import sheets as SH

    cells = F.array(F.when(F.col("id") == 2, "code").otherwise(F.concat(F.lit("S"), F.xxhash64("id").cast("string"))))
    spark.range(40_000).select(
        F.lit("a.xls").alias("source_file"), F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_no"),
        F.col("id").cast("int").alias("row_idx"), cells.alias("values")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        kept = SH.until_first_blank(SH.body(rows, SH.code_columns(rows, SH.label_rows(rows, ["code"], default=0))))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert kept.count() == 39_997
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
