"""Row-form writing, layouts, the wide mapping and numbering from the read position."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlens.functions import parse_number
from ledgerlens.operators import dims, mapping
from ledgerlens.operators import sheets as SH
from ledgerlens.operators.placement import numbered_as_read, with_read_position
from ledgerlens.plans import extract_queries
from ledgerlens.sources.sheets import ROWS_SCHEMA

SF = "/root/testdata/sf0.001"


def sheet(spark, grid, name="a.xls", tab="S", no=0):
    return spark.createDataFrame([(name, tab, no, i, v) for i, v in enumerate(grid) if v is not None], ROWS_SCHEMA)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["a", "b", "c", "d", "e"], ["a", "X", "c", "Y", "e"]),
        (["a"], ["a", "X", None, "Y"]),
        ([], [None, "X", None, "Y"]),
    ],
)
def test_put_cells_fills_up_short_rows(spark, values, want):
    df = spark.createDataFrame([(values,)], "values array<string>")
    out = df.select(SH.put_cells(F.col("values"), {"D": F.lit("Y"), "B": F.lit("X")}).alias("v"))
    assert rows(out) == [(want,)]


def test_marks_are_written_up_to_the_first_blank_code(spark):
    def row(code, m=None, an=None, aw=None):
        out = [None] * 80
        for letter, v in {"A": code, "M": m, "AN": an, "AW": aw, "AO": "0.5"}.items():
            out[SH.letter_to_index_py(letter)] = v
        return out

    grid = [["x"], ["Code DI"], row("c1", "100", "10"), row("c2", "100", "10", "old"), row("c3", "0", None), row(" "), row("c1", "100", "10", "after")]
    r = sheet(spark, grid)
    heads = SH.code_columns(r, SH.label_rows(r, SH.CODE_LABELS, default=3))
    marks = spark.createDataFrame([("c1", 4.0), ("c3", 0.0)], "code string, mtm_cpty double")
    w = SH.write_marks(r, heads, marks, parse_number).orderBy("row_idx")
    got = rows(w.select("matched", "inside", SH.cell("AW"), *[parse_number(SH.cell(x)) for x in ("AX", "BD", "BE", "BK", "BS", "BT", "CA", "CB")]))
    none = (None,) * 8
    assert got == [
        (False, False, None, *none), (False, False, None, *none),
        (True, True, "4.0", 0.04, 6.0, 0.06, 6.0, 4.0, 0.44, -2.0, pytest.approx(-0.02)),
        (False, True, "old", *none),
        (True, True, "0.0", None, 0.0, None, 0.0, 0.0, 0.5, 0.0, None),
        (False, False, None, *none), (False, False, "after", *none),
    ]
    before = {v[3]: v[4] for v in rows(r)}
    for i, values, matched in rows(w, "row_idx", "values", "matched"):
        if not matched:
            assert values == before[i]


def test_layout_drops_columns_without_body_cells(spark):
    head = ["Class", "Notional", "Notional", "Unnamed: 3", "Rate.1", "Counterparty"]
    r = sheet(spark, [["x"], head, ["a", None, "1", "u", "r", None], ["b", None, "2"]])
    headers, lay = SH.prepare(r, dims.expected_headers(spark))
    assert rows(headers, "header_row", "body_start") == [(1, 2)]
    assert rows(lay.orderBy("col_idx"), "col_idx", "label") == [(0, "Class"), (2, "Notional"), (3, ""), (4, "Rate (Leg2)")]


def test_records_are_projected_per_file(spark):
    a = sheet(spark, [["Class", "Custom Attribute5 Value", "Currency"], ["x", "C1", "EUR"], ["y"]], name="a.xls")
    b = sheet(spark, [["n"], ["Custom Attribute5 Value", "Class"], ["C2", "z"]], name="b.xls")
    r = a.unionByName(b)
    headers, lay = SH.prepare(r, dims.expected_headers(spark))
    m = mapping.compile_mapping({"columns": [{"target": "Class", "source": "Class"}, {"target": "X", "source_letter": "C"}]})
    rec = mapping.sheet_records(r, headers, lay, m)
    assert sorted(rows(rec, "`N:class`", "`L:C`", "`N:custom attribute5 value`"), key=str) == sorted(
        [("x", "EUR", "C1"), ("y", None, None), ("z", None, "C2")], key=str)


def test_wide_mapping_does_not_move_body_rows(spark):
    plan = extract_queries.extract_mapping(spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
    assert not shuffles and "SortMergeJoin" not in plan


@pytest.mark.parametrize("files", [1, 7])
def test_numbers_follow_the_read_position(spark, tmp_path, files):
    n, path = 5000, str(tmp_path / "t")
    spark.range(n).repartitionByRange(files, "id").sortWithinPartitions("id").write.option("parquet.block.size", 4096).parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        stored = with_read_position(spark.read.parquet(path))
        keep = set(random.Random(files).sample(range(n), 1800))
        kept = stored.where(F.col("id").isin(*keep)).select("id", "_file", "_split")
        got = dict(rows(numbered_as_read(kept, "at", start=7), "id", "at"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {v: i + 7 for i, v in enumerate(sorted(keep))}


def test_numbering_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    stored = with_read_position(spark.read.parquet(path))
    assert rows(numbered_as_read(stored.where("id > 10"), "at")) == []


def test_only_the_chosen_productions_are_read(spark):
    from ledgerlens.plans import sheet_queries
    from ledgerlens.sources import productions as P

    path, chosen = sheet_queries._chosen(spark, SF)
    read = P.read_productions(spark, path, chosen)
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    files = {f for (f,) in rows(read.select("source_file").distinct())}
    assert files == {"1995/06-1995/fast/IFT - 15-06-1995.xlsm", "1995/03-1995/close/IFT - 15-03-1995.xlsm"}
    assert spark.read.parquet(path).select(*P.PLACE).distinct().count() > 100


def test_label_cells(spark):
    a = sheet(spark, [["x", None, "y"], [None, " prix  GAM"], ["Prix GAM"]])
    b = sheet(spark, [["x"]], name="b.xls")
    assert rows(SH.label_cells(a.unionByName(b), "Prix GAM")) == [("a.xls", "S", 1, 1)]
    assert rows(SH.label_cells(a, "prix gam", row=2)) == [("a.xls", "S", 2, 0)]
