"""Row-form sheets: reader and the bindings built from the driver tables.

``report_sheets``: three report workbooks of two sheets (every order on the
main sheet, every customer on the forward sheet), with headers at different
rows, footers behind a gap and the run date in B3.  ``sensitivity_sheets``:
three sensitivity extracts, two rows per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import letter_to_index_py as at
from ..operators.sheets import REPORT_SHEETS, union_all
from .bindings import _classif_of
from .tables import table

ROWS_SCHEMA = "source_file string, sheet string, sheet_no int, row_idx int, values array<string>"

# Header row and code column of each file.
REPORT_HEAD, REPORT_CODE = (5, 7, 3), ("C", "D", "A")
FORWARD_HEAD = (4, 0, 0)
SENSI_HEAD, SENSI_CODE = (2, 5, 3), ("E", "A", "C")
# B3 of each report file (text, serial number, blank).
RUN_DATE_CELLS = ("30/06/1995", "34880", None)
FOOTER_START = 1_000_000_000
REPORT_WIDTH = 80  # up to CB
FILES = 3


def read_sheet_rows(spark: SparkSession, path: str, first_sheet: bool = False) -> DataFrame:
    """SRC-5: sheets in row form, without a header; only the first sheet of
    each file where asked."""
    rows = spark.read.schema(ROWS_SCHEMA).parquet(path)
    return rows.where(F.col("sheet_no") == 0) if first_sheet else rows


def _values(width: int, cells: dict[str, Column]) -> Column:
    by_index = {at(k): v for k, v in cells.items()}
    return F.array(*[by_index.get(i, F.lit(None)).cast("string") for i in range(width)])


def _of_file(values, f: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (f + 1).cast("int"))


def _texts(width: int, cells: dict[str, str]) -> list[str | None]:
    by_index = {at(k): v for k, v in cells.items()}
    return [by_index.get(i) for i in range(width)]


def _code_cells(f: Column, letters, code: Column) -> dict[str, Column]:
    return {x: F.when(f == i, code) for i, x in enumerate(letters)}


def _rows(df: DataFrame, f: Column, prefix: str, suffix: str, sheet: str, no: int, row: Column, values: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(prefix), f.cast("string"), F.lit(suffix)).alias("source_file"), F.lit(sheet).alias("sheet"),
        F.lit(no).alias("sheet_no"), row.cast("int").alias("row_idx"), values.alias("values"),
    )


def report_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, forward = REPORT_SHEETS[0][0], REPORT_SHEETS[1][0]
    heads = []
    for i in range(FILES):
        name = f"REPORT_{i}.xlsm"
        labels = {"B": ("Classif DI", " classif  di", "Class")[i], "E": "Counterparty", REPORT_CODE[i]: "Code DI"}
        heads.append((name, main, 0, 2, _texts(REPORT_WIDTH, {"B": RUN_DATE_CELLS[i]})))
        heads.append((name, main, 0, REPORT_HEAD[i], _texts(REPORT_WIDTH, labels)))
        if i < 2:
            heads.append((name, forward, 1, FORWARD_HEAD[i], _texts(11, {"C": "Counterparty"})))

    k = F.col("o_orderkey")
    f = k % FILES
    total = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    classif = _classif_of(F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    main_cells = _code_cells(f, REPORT_CODE, F.concat(F.lit(" SWAP_"), F.col("o_custkey").cast("string"))) | {
        "B": F.when(k % 8 == 0, F.replace(classif, F.lit(" "), F.lit("  "))).otherwise(classif),
        "E": F.when(k % 31 == 0, " TOTAL ").when(k % 37 == 0, " ").otherwise(
            F.concat(F.lit("Supplier#"), (k % 50).cast("string"))),
        "I": F.element_at(F.array(F.lit("HICPXT"), F.lit("frcpixt"), F.lit("OTHER")), (k % 7 % 3 + 1).cast("int")),
        "M": total,
        "AB": F.when(f == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")),
        "AN": F.when(k % 41 == 0, "N/A").when(k % 43 != 0, F.replace(total, F.lit("."), F.lit(","))),
        "AW": F.when(k % 41 == 0, "abc").otherwise(total),
        "AO": F.when(k % 47 != 0, F.concat(F.lit("0,"), F.lpad((k % 100).cast("string"), 2, "0"))),
        "BK": F.when(k % 2 == 0, "5"),
        "BL": F.concat(F.lit("-0."), F.lpad((k % 1000).cast("string"), 3, "0")),
        "T": F.lit("7"), "U": F.when(k % 2 == 0, "8,5"),
    }
    row = _of_file(REPORT_HEAD, f) + 1 + F.floor(k / FILES)
    parts = [_rows(orders, f, "REPORT_", ".xlsm", main, 0, row, _values(REPORT_WIDTH, main_cells))]

    n = F.col("n_nationkey")
    footers = table(spark, sf_dir, "nation", "n_nationkey").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FILES - 1))))
    foot_cells = _code_cells(F.col("f"), REPORT_CODE, F.concat(F.lit("TOTAL_"), n.cast("string"))) | {
        "E": F.lit("Total"), "AN": F.lit("1"), "AW": F.lit("1")}
    foot_cells["B"] = F.lit("CMS Swap")
    parts.append(_rows(footers, F.col("f"), "REPORT_", ".xlsm", main, 0, n + FOOTER_START, _values(REPORT_WIDTH, foot_cells)))

    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    balance = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    fwd_cells = {
        "C": F.when(c % 29 == 0, "Contrepartie").otherwise(F.concat(F.lit("CP"), (c % 9).cast("string"))),
        "E": F.replace(balance, F.lit("."), F.lit(",")),
        "F": F.when(c % 13 == 0, "null").otherwise(balance),
    }
    row = _of_file(FORWARD_HEAD, c % FILES) + 1 + F.floor(c / FILES)
    parts.append(_rows(customers, c % FILES, "REPORT_", ".xlsm", forward, 1, row, _values(11, fwd_cells)))
    return union_all([spark.createDataFrame(heads, ROWS_SCHEMA), *parts])


def sensitivity_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ("Code DI", " CODE  (DI) ", "Custom Attribute5 Value")
    heads = [(f"SENSI_{i}.xls", "Sheet1", 0, SENSI_HEAD[i], _texts(38, {SENSI_CODE[i]: labels[i]})) for i in range(FILES)]
    p = F.col("p_partkey")
    f, kk, size = p % FILES, F.col("kk"), F.col("p_size")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").withColumn(
        "kk", F.explode(F.array(F.lit(0), F.lit(1))))
    price = F.col("p_retailprice").cast("decimal(12,2)")
    code = F.when((kk == 1) & (p % 9 == 0), "NA").when((kk == 1) & (p % 9 == 4), "  ").otherwise(
        F.concat(F.when(p % 10 == 3, "UNUSED_").otherwise(" SWAP_"), p.cast("string"), F.lit(" ")))
    cells = _code_cells(f, SENSI_CODE, code) | {
        "X": F.when(size % 5 != 0, F.replace((price + kk).cast("string"), F.lit("."), F.lit(","))),
        "Y": size.cast("string"),
        "AC": F.when(p % 4 == 0, "N/A").otherwise((size + kk).cast("string")),
        "AD": F.when(size % 3 != 0, F.concat(F.lit("-"), price.cast("string"))),
        "AH": F.when(size % 4 == 0, price.cast("string")),
        "AL": (size * 2).cast("string"),
    }
    values = _values(38, cells)
    values = F.when(f == 1, F.slice(values, 1, 34)).otherwise(values)  # a narrower sheet
    row = _of_file(SENSI_HEAD, f) + 1 + F.floor(p / FILES) * 2 + kk
    return spark.createDataFrame(heads, ROWS_SCHEMA).unionByName(
        _rows(parts, f, "SENSI_", ".xls", "Sheet1", 0, row, values))
