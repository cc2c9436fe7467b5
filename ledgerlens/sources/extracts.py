"""Dealer extracts in row form at their real width (125 columns, up to DU).

Every order is one body row.  Files hold bounded blocks of order keys, so their
number grows with the data; three layouts alternate: a plain header, one whose
second row adds the amounts, and a narrower one that lacks a column.  Each has
an unnamed column, a headed column without cells, a dotted header and repeated
labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import _classif_of
from .sheets import ROWS_SCHEMA, _texts, _values
from .tables import table

WIDTH = 125
LAYOUTS = 3
BLOCK_KEYS = 1_000_000
# Labels of the two legs and of the three groups of amounts.
LEG_LABELS = ("Leg Type", "Pay/Rec", "Index/Fixed Rate", "Spread (bp)", "Start Date", "End Date")
LEG_LETTERS = (("AR", "AS", "AT", "AU", "AV", "AW"), ("BI", "BJ", "BK", "BL", "BM", "BN"))
NOTIONAL_LETTERS = ("AX", "BP")
AMOUNT_LABELS = ("Dirty Value", "Clean Value", "Accrued Interest")
AMOUNT_LETTERS = (("DA", "DB", "DC"), ("DL", "DM", "DN"), ("DS", "DT", "DU"))
# Letters of the named columns in each layout (the third has no currency).
NAMED_LETTERS = (
    {"ticket": "A", "external": "C", "cpty": "D", "currency": "E", "class": "F", "code": "G"},
    {"ticket": "E", "external": "D", "cpty": "A", "currency": "F", "class": "B", "code": "C"},
    {"ticket": "A", "external": "B", "cpty": "D", "class": "E", "code": "G"},
)
# Their labels, and the other headed columns (one without cells).
NAMED_LABELS = (
    {"ticket": "#Ticket", "external": "External Id", "cpty": "Counterparty", "currency": "Currency", "class": "Class", "code": "Custom Attribute5 Value"},
    {"ticket": "#ticket", "external": "external  id", "cpty": "Counterparty", "currency": "currency", "class": " class ", "code": "CUSTOM  ATTRIBUTE5 VALUE"},
    {"ticket": "#Ticket", "external": "External Id", "cpty": "Counterparty", "class": "Class", "code": "Custom Attribute5 Value"},
)
OTHER_LABELS = (
    {"H": "Unnamed: 7", "I": "Comment", "J": "Fixing.1"},
    {"H": "Unnamed: 7", "I": "Comment", "J": "Fixing.2"},
    {"C": "Counterparty", "F": "Class", "H": "Unnamed: 7", "I": "Comment", "J": "Fixing.1"},
)
HEADER_ROW = (5, 3, 2)
SECOND_ROW = 1  # the layout whose amounts are labelled one row below
BODY_ROW = (6, 5, 3)
NARROW, NARROW_WIDTH = 2, 124


def _labels(layout: int) -> list[tuple[int, list[str | None]]]:
    """Header rows of a layout: (row, cell texts)."""
    named = {NAMED_LETTERS[layout][k]: v for k, v in NAMED_LABELS[layout].items()}
    legs = {x: v for letters in LEG_LETTERS for x, v in zip(letters, LEG_LABELS, strict=True)}
    legs |= dict.fromkeys(NOTIONAL_LETTERS, "Notional")
    amounts = {x: v for letters in AMOUNT_LETTERS for x, v in zip(letters, AMOUNT_LABELS, strict=True)}
    width, row = NARROW_WIDTH if layout == NARROW else WIDTH, HEADER_ROW[layout]
    first = named | OTHER_LABELS[layout] | legs
    if layout != SECOND_ROW:
        return [(0, _texts(width, {"B": "Extract"})), (row, _texts(width, first | amounts))]
    return [(0, _texts(width, {"B": "Extract"})), (row, _texts(width, first)), (row + 1, _texts(width, amounts))]


def body_cells(layout: int) -> dict[str, Column]:
    """The body cells of a layout by letter, over the orders table."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice").cast("decimal(12,2)")
    rate = (k % 11).cast("int") * F.lit("0.01").cast("decimal(4,2)")
    tax = (k % 7).cast("int") * F.lit("0.01").cast("decimal(4,2)")
    lots = (k % 50 + 1).cast("int")
    bad = F.when(k % 4 == 0, "N/A").when(k % 4 == 1, "  ").when(k % 4 == 2, "-")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    named = {
        "ticket": k.cast("string"),
        "external": F.concat(F.lit("EXT"), cust.cast("string")),
        "cpty": F.concat(F.lit("Supplier#"), (k % 50).cast("string")),
        "currency": F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit("GBP")), (k % 3 + 1).cast("int")),
        "class": _classif_of(cust),
        "code": F.when(k % 13 == 0, bad).otherwise(F.concat(F.lit(" SWAP_"), cust.cast("string"), F.lit(" "))),
    }
    legs = {}
    for i, letters in enumerate(LEG_LETTERS):
        serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")) + lots * (i + 1)
        legs |= dict(zip(letters, (
            F.when((k + i) % 2 == 0, "Fixed").otherwise("Float"),
            F.when((k + i) % 2 == 0, "P").otherwise("R"),
            F.when(k % 3 == 0, "HICPXT").otherwise(comma(rate)),
            F.when(k % 5 == i, F.lit(None)).otherwise(comma(tax)),
            F.date_format("o_orderdate", "dd/MM/yyyy" if i == 0 else "yyyy-MM-dd"),
            F.when(k % 17 == 0, "n.c.").otherwise(serial.cast("string")),
        ), strict=True))
    notionals = dict(zip(NOTIONAL_LETTERS, (
        F.when(k % 19 == 0, "0").otherwise(price.cast("string")),
        F.when(k % 23 != 0, F.concat(F.lit(" "), comma(price * 2))),
    ), strict=True))
    amounts = dict(zip(AMOUNT_LETTERS, (
        ((price + lots) * rate, (price + lots) * tax, lots),
        (price * rate, price * tax, F.when(k % 41 == 0, F.lit("abc")).otherwise((price * rate - price * tax).cast("string"))),
        (lots * rate, lots * tax, F.when(k % 29 != 0, lots)),
    ), strict=True))
    other = {"H": F.lit("x"), "J": (k % 10).cast("string")}
    if layout == NARROW:
        other["F"] = F.lit("second")
    cells = {x: named[n] for n, x in NAMED_LETTERS[layout].items()} | legs | notionals | other
    return cells | {x: v for letters, vs in amounts.items() for x, v in zip(letters, vs, strict=True)}


def file_of(layout: int, block: Column) -> Column:
    return F.concat(F.lit(f"IFT_{layout}_"), F.lpad(block.cast("string"), 6, "0"), F.lit(".xls"))


def dealer_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracts' first sheets, rows in no particular order."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    block = F.floor(k / BLOCK_KEYS).cast("long")
    parts = []
    for layout in range(LAYOUTS):
        own = orders.where(k % LAYOUTS == layout)
        values = _values(WIDTH, body_cells(layout))
        if layout == NARROW:
            values = F.slice(values, 1, NARROW_WIDTH)
        row = F.floor(k % BLOCK_KEYS / LAYOUTS) + BODY_ROW[layout]
        parts.append(own.select(
            file_of(layout, block).alias("source_file"), F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_no"),
            row.cast("int").alias("row_idx"), values.alias("values"),
        ))
        heads = spark.createDataFrame(
            [(None, "Sheet1", 0, r, v) for r, v in _labels(layout)], ROWS_SCHEMA
        ).withColumn("layout", F.lit(layout))
        files = own.select(file_of(layout, block).alias("file")).distinct().withColumn("layout", F.lit(layout))
        parts.append(files.join(F.broadcast(heads), "layout").select(  # two or three rows
            F.col("file").alias("source_file"), "sheet", "sheet_no", "row_idx", "values"
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_sheet_order(rows: DataFrame) -> DataFrame:
    """Rows as a workbook store holds them: files one after another, rows in order."""
    return rows.repartitionByRange("source_file", "sheet_no", "row_idx").sortWithinPartitions("source_file", "sheet_no", "row_idx")
