"""Cells binding G (FIXTURES.md section C): three dealer extracts with
different layouts, built from every lineitem row.

File ``IR_<f>.xls`` holds the lineitem rows with ``l_suppkey % 3 = f``;
``IR_0`` has a plain header, ``IR_1`` a reordered and differently spelled
one, ``IR_2`` a two-row header.  Body rows are numbered from 6 in lineitem
order with ``sequential_index`` (range partitioning, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.placement import sequential_index
from ..session import discard, materialize_compact
from .bindings import LINEITEM_ORDER, _classif_of
from .tables import table

CELLS_SCHEMA = "source_file string, row_idx int, col_idx int, value string"

# Header cells of the three layouts (file, row, col, text).
HEADER_CELLS = (
    (0, 5, 0, "#Ticket"), (0, 5, 1, "Custom Attribute5 Value"), (0, 5, 2, "Class"), (0, 5, 3, "Counterparty"),
    (0, 5, 4, "Notional"), (0, 5, 5, "Notional"), (0, 5, 6, "Dirty Value"),
    (1, 3, 0, "Counterparty"), (1, 3, 1, " class "), (1, 3, 2, "CUSTOM  ATTRIBUTE5 VALUE"), (1, 3, 3, "#ticket"),
    (1, 3, 4, "Notional"), (1, 3, 5, "Dirty Value"), (1, 3, 6, "Notional"),
    (2, 2, 0, "#Ticket"), (2, 2, 1, "Custom Attribute5 Value"), (2, 2, 2, "Class"), (2, 2, 3, "Counterparty"),
    (2, 2, 4, "Leg 1"), (2, 2, 5, "Leg 2"),
    (2, 3, 4, "Notional"), (2, 3, 5, "Notional"), (2, 3, 6, "Dirty Value"),
)
# Body column k -> position in IR_1 (reordered layout).
IR1_POSITIONS = {0: 3, 1: 2, 2: 1, 3: 0, 5: 6, 6: 5}
BODY_START = 6
# the columns of the lineitem order that cells are made of, which are its first:
# rows alike in them give the same cells, in whichever order they are numbered
CELL_ORDER = LINEITEM_ORDER[:LINEITEM_ORDER.index("l_discount") + 1]


def file_name(f) -> F.Column:
    return F.concat(F.lit("IR_"), f.cast("string"), F.lit(".xls"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", *CELL_ORDER).withColumn("f", F.col("l_suppkey") % 3)
    numbered = sequential_index(li, list(CELL_ORDER), group_cols=["f"], name="row_idx", start=BODY_START)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    values = [
        F.col("l_orderkey").cast("string"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("SWAP_"), F.col("l_partkey").cast("string"))),
        _classif_of(F.col("l_partkey")),
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")),
        price.cast("string"),
        F.col("l_quantity").cast("decimal(12,2)").cast("string"),
        (price * F.col("l_discount").cast("decimal(4,2)")).cast("string"),
    ]
    cells_k = numbered.select(
        "f", "row_idx",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in enumerate(values)])).alias("c"),
    ).where(F.col("c.value").isNotNull())
    k = F.col("c.k")
    remap = F.lit(None).cast("int")
    for src, dst in IR1_POSITIONS.items():
        remap = F.when(k == src, F.lit(dst)).otherwise(remap)
    col_idx = F.when(F.col("f") == 1, F.coalesce(remap, k)).otherwise(k)
    body = cells_k.select(
        file_name(F.col("f")).alias("source_file"),
        F.col("row_idx").cast("int").alias("row_idx"),
        col_idx.cast("int").alias("col_idx"),
        F.col("c.value").alias("value"),
    )
    head = spark.createDataFrame(
        [(f"IR_{f}.xls", r, c, v) for f, r, c, v in HEADER_CELLS], CELLS_SCHEMA
    )
    # reused by every grid step: written once under the checkpoint folder
    stored = materialize_compact([head.unionByName(body)], "cells")
    discard(numbered)
    return stored


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-5: a cells table (one row per non-blank cell) from parquet or CSV."""
    if fmt == "csv":
        return spark.read.schema(CELLS_SCHEMA).option("header", True).csv(path)
    return spark.read.parquet(path).select("source_file", "row_idx", "col_idx", "value")
