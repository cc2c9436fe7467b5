"""Stored productions: report workbooks in row form, one partition a file.

A production table is partitioned by year, month folder, mode and file, as runs
are laid out on disk.  Which file a run compares with is decided on the listing
alone; the rows are then read by a join on the partition columns with one row
for each chosen file, so that Spark prunes all other files when it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sheets import REPORT_SHEETS
from . import files as FS
from .bindings import _classif_of
from .sheets import _texts, _values
from .tables import table

PLACE = ("year", "month", "mode", "file")
# Sheets and header row (0-based) of a production.
MAIN, FORWARD = REPORT_SHEETS[0][0], REPORT_SHEETS[1][0]
HEADER_ROW = 5
MAIN_WIDTH, FORWARD_WIDTH = 40, 7
# Column of the forward price by mode, and its header row.
PRICE_LETTER, PRICE_ROW = {"fast": "E", "close": "G"}, {"fast": 1, "close": 3}


def production_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order on the main sheet of a production of its month, each fifth
    also on the forward sheet; a tenth in an earlier draft of the file."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.year(d).alias("year"), F.date_format(d, "MM-yyyy").alias("month"),
        F.when(k % 2 == 0, "fast").otherwise("close").alias("mode"),
        F.when(k % 10 >= 8, F.concat(F.lit("IFT - 02-"), F.date_format(d, "MM-yyyy"), F.lit(".xlsx"))).otherwise(
            F.concat(F.lit("IFT - 15-"), F.date_format(d, "MM-yyyy"), F.lit(".xlsm"))).alias("file"),
    )
    total = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    classif = F.when(k % 9 == 1, F.lit(None)).when(k % 9 == 2, "  ").otherwise(
        F.concat(F.lit(" "), _classif_of(F.col("o_custkey")), F.lit(" ")))
    amount = F.when(k % 41 == 0, "N/A").when(k % 43 != 0, F.replace(total, F.lit("."), F.lit(",")))

    def rows(df, sheet, no, row, values):
        return df.select(*PLACE, F.lit(sheet).alias("sheet"), F.lit(no).alias("sheet_no"), row.cast("int").alias("row_idx"), values.alias("values"))

    parts = [rows(orders, MAIN, 0, k + HEADER_ROW + 1, _values(MAIN_WIDTH, {"B": classif, "AN": amount}))]
    heads = [(MAIN, 0, HEADER_ROW, m, _texts(MAIN_WIDTH, {"B": "Classif  DI", "AN": "Dirty"})) for m in PRICE_LETTER]
    for mode, letter in PRICE_LETTER.items():
        own = orders.where((F.col("mode") == mode) & (k % 5 < 2))
        parts.append(rows(own, FORWARD, 1, k + PRICE_ROW[mode] + 1, _values(FORWARD_WIDTH, {letter: F.when(k % 7 != 0, total)})))
        heads.append((FORWARD, 1, PRICE_ROW[mode], mode, _texts(FORWARD_WIDTH, {"A": "Nom", letter: " prix  GAM "})))
    top = spark.createDataFrame(heads, "sheet string, sheet_no int, row_idx int, mode string, values array<string>")
    files = orders.select(*PLACE).distinct()
    parts.append(files.join(F.broadcast(top), "mode").select(*PLACE, "sheet", "sheet_no", "row_idx", "values"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_productions(rows: DataFrame, path: str) -> None:
    rows.repartition(*PLACE).write.partitionBy(*PLACE).parquet(path)


def list_productions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: folder, file_name, year, month, mode of every stored production,
    from the listing of its files; no row is read."""
    at = lambda name: F.regexp_extract("folder", rf"/{name}=([^/]*)", 1)
    places = FS.list_files(spark, path, "*.parquet").select(*[F.url_decode(at(c)).alias(c) for c in PLACE]).distinct()
    return places.select(
        F.concat_ws("/", "year", "month", "mode").alias("folder"), F.col("file").alias("file_name"),
        F.col("year").cast("int").alias("year"), "month", "mode",
    )


def chosen_productions(listing: DataFrame, runs: DataFrame) -> DataFrame:
    """SRC-14, SRC-15, SRC-16: ``production`` (current, previous) and place of the
    files that each run of ``runs`` (run_date, mode) compares: one row a side."""
    month = F.date_format("run_date", "MM-yyyy")
    r = runs.withColumn("folder", F.concat_ws("/", F.year("run_date").cast("string"), month, F.lower("mode")))
    current = FS.current_production(r, listing).select(
        F.lit("current").alias("production"), F.year("run_date").alias("year"), month.alias("month"),
        F.lower("mode").alias("mode"), F.col("current").alias("file"),
    )
    winners = FS.latest_by_name_date(listing, ("year", "month", "mode")).select(
        "year", F.substring("month", 1, 2).cast("int").alias("month"), "mode", "latest")
    previous = FS.previous_production(runs, winners).select(
        F.lit("previous").alias("production"), F.col("t_year").alias("year"),
        F.concat_ws("-", F.lpad(F.col("t_month").cast("string"), 2, "0"), F.col("t_year").cast("string")).alias("month"),
        F.col("t_mode").alias("mode"), F.col("previous").alias("file"),
    )
    return current.unionByName(previous).where(F.col("file").isNotNull())


def read_productions(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen files only, with ``production`` and ``source_file``.

    ``chosen`` has two rows for each run that somebody asks for, so it is
    broadcast; its places prune the partitions when the query runs."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(chosen), list(PLACE)).withColumn(
        "source_file", F.concat_ws("/", F.col("year").cast("string"), "month", "mode", "file"))
