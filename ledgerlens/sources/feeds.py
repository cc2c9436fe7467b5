"""Delimited inputs: counterparty feed (SRC-6/7), override table (SRC-9),
alias text (SRC-11), collateral report (SRC-8).

Files are read with Spark's own readers, every column as text, and bound by
*name*, never by position: a schema passed to ``spark.read.csv`` over many
files binds positionally and would silently swap columns of files whose
header order differs.  ``read_delimited`` therefore zips each line with its
own file's header (one distributed pass, see there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_number, strip_ws
from ..operators import dims
from . import records

# The NA tokens a pandas CSV/Excel read turns into missing values.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Counterparty feed columns.
FEED_REQUIRED = ("FREE_TEXT_2", "MTM_VALUE", "MTM_DIFF")
FEED_OPTIONAL = ("FREE_TEXT_1", "BOOK", "CP", "NOTIONAL")


def na_to_null(df: DataFrame, columns=None) -> DataFrame:
    """SRC-7: pandas-style NA tokens -> null (Spark's nullValue takes one token)."""
    cols = columns or df.columns
    return df.withColumns({c: F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)) for c in cols})


def read_delimited(
    spark: SparkSession, paths, sep: str = ";", columns: tuple[str, ...] = FEED_REQUIRED + FEED_OPTIONAL
) -> tuple[DataFrame, DataFrame]:
    """Read delimited files as text columns bound by each file's own header.

    Returns (rows, layouts): see ``bind_lines``.  The lines are stored once with
    their places; quoted fields may hold line feeds (``records``).
    """
    return bind_lines(records.records(records.stored_lines(spark, paths, sep)), sep, columns)


def line_position() -> Column:
    """Position of a text line inside its file: (split offset, row in the split).

    Rows of one split come in file order, so the pair orders a file's lines.
    """
    return F.struct(
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
    ).alias("position")


def split_fields(line: Column, sep: str) -> Column:
    """All fields of a delimited line, quotes honoured, none dropped."""
    q = _re_quote(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{q}("(?:[^"]|"")*"(?={q}|$)|[^{q}]*)'), 1)

    def unquote(x: Column) -> Column:
        inner = F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.when((F.length(x) >= 2) & x.startswith('"') & x.endswith('"'), inner).otherwise(x)

    return F.transform(raw, unquote)


def bind_lines(
    lines: DataFrame, sep: str = ";", columns: tuple[str, ...] = FEED_REQUIRED + FEED_OPTIONAL
) -> tuple[DataFrame, DataFrame]:
    """``(line, source_file, position)`` rows -> (rows bound by each file's
    header, layouts).  Shared by the batch reader and the file stream.

    The header is a file's first line that is not blank, without a byte-order
    mark; header names are trimmed, blank ones keep their place, of repeated
    ones the first counts.  ``rows`` holds ``source_file``, ``position``, each
    of ``columns`` (null where the file lacks it) and ``extra_fields``, the
    fields beyond the header.  No file is dropped: ``layouts`` has one row for
    each with its header, for the CHK-1 / CHK-2 checks.
    """
    lines = lines.where(strip_ws(F.replace("line", F.lit("\ufeff"), F.lit(""))) != "")
    first = lines.groupBy("source_file").agg(
        F.min("position").alias("header_position"), F.min_by("line", "position").alias("header_line")
    )
    names = F.transform(
        split_fields(F.regexp_replace("header_line", "^\ufeff", ""), sep), lambda x: strip_ws(x)
    )
    heads = first.select("source_file", "header_position", names.alias("header"))
    body = lines.join(heads, "source_file").where(F.col("position") > F.col("header_position"))
    fields = body.select("source_file", "position", "header", split_fields(F.col("line"), sep).alias("_f"))
    value = lambda n: F.get("_f", F.array_position("header", n).cast("int") - 1)
    extra = F.slice("_f", F.size("header") + 1, F.greatest(F.size("_f") - F.size("header"), F.lit(0)))
    rows = fields.select("source_file", "position", *[value(n).alias(n) for n in columns], extra.alias("extra_fields"))
    return na_to_null(rows, columns), heads.select("source_file", "header")


def _re_quote(sep: str) -> str:
    import re

    return re.escape(sep)


def feed_from_text(rows: DataFrame) -> DataFrame:
    """SRC-6 + CHK-2: typed counterparty feed from text columns.

    Optional columns missing from every file are filled with null; amounts
    use the European number rule (NUM-1).
    """
    for c in FEED_OPTIONAL:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.select(
        F.col("FREE_TEXT_2").alias("free_text_2"),
        F.col("FREE_TEXT_1").alias("free_text_1"),
        F.col("BOOK").alias("book"),
        F.col("CP").alias("cp"),
        parse_number("NOTIONAL").alias("notional"),
        parse_number("MTM_VALUE").alias("mtm_value"),
        parse_number("MTM_DIFF").alias("mtm_diff"),
        *[c for c in ("source_file",) if c in rows.columns],
    )


def missing_columns(layouts: DataFrame, expected: tuple[str, ...], kind: str) -> DataFrame:
    """CHK-1 / CHK-2: per file, the expected columns its header lacks."""
    exp = F.array(*[F.lit(c) for c in expected])
    return layouts.select(
        "source_file",
        F.lit(kind).alias("check"),
        F.array_sort(F.array_except(exp, F.col("header"))).alias("missing"),
    ).where(F.size("missing") > 0)


def override_table(spark: SparkSession, text: str = dims.OVERRIDE_TSV) -> DataFrame:
    """SRC-9: inline tab-separated override table with decimal comma.

    The codes are stripped (the inline text carries indentation).
    """
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line_no int, line string")
    parts = F.split(F.col("line"), "\t")
    body = lines.where((F.col("line_no") > 0) & (strip_ws("line") != ""))
    return body.select(
        strip_ws(parts.getItem(0)).alias("code"),
        parse_number(parts.getItem(1), "eu").alias("value"),
    )
