"""Sheets in row form: several sheets per file, cells found by position
(SRC-5, SRC-7, GRD-2..6/8/10/11/15/16/19/20, AGG-2, JN-3, CTL-1/2/5/6, SNK-6, DIM-5).

A row is ``(source_file, sheet, sheet_no, row_idx, values)``: 0-based
positions, ``values`` the cell texts from column A on (null: blank cell), one
table row per sheet row.  A record is then a projection of ``values``: body
rows are never exploded, shuffled or regrouped.  What differs between sheets
(header row, code column, first gap) is a small table with one row per sheet,
stored before rows meet it: Spark then knows its size and does not shuffle the
rows of a sheet into one task for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import header_norm, norm_label, strip_ws
from ..session import materialize
from . import grid
from .grid import letter_to_index_py

KEYS = ("source_file", "sheet")
SEARCH_ROWS = 12  # fixed value: header search depth
BLOCK_ROWS = 4096  # rows counted together when looking for the first gap

# Sheets of the report and their columns (class, counterparty,
# own and counterparty amount); without a class column the class is given.
REPORT_SHEETS = (
    ("IRS - INF – XCCY", "B", "E", "AN", "AW", None),
    ("BND FWD", None, "C", "E", "F", "Forward"),
)
# Columns of a sensitivity extract.
SENSI_POSITIONS = {
    "duration_leg1": "Y", "sensi_leg1": "X", "duration_leg2": "AC", "sensi_leg2": "AD",
    "duration_total": "AL", "sensi_total": "AH",
}
# Columns of the main report sheet that the sensitivity step reads.
REPORT_POSITIONS = {"classif": "B", "index_rate": "I", "notional": "M", "end_date": "AB", "gap": "BL"}
# Columns of the main report sheet that the sensitivity step writes.
REPORT_SENSI_POSITIONS = {
    "duration_leg1": "T", "sensi_leg1": "U", "duration_leg2": "AK", "sensi_leg2": "AL",
    "duration_total": "AT", "sensi_total": "AU",
}
# Columns of the main report sheet that the marks step reads.
REPORT_MARK_INPUTS = {"notional": "M", "dirty_total": "AN", "dirty_pct": "AO"}
# Columns of the main report sheet that the marks step writes.
REPORT_MARK_POSITIONS = {
    "mtm_cpty": "AW", "mtm_cpty_pct": "AX", "mtm_gap": "BD", "mtm_gap_pct": "BE", "mtm_gap_ctl": "BK",
    "cmp_bs": "BS", "cmp_bt": "BT", "cmp_ca": "CA", "cmp_cb": "CB",
}
# Columns of the bond-forward sheet, from its second row on.
FORWARD_POSITIONS = {
    "free_text": "A", "book_norm": "B", "cp_out": "C", "notional_d": "D", "mtm_value_d": "E", "cpty_price": "F",
    "mtm_pct": "G", "cpty_pct": "H", "threshold": "I", "gap_pct": "J", "alert": "K",
}
FORWARD_START, FORWARD_WIDTH = 1, 12  # 0-based first row; columns A..L are cleared
CODE_LABELS = ("code di", "code")
CODE_ALIASES = ("code di", "code", "custom attribute5 value")


def cell(letter: str) -> Column:
    """GRD-12, GRD-20: the row's cell in a column; null beyond its width."""
    return F.get("values", F.lit(letter_to_index_py(letter)))


def cells_of(rows: DataFrame) -> DataFrame:
    """Long form of the given rows, non-blank cells only (for header search)."""
    return rows.select(*KEYS, "row_idx", F.posexplode("values").alias("col_idx", "value")).where(
        F.col("value").isNotNull()
    )


def label_rows(
    rows: DataFrame, labels: Sequence[str], *, default: int, search_rows: int | None = SEARCH_ROWS,
    letter: str | None = None, normaliser=header_norm,
) -> DataFrame:
    """GRD-5 / GRD-6: per sheet the first row holding one of ``labels`` (in one
    column if ``letter``, within the first rows if ``search_rows``), else
    ``default``.  Rows are cut at the scan; sheets are listed by their keys."""
    wanted = [" ".join(x.lower().split()) for x in labels]
    top = rows if search_rows is None else rows.where(F.col("row_idx") < search_rows)
    if letter is None:
        hit = F.exists("values", lambda v: F.coalesce(normaliser(v).isin(*wanted), F.lit(False)))
    else:
        hit = normaliser(cell(letter)).isin(*wanted)
    first = top.where(hit).groupBy(*KEYS).agg(F.min("row_idx").alias("_first"))
    return materialize(rows.select(*KEYS).distinct().join(first, list(KEYS), "left").select(
        *KEYS, F.coalesce("_first", F.lit(default)).cast("int").alias("header_row")
    ), "label-rows")


def code_columns(rows: DataFrame, headers: DataFrame, aliases: Sequence[str] = CODE_ALIASES) -> DataFrame:
    """GRD-15, GRD-16, CHK-1: per sheet the code column, by the first alias on
    its header row (the first column of a repeated label); null when no alias
    is there, so that a sheet without one is reported, not dropped."""
    labels = F.transform("values", lambda v: header_norm(v))
    places = [F.nullif(F.array_position(labels, a), F.lit(0)) - 1 for a in aliases]
    at = rows.join(headers, list(KEYS)).where(F.col("row_idx") == F.col("header_row")).select(
        *KEYS, F.coalesce(*places).cast("int").alias("code_col")
    )
    return materialize(headers.join(at, list(KEYS), "left"), "code-columns")


def body(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows under each sheet's header row, with ``code`` where a code column is
    given (null: blank)."""
    j = rows.join(headers, list(KEYS)).where(F.col("row_idx") > F.col("header_row"))
    if "code_col" in headers.columns:
        j = j.withColumn("code", F.nullif(strip_ws(F.get("values", F.col("code_col"))), F.lit("")))
    return j


def first_blank(rows: DataFrame, key: str = "code") -> DataFrame:
    """GRD-19: per sheet ``cut``, the first row whose ``key`` is blank or that is
    missing.  Needs ``header_row``; one table row per sheet row.

    Keyed rows are counted in blocks of rows (a map-side aggregate); the first
    block that is not full holds the cut, and only its rows are looked at.
    """
    offset = F.col("row_idx") - F.col("header_row") - 1
    keyed = rows.where(F.col(key).isNotNull()).select(
        *KEYS, F.floor(offset / BLOCK_ROWS).alias("_block"), (offset % BLOCK_ROWS).alias("_at")
    )
    blocks = keyed.groupBy(*KEYS, "_block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == BLOCK_ROWS)
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("_block")) - 1
    full = blocks.withColumn("_rank", rank).where(F.col("_rank") == F.col("_block")).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_full")
    )
    sheets = materialize(rows.select(*KEYS, "header_row").distinct().join(full, list(KEYS), "left").select(
        *KEYS, "header_row", F.coalesce("_full", F.lit(0)).alias("_full")
    ), "full-blocks")
    inside = keyed.join(sheets, list(KEYS)).where(F.col("_block") == F.col("_full")).groupBy(*KEYS).agg(
        F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(BLOCK_ROWS)), F.collect_set("_at"))).alias("_gap")
    )
    return materialize(sheets.join(inside, list(KEYS), "left").select(
        *KEYS,
        (F.col("header_row") + 1 + F.col("_full") * BLOCK_ROWS + F.coalesce("_gap", F.lit(0))).alias("cut"),
    ), "cuts")


def until_first_blank(rows: DataFrame, key: str = "code") -> DataFrame:
    """GRD-19: body rows before the first blank ``key`` of their sheet."""
    return rows.join(first_blank(rows, key), list(KEYS)).where(F.col("row_idx") < F.col("cut")).drop("cut")


# ------------------------------------------------------------------ writing
def put_cells(values: Column, cells: dict[str, Column]) -> Column:
    """SNK-6: ``values`` with the cells of the given columns replaced; a shorter
    row is filled up with blank cells as far as needed, all others stay."""
    at = sorted((letter_to_index_py(k), v.cast("string")) for k, v in cells.items())
    missing = F.greatest(F.lit(at[-1][0] + 1) - F.size(values), F.lit(0))
    filled = F.concat(values, F.array_repeat(F.lit(None).cast("string"), missing))
    parts, start = [], 0
    for i, v in at:
        parts += [F.slice(filled, start + 1, i - start), F.array(v)]
        start = i + 1
    return F.concat(*parts, F.slice(filled, F.lit(start + 1), F.greatest(F.size(filled) - start, F.lit(0))))


def write_marks(rows: DataFrame, headers: DataFrame, marks: DataFrame, number) -> DataFrame:
    """JN-3, CTL-1, CTL-2, SNK-6: the sheet's rows with the nine mark and gap
    columns written where the row's code has a mark.

    Rows count up to the first blank code; those after it, the rows above the
    body and rows without a mark keep every cell.  ``inside`` and ``matched``
    say which is which.  ``number`` reads a cell as a number; what is compared
    reads the values just written.  Rows only meet the marks by an equi-join;
    the cut is one small table per sheet.
    """
    from .enrich import enrich_marks

    cut = first_blank(body(rows, headers))
    j = rows.join(headers, list(KEYS)).join(cut.select(*KEYS, "cut"), list(KEYS), "left")
    inside = (F.col("row_idx") > F.col("header_row")) & F.coalesce(F.col("row_idx") < F.col("cut"), F.lit(False))
    code = F.nullif(strip_ws(F.get("values", F.col("code_col"))), F.lit(""))
    report = j.select(
        *rows.columns, inside.alias("inside"), F.when(inside, code).alias("code"),
        *[number(cell(x)).alias(n) for n, x in REPORT_MARK_INPUTS.items()],
    )
    e = enrich_marks(report, marks)
    written = put_cells(F.col("values"), {x: F.col(n) for n, x in REPORT_MARK_POSITIONS.items()})
    return e.withColumn("values", F.when(F.col("matched"), written).otherwise(F.col("values"))).select(
        *rows.columns, "inside", "code", "matched"
    )


def forward_sheet(accepted: DataFrame, row: str, source_file: str, sheet: str = REPORT_SHEETS[1][0]) -> DataFrame:
    """CTL-6, SNK-6: the bond-forward sheet's body in row form: accepted rows in
    columns A..K at ``FORWARD_START`` + ``row`` (from 0), the cleared column L blank."""
    blank = F.array_repeat(F.lit(None).cast("string"), FORWARD_WIDTH)
    texts = {x: F.nullif(F.col(n).cast("string"), F.lit("")) for n, x in FORWARD_POSITIONS.items()}
    return accepted.select(
        F.lit(source_file).alias("source_file"), F.lit(sheet).alias("sheet"), F.lit(1).alias("sheet_no"),
        (F.col(row) + FORWARD_START).cast("int").alias("row_idx"), put_cells(blank, texts).alias("values"),
    )


# ------------------------------------------------------------------ layouts
def used_columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """GRD-8: ``source_file, col_idx`` of the columns with a cell in the body.

    One partial aggregate with a flag for each column of the widest sheet; body
    rows are neither exploded nor moved."""
    width = rows.agg(F.max(F.size("values"))).first()[0] or 0
    if not width:
        return rows.select("source_file", F.lit(0).alias("col_idx")).limit(0)
    inside = rows.join(headers.select("source_file", "body_start"), "source_file").where("row_idx >= body_start")
    flags = inside.groupBy("source_file").agg(
        *[F.bool_or(F.get("values", F.lit(i)).isNotNull()).alias(f"_{i}") for i in range(width)]
    )
    used = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(i)) for i in range(width)]))
    return flags.select("source_file", F.explode(used).alias("col_idx"))


def prepare(rows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRD-2..4, GRD-8, GRD-10..12: headers and layout of every file's first
    sheet, by the rules of ``grid`` on the cells of its first rows only; both
    are written once (files x columns)."""
    first = rows.where(F.col("sheet_no") == 0)
    top = materialize(cells_of(first.where(F.col("row_idx") <= grid.SEARCH_ROWS)), "top-cells")
    headers = materialize(grid.detect_headers(top, expected), "headers")
    labels = grid.header_labels(top, headers, expected).join(headers.select("source_file", "merged"), "source_file")
    labels = labels.select(
        "source_file", "col_idx", F.when(F.col("merged"), F.col("merged_label")).otherwise(F.col("upper")).alias("raw_label")
    )
    return headers, materialize(grid.labelled(used_columns(first, headers), labels), "layout")


def report_amounts(rows: DataFrame, amount, sheets=REPORT_SHEETS) -> list[DataFrame]:
    """AGG-2, SET-4, DIM-5: class, counterparty and both amounts of each
    report sheet by its own columns.  The body starts under the label of the
    class (else counterparty) column, found over the whole sheet, and never
    before the second row.  ``amount`` reads a cell as a number."""
    out = []
    for name, classif, cpty, own, other, fixed in sheets:
        sheet = rows.where(F.col("sheet") == name)
        label, letter = ("Counterparty", cpty) if classif is None else ("Classif DI", classif)
        heads = label_rows(sheet, [label], default=0, search_rows=None, letter=letter, normaliser=norm_label)
        out.append(body(sheet, heads).select(
            (F.lit(fixed) if classif is None else cell(classif)).alias("classif_raw"),
            cell(cpty).alias("counterparty_raw"),
            amount(cell(own)).alias("mtm_own"),
            amount(cell(other)).alias("mtm_cpty"),
        ))
    return out


def label_cells(rows: DataFrame, label: str, search_rows: int = SEARCH_ROWS, row: int | None = None) -> DataFrame:
    """GRD-7: per sheet the first cell (row by row) that holds ``label``, within the
    first rows or in one ``row``: KEYS, header_row, label_col; sheets without it
    are not listed."""
    top = rows.where(F.col("row_idx") < search_rows) if row is None else rows.where(F.col("row_idx") == row)
    at = F.array_position(F.transform("values", lambda v: F.coalesce(norm_label(v), F.lit(""))), " ".join(label.lower().split()))
    first = top.where(at > 0).groupBy(*KEYS).agg(F.min(F.struct("row_idx", at.cast("int").alias("at"))).alias("_f"))
    return materialize(
        first.select(*KEYS, F.col("_f.row_idx").alias("header_row"), (F.col("_f.at") - 1).alias("label_col")), "label-cells")


def production_amounts(rows: DataFrame, amount, main: str, forward: str, header_row: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """AGG-4, AGG-5, GRD-7, FLT-7: class and dirty value of the main sheet (class
    under its label on ``header_row``, dirty value in AN) and the forward sheet's
    prices under the cell ``Prix GAM``, with ``keys``; for ``period.dirty_by_class``."""
    from .period import BOND_FORWARD_HEADER

    sheet = rows.where(F.col("sheet") == main)
    classes = label_cells(sheet, "Classif DI", row=header_row)
    swaps = body(sheet, classes).select(
        *keys, F.get("values", F.col("label_col")).alias("classif"), amount(cell("AN")).alias("dirty"))
    other = rows.where(F.col("sheet") == forward)
    prices = body(other, label_cells(other, BOND_FORWARD_HEADER))
    return swaps, prices.select(*keys, amount(F.get("values", F.col("label_col"))).alias("prix_gam"))


def run_date_cells(rows: DataFrame) -> DataFrame:
    """CTL-5: column B as cells of one column, for ``enrich.run_date_of`` (its
    filter on the third row reaches the scan)."""
    return rows.select("source_file", "row_idx", F.lit(1).alias("col_idx"), cell("B").alias("value"))


def blank_tokens(rows: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """SRC-7: cells that hold an NA token are blank."""
    return rows.withColumn("values", F.transform("values", lambda v: F.when(~v.isin(*tokens), v)))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
