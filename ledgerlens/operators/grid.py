"""Messy-workbook ingestion over a long *cells* table (GRD-1..21, DIM-3).

A sheet is ``cells(source_file, row_idx, col_idx, value)``: one row per
non-blank cell, 0-based positions.  Header detection, the per-file column
layout and the conversion to records are all aggregates and joins keyed by
``source_file``, so many files with different layouts are processed in one
plan and no file is looped over on the driver.

* Header scores, the two-row merge and the layout are small per-file
  aggregates (bounded by the search depth and the sheet width).
* ``to_records`` is ONE grouped conditional aggregation of the body cells
  joined with a (file, col_idx) -> logical-name binding; cells of unmapped
  columns are reduced to a row marker before the shuffle.
* ``stop_at_blank`` counts keyed rows in blocks; its window runs over blocks,
  never over rows, so one huge sheet does not become one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import header_norm, norm_label, strip_ws

SEARCH_ROWS = 12  # fixed value: header search depth
UNNAMED_PREFIX = "Unnamed"
BLOCK_ROWS = 4096  # rows counted together when looking for the first blank key
CELLS_AT_ONCE = 64_000_000  # cells that are shuffled before the next are read, where rows are stored by slices
SLICE_BINS = 4096  # equal ranges of row numbers that slices are put together from


def prepare(cells: DataFrame, expected: DataFrame, search_rows: int = SEARCH_ROWS) -> tuple[DataFrame, DataFrame]:
    """Headers and layout of every file, each written once as a table under
    the checkpoint folder: both are per-file tables (files x columns) that
    every later step joins, so materialising them keeps later plans small
    and cuts their lineage."""
    from ..session import materialize

    headers = materialize(detect_headers(cells, expected, search_rows), "headers")
    lay = materialize(layout(cells, headers, expected), "layout")
    return headers, lay


# ------------------------------------------------------------------ letters
def letter_of(col_idx) -> Column:
    """GRD-12: 0-based column index -> Excel letters (A..XFD)."""
    n = (F.col(col_idx) if isinstance(col_idx, str) else col_idx) + 1
    one = F.char(F.lit(64) + n)
    two = F.concat(F.char(F.lit(64) + F.floor((n - 1) / 26)), F.char(F.lit(65) + (n - 1) % 26))
    q = F.floor((n - 1 - 26) / 676)
    r = (n - 1 - 26) % 676
    three = F.concat(F.char(F.lit(65) + q), F.char(F.lit(65) + F.floor(r / 26)), F.char(F.lit(65) + r % 26))
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(three)


def index_of(letter) -> Column:
    """GRD-12: Excel letters -> 0-based index (base-26 fold, ``DU`` -> 124)."""
    c = F.upper(F.col(letter) if isinstance(letter, str) else letter)
    return F.aggregate(F.split(c, ""), F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 64) - 1


def letter_to_index_py(letter: str) -> int:
    """Plan-time version for config constants (0-based)."""
    n = 0
    for ch in letter.strip().upper():
        n = n * 26 + (ord(ch) - 64)
    return n - 1


# ------------------------------------------------------------------ headers
def _hits(cells: DataFrame, expected: DataFrame) -> DataFrame:
    e = F.broadcast(expected.select(F.col("label_norm").alias("_exp")))
    c = cells.withColumn("_n", norm_label(strip_ws("value")))
    return c.join(e, c["_n"] == e["_exp"], "left").withColumn("_hit", F.col("_exp").isNotNull()).drop("_exp")


def detect_headers(cells: DataFrame, expected: DataFrame, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """GRD-2 + GRD-3 + GRD-4: header row per file.

    Score = cells whose normalised text is an expected header; best score in
    the first ``search_rows`` rows, earliest row on ties, row 0 when nothing
    matches (S5).  The row below is merged in (lower cell if non-blank, else
    upper) only if that strictly raises the score (S7: blank lower = blank).

    Returns ``source_file, header_row, single_score, two_score, merged,
    body_start``.
    """
    top = _hits(cells.where(F.col("row_idx") < search_rows), expected)
    scores = top.groupBy("source_file", "row_idx").agg(F.count_if("_hit").alias("score"))
    best = scores.groupBy("source_file").agg(
        F.max("score").alias("_max"),
        F.min_by("row_idx", F.struct(-F.col("score"), F.col("row_idx"))).alias("_best"),
    )
    files = cells.select("source_file").distinct()
    best = files.join(best, "source_file", "left").select(
        "source_file", F.when(F.col("_max") > 0, F.col("_best")).otherwise(F.lit(0)).alias("header_row")
    )
    labels = header_labels(cells, best, expected)
    per_file = labels.groupBy("source_file").agg(
        F.count_if("_single_hit").alias("single_score"), F.count_if("_two_hit").alias("two_score")
    )
    out = best.join(per_file, "source_file", "left").fillna(0, ["single_score", "two_score"])
    merged = F.col("two_score") > F.col("single_score")
    return out.select(
        "source_file", "header_row", "single_score", "two_score", merged.alias("merged"),
        (F.col("header_row") + F.when(merged, 2).otherwise(1)).alias("body_start"),
    )


def header_labels(cells: DataFrame, best: DataFrame, expected: DataFrame, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """Per (file, col_idx): single-row label, two-row label, and hit flags."""
    b = best.select("source_file", "header_row")
    # header rows lie within the search depth: filter the cells before joining
    top = cells.where(F.col("row_idx") <= search_rows)
    two = top.join(b, "source_file").where(
        (F.col("row_idx") == F.col("header_row")) | (F.col("row_idx") == F.col("header_row") + 1)
    )
    per_col = two.groupBy("source_file", "col_idx").agg(
        F.max(F.when(F.col("row_idx") == F.col("header_row"), strip_ws("value"))).alias("upper"),
        F.max(F.when(F.col("row_idx") == F.col("header_row") + 1, strip_ws("value"))).alias("lower"),
    )
    per_col = per_col.withColumn("merged_label", F.coalesce(F.nullif("lower", F.lit("")), F.col("upper")))
    e = F.broadcast(expected.select(F.col("label_norm").alias("_e1")))
    e2 = F.broadcast(expected.select(F.col("label_norm").alias("_e2")))
    j = per_col.join(e, norm_label(F.col("upper")) == F.col("_e1"), "left")
    j = j.join(e2, norm_label(F.col("merged_label")) == F.col("_e2"), "left")
    return j.select(
        "source_file", "col_idx", "upper", "merged_label",
        (F.col("upper").isNotNull() & F.col("_e1").isNotNull()).alias("_single_hit"),
        (F.col("merged_label").isNotNull() & F.col("_e2").isNotNull()).alias("_two_hit"),
    )


def layout(cells: DataFrame, headers: DataFrame, expected: DataFrame) -> DataFrame:
    """GRD-8 + GRD-10 + GRD-11 + GRD-12: the column layout of each file.

    Columns empty in the body are dropped (positions kept); labels starting
    ``Unnamed`` are blanked; repeated labels become ``X (Leg2)``,
    ``X (Leg3)``; ``X.n`` becomes ``X (Leg n+1)``.  Returns
    ``source_file, col_idx, letter, label, label_norm``.
    """
    h = headers.select("source_file", "header_row", "merged", "body_start")
    labels = header_labels(cells, h, expected).join(h, "source_file")
    labels = labels.select(
        "source_file", "col_idx",
        F.when(F.col("merged"), F.col("merged_label")).otherwise(F.col("upper")).alias("raw_label"),
    )
    # a column has body cells iff its last used row is at or after the body
    # start: one partial aggregate over the cells, no join of all cells
    last = cells.groupBy("source_file", "col_idx").agg(F.max("row_idx").alias("_last"))
    body_cols = last.join(h.select("source_file", "body_start"), "source_file").where(
        F.col("_last") >= F.col("body_start")
    ).select("source_file", "col_idx")
    return labelled(body_cols, labels)


def labelled(body_cols: DataFrame, labels: DataFrame) -> DataFrame:
    """The layout from the columns that hold body cells (``source_file,
    col_idx``) and the header labels (``source_file, col_idx, raw_label``)."""
    cols = body_cols.join(labels, ["source_file", "col_idx"], "left")
    base = F.coalesce(F.col("raw_label"), F.lit(""))
    base = F.when(base.startswith(UNNAMED_PREFIX), F.lit("")).otherwise(base)
    cols = cols.select("source_file", "col_idx", base.alias("base"))
    return label_duplicates(cols)


def label_duplicates(cols: DataFrame) -> DataFrame:
    """GRD-11 on ``(source_file, col_idx, base)``; the window runs over the
    layout table (files x columns), never over data rows."""
    dotted = F.regexp_extract("base", r"^(.*)\.([0-9]+)$", 2)
    is_dotted = dotted != ""
    w = Window.partitionBy("source_file", "base", is_dotted).orderBy("col_idx")
    occ = F.row_number().over(w)
    label = (
        F.when(
            is_dotted,
            F.concat(F.regexp_extract("base", r"^(.*)\.([0-9]+)$", 1), F.lit(" (Leg"),
                     (dotted.cast("long") + 1).cast("string"), F.lit(")")),
        )
        .when(occ == 1, F.col("base"))
        .otherwise(F.concat(F.col("base"), F.lit(" (Leg"), occ.cast("string"), F.lit(")")))
    )
    out = cols.withColumn("label", label)
    return out.select("source_file", "col_idx", letter_of("col_idx").alias("letter"), "label",
                      norm_label("label").alias("label_norm"))


# ------------------------------------------------------------------ lookups
def resolve_by_name(lay: DataFrame, names: Sequence[str]) -> DataFrame:
    """GRD-13 (S8): per file, the first column whose normalised label equals
    each logical name.  Returns ``source_file, name, col_idx`` (null when the
    file lacks it), one row per file and name."""
    spark = lay.sparkSession
    wanted = spark.createDataFrame([(n, " ".join(n.strip().lower().split())) for n in names], "name string, _nn string")
    files = lay.select("source_file").distinct()
    hit = lay.join(F.broadcast(wanted), lay["label_norm"] == wanted["_nn"]).groupBy("source_file", "name").agg(
        F.min("col_idx").alias("col_idx")
    )
    all_pairs = files.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    return all_pairs.join(hit, ["source_file", "name"], "left")


def required_missing(resolved: DataFrame, required: Sequence[str]) -> DataFrame:
    """CHK-1: files lacking a required logical column."""
    return resolved.where(F.col("col_idx").isNull() & F.col("name").isin(*required)).select(
        "source_file", "name", F.lit("missing required column").alias("check")
    )


# Fixed values (GRD-17): leg tokens, checked in this order.
LEG_TOKENS = (
    ("total", ("1+2", "total", "both legs", "both", "sum")),
    ("1", ("leg 1", "leg1", "(1)", " l1 ")),
    ("2", ("leg 2", "leg2", "(2)", " l2 ")),
)


def leg_token(label_norm) -> Column:
    """GRD-17: leg token of a normalised header: total / 1 / 2 / ''."""
    c = F.col(label_norm) if isinstance(label_norm, str) else label_norm
    expr = F.lit("")
    for tok, subs in reversed(LEG_TOKENS):
        cond = None
        for s in subs:
            t = c.contains(s)
            cond = t if cond is None else (cond | t)
        expr = F.when(cond, F.lit(tok)).otherwise(expr)
    return expr


def leg_columns(lay: DataFrame, base: str) -> DataFrame:
    """GRD-18: leg-1 / leg-2 / total column of ``base`` per file.

    Candidates: normalised label equals or starts with the base; first
    candidate per token wins; without a total, the first unsuffixed candidate
    is the total when a leg exists, or leg 1 when it is the only candidate.
    """
    target = " ".join(base.strip().lower().split())
    cand = lay.where(F.col("label_norm").startswith(target)).withColumn("tok", leg_token("label_norm"))
    per = cand.groupBy("source_file").agg(
        *[F.min_by("label", F.when(F.col("tok") == t, F.col("col_idx"))).alias(f"_{t}") for t in ("1", "2", "total")],
        F.min_by("label", F.when(F.col("tok") == "", F.col("col_idx"))).alias("_plain"),
        F.count_if(F.col("tok") == "").alias("_nplain"),
    )
    has_leg = F.col("_1").isNotNull() | F.col("_2").isNotNull()
    total = F.coalesce(F.col("_total"), F.when(has_leg, F.col("_plain")))
    leg1 = F.coalesce(F.col("_1"), F.when(~has_leg & F.col("_total").isNull() & (F.col("_nplain") == 1), F.col("_plain")))
    return per.select("source_file", F.lit(base).alias("base"), leg1.alias("leg1"), F.col("_2").alias("leg2"), total.alias("total"))


def find_header_cell(cells: DataFrame, header: str, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """GRD-7: first cell (row-major) in the first rows whose normalised text
    equals ``header``; ``source_file, row_idx, col_idx``."""
    target = " ".join(header.strip().lower().split())
    hit = cells.where((F.col("row_idx") < search_rows) & (norm_label("value") == target))
    return hit.groupBy("source_file").agg(F.min(F.struct("row_idx", "col_idx")).alias("_p")).select(
        "source_file", F.col("_p.row_idx").alias("row_idx"), F.col("_p.col_idx").alias("col_idx")
    )


def find_label_row(cells: DataFrame, labels: Sequence[str], search_rows: int | None = SEARCH_ROWS,
                   col_idx: int | None = None, default: int = 3, normaliser=header_norm) -> DataFrame:
    """GRD-5 / GRD-6: first row holding any of ``labels`` (optionally in one
    column, optionally within the first rows); ``default`` when none."""
    wanted = [" ".join(x.strip().lower().split()) for x in labels]
    c = cells
    if search_rows is not None:
        c = c.where(F.col("row_idx") < search_rows)
    if col_idx is not None:
        c = c.where(F.col("col_idx") == col_idx)
    hit = c.where(normaliser(F.col("value")).isin(*wanted)).groupBy("source_file").agg(F.min("row_idx").alias("_r"))
    files = cells.select("source_file").distinct()
    return files.join(hit, "source_file", "left").select(
        "source_file", F.coalesce("_r", F.lit(default)).alias("row_idx")
    )


def _header_cells(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Cells of each file's header row, stored: only their labels are normalised
    (a filter on the normalised label would otherwise run on every cell)."""
    from ..session import materialize

    h = cells.join(header_rows.select("source_file", F.col("row_idx").alias("_h")), "source_file")
    return materialize(h.where(F.col("row_idx") == F.col("_h")), "header-cells")


def header_occurrences(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """GRD-14: normalised header -> ordered positions (occurrence k)."""
    h = _header_cells(cells, header_rows)
    h = h.withColumn("label_norm", norm_label("value")).where(F.col("label_norm") != "")
    w = Window.partitionBy("source_file", "label_norm").orderBy("col_idx")
    return h.select("source_file", "label_norm", F.row_number().over(w).alias("occurrence"), "col_idx")


def first_wins_map(cells: DataFrame, header_rows: DataFrame, normaliser=header_norm) -> DataFrame:
    """GRD-15: header map (normalised with STR-3), first column wins."""
    h = _header_cells(cells, header_rows)
    h = h.withColumn("key", normaliser(F.col("value"))).where(F.col("key") != "")
    return h.groupBy("source_file", "key").agg(F.min("col_idx").alias("col_idx"))


def column_for(header_map: DataFrame, aliases: Sequence[str]) -> DataFrame:
    """GRD-16: logical column = first alias (in list order) present."""
    spark = header_map.sparkSession
    ranks = spark.createDataFrame([(a, i) for i, a in enumerate(aliases)], "key string, _rank int")
    j = header_map.join(F.broadcast(ranks), "key")
    return j.groupBy("source_file").agg(F.min_by("col_idx", "_rank").alias("col_idx"))


# ------------------------------------------------------------------ rows
def stop_at_blank(rows: DataFrame, key_col: str, start: DataFrame) -> DataFrame:
    """GRD-19: keep rows before the first row (from ``start``) whose key is
    blank or absent.  ``rows`` has ``source_file, row_idx, <key_col>``;
    ``start`` has ``source_file, start_row``.

    The cut is the smallest r >= start such that r holds no non-blank key.
    The rows are stored once and read three times: distinct keyed rows are
    counted in blocks, the first block that is not full holds the cut, and only
    its rows are looked at.  Rows meet tables of one row per file.
    """
    from ..session import materialize

    rows = materialize(rows, "rows")
    start = materialize(start.select("source_file", "start_row"), "starts")
    at = F.col("row_idx").cast("long") - F.col("start_row")
    keyed = rows.join(start, "source_file").where(
        (F.col("row_idx") >= F.col("start_row")) & F.col(key_col).isNotNull() & (strip_ws(key_col) != "")
    ).select("source_file", F.floor(at / BLOCK_ROWS).alias("_block"), (at % BLOCK_ROWS).alias("_at")).distinct()
    blocks = keyed.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == BLOCK_ROWS)
    rank = F.row_number().over(Window.partitionBy("source_file").orderBy("_block")) - 1
    full = blocks.withColumn("_rank", rank).where(F.col("_rank") == F.col("_block")).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("_full")
    )
    files = materialize(start.join(full, "source_file", "left").withColumn("_full", F.coalesce("_full", F.lit(0))), "full-blocks")
    inside = keyed.join(files, "source_file").where(F.col("_block") == F.col("_full")).groupBy("source_file").agg(
        F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(BLOCK_ROWS)), F.collect_set(F.col("_at").cast("int")))).alias("_gap")
    )
    cut = materialize(files.join(inside, "source_file", "left").select(
        "source_file", "start_row",
        (F.col("start_row") + F.col("_full") * BLOCK_ROWS + F.coalesce("_gap", F.lit(0))).alias("_cut"),
    ), "cuts")
    j = rows.join(cut, "source_file")
    return j.where((F.col("row_idx") >= F.col("start_row")) & (F.col("row_idx") < F.col("_cut"))).drop("_cut")


def _record_files(binding: DataFrame, headers: DataFrame, names: Sequence[str]) -> DataFrame:
    """One stored row per file for ``to_records``: a number for the file, its first
    body row, its bound columns in order, and per name the places (from 1) of the
    name's columns among them."""
    from ..session import materialize

    starts = headers.groupBy("source_file").agg(F.min("body_start").alias("body_start"))
    bound = binding.where(F.col("name").isin(*names)).groupBy("source_file").agg(
        F.array_sort(F.collect_set("col_idx")).alias("_cols"),
        F.array(*[F.collect_set(F.when(F.col("name") == n, F.col("col_idx"))) for n in names]).alias("_of"),
    )
    places = F.transform("_of", lambda cols: F.transform(cols, lambda c: F.array_position("_cols", c)))
    files = starts.join(bound, "source_file", "left").select(
        "source_file", "body_start", "_cols", places.alias("_places"), F.monotonically_increasing_id().alias("_file")
    )
    return materialize(files, "record-files")


def row_slices(cells: DataFrame, at_once: int | None = None) -> list[Column] | None:
    """Conditions on ``row_idx``, from the first rows down, that cut the cells into
    slices of about ``at_once`` (a bin of rows is not cut); None where one will do.

    The driver gets the cell counts of ``SLICE_BINS`` equal ranges of row numbers.
    """
    at_once = at_once or CELLS_AT_ONCE
    least, most, n = cells.agg(F.min("row_idx"), F.max("row_idx"), F.count("row_idx")).first()
    if n <= at_once:
        return None
    width = (most - least) // SLICE_BINS + 1
    bin_of = F.floor((F.col("row_idx").cast("double") - F.lit(float(least))) / F.lit(float(width)))
    counts = cells.where(F.col("row_idx").isNotNull()).groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    cuts, held = [], 0
    for i, k in sorted(counts.collect()):
        if held and held + k > at_once:
            cuts.append(least + i * width)
            held = 0
        held += k
    if not cuts:
        return None
    r = F.col("row_idx")
    return [r < cuts[0], *[(r >= a) & (r < b) for a, b in zip(cuts, cuts[1:])], r >= cuts[-1]]


def to_records(cells: DataFrame, binding: DataFrame, headers: DataFrame, names: Sequence[str]) -> DataFrame:
    """GRD-21 + GRD-9 + GRD-20: body cells -> one record per (file, row).

    ``binding``: ``source_file, col_idx, name`` (a column may feed several
    names).  One grouped conditional aggregation; names without a cell are
    null (out-of-range positions included).  Every non-empty body row gives
    a record, even when none of its cells is mapped.

    Cells are grouped by the numbers of their file and row, and aggregated once
    per bound column, not once per name: a cell goes to the place of its column
    among the file's bound ones, and names read their places from the record.
    What a file binds is one stored row, which cells and records meet by a broadcast.
    """
    files = _record_files(binding, headers, names)
    width, depth = files.agg(
        F.max(F.size("_cols")), F.max(F.array_max(F.transform("_places", lambda p: F.size(p))))
    ).first()
    body = cells.join(files.select("source_file", "body_start", "_cols", "_file"), "source_file").where(
        F.col("row_idx") >= F.col("body_start")
    )
    place = F.array_position("_cols", F.col("col_idx"))
    j = body.select("row_idx", "_file", place.alias("_place"), F.when(place > 0, F.col("value")).alias("_value"))
    aggs = [F.max(F.when(F.col("_place") == i, F.col("_value"))).alias(f"_v{i}") for i in range(1, (width or 0) + 1)]
    grouped = j.groupBy("row_idx", "_file").agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    r = grouped.join(files.select("_file", "source_file", "_places"), "_file")
    nothing = F.lit(None).cast(cells.schema["value"].dataType)
    values = F.array(nothing, *[F.col(f"_v{i}") for i in range(1, (width or 0) + 1)])

    def value(k: int) -> Column:
        at = F.get("_places", F.lit(k))
        return F.greatest(nothing, nothing, *[F.get(values, F.get(at, F.lit(i)).cast("int")) for i in range(depth or 0)])

    return r.select("source_file", "row_idx", *[value(k).alias(n) for k, n in enumerate(names)]).withColumn(
        "ord", F.struct("source_file", "row_idx")
    )
