"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

docstring.  Every query reads whole driver tables (through the bindings) and
lets Catalyst plan the work; none collects data to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code_prefix, code_text, div_optional, legacy_code_present, valid_code
from ..operators import dims, enrich
from ..session import materialize
from ..sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def run_date() -> F.Column:
    return F.lit(B.RUN_DATE).cast("date")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of the perimeter: valid codes, amounts as doubles."""
    t = B.trades(spark, sf_dir)
    notional = F.col("notional").cast("double")
    dirty = F.col("mtm_own").cast("double")
    return t.where(valid_code("code_raw")).select(
        "trade_id",
        code_text("code_raw").alias("code"),
        "classif",
        "index_rate",
        "cpty",
        notional.alias("notional"),
        dirty.alias("dirty_total"),
        div_optional(dirty, notional).alias("dirty_pct"),
        "end_date",
        "l_returnflag",
        "l_linestatus",
        "ord",
    )


# --------------------------------------------------------------- filters
@register
def valid_code_filter(spark, sf_dir):
    """FLT-1, STR-1: rows whose code is valid, with the stored code text."""
    t = B.trades(spark, sf_dir)
    return t.where(valid_code("code_raw")).select("trade_id", "code_raw", code_text("code_raw").alias("code"))


@register
def legacy_blank_filter(spark, sf_dir):
    """FLT-2 (S6): legacy filter, code present after trim; null dropped."""
    t = B.trades(spark, sf_dir)
    return t.where(legacy_code_present("code_raw")).select("trade_id", "code_raw")


# --------------------------------------------------------------- marks
@register
def marks_by_code(spark, sf_dir):
    """AGG-1, FLT-8, UDF-3, NUM-9, STR-4, SRT-3: counterparty marks per code."""
    return enrich.aggregate_marks(B.marks_feed(spark, sf_dir)).orderBy("code")


def _enriched(spark, sf_dir) -> DataFrame:
    marks = enrich.aggregate_marks(B.marks_feed(spark, sf_dir))
    return enrich.enrich_marks(report_rows(spark, sf_dir), marks)


GAP_COLUMNS = (
    "mtm_cpty", "mtm_cpty_pct", "mtm_gap", "mtm_gap_pct", "mtm_gap_ctl",
    "cmp_bs", "cmp_bt", "cmp_ca", "cmp_cb",
)


@register
def marks_enrich_gap(spark, sf_dir):
    """JN-3, CTL-1, CTL-2, CTL-3, NUM-4, NUM-5, NUM-11: marks joined to the report."""
    e = _enriched(spark, sf_dir)
    return e.select("trade_id", "code", "notional", "dirty_total", "dirty_pct", "matched", *GAP_COLUMNS)


@register
def codes_missing_marks(spark, sf_dir):
    """JN-4: report rows without a mark (row order kept through ``ord``)."""
    marks = enrich.aggregate_marks(B.marks_feed(spark, sf_dir))
    r = report_rows(spark, sf_dir)
    return enrich.missing_codes(r, marks).orderBy("ord").select("trade_id", "code")


@register
def codes_unused_marks(spark, sf_dir):
    """JN-5, SET-3, SRT-3: mark codes the report never uses, distinct, sorted."""
    marks = enrich.aggregate_marks(B.marks_feed(spark, sf_dir))
    return enrich.unused_codes(marks, report_rows(spark, sf_dir))


# --------------------------------------------------------------- thresholds
@register
def maturity_years(spark, sf_dir):
    """DATE-4: year fraction from the run date to each trade's end date."""
    from ..functions import year_fraction

    t = B.trades(spark, sf_dir)
    return t.select("trade_id", "end_date", year_fraction(run_date(), F.col("end_date")).alias("maturity_years"))


@register
def threshold_lookup(spark, sf_dir):
    """JN-9, DIM-2: tolerance by class, index and maturity bucket (range join)."""
    r = report_rows(spark, sf_dir)
    out = enrich.attach_thresholds(r, dims.thresholds(spark), run_date())
    return out.select("trade_id", "classif", "index_rate", "maturity_years", "threshold")


@register
def tolerance_alerts(spark, sf_dir):
    """CTL-4, CTL-5 (S13): alert when |MtM gap %| exceeds the tolerance."""
    e = _enriched(spark, sf_dir)
    a = enrich.tolerance_alerts(e, dims.thresholds(spark), run_date())
    return a.select("trade_id", "code", "classif", "maturity_years", "threshold",
                    F.col("mtm_gap_pct").alias("gap"), "alert")


@register
def alerts_by_class(spark, sf_dir):
    """Flagship: which trades breach tolerance against the counterparty mark,
    counted per class (AGG-12 counters per class)."""
    e = _enriched(spark, sf_dir)
    a = enrich.tolerance_alerts(e, dims.thresholds(spark), run_date())
    return a.groupBy("classif").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("matched")).alias("n_matched"),
        F.count_if(F.col("alert").isNotNull()).alias("n_alerts"),
        F.max(F.abs(F.col("mtm_gap_pct"))).alias("max_abs_gap_pct"),
    )


@register
def run_counters(spark, sf_dir):
    """AGG-12: updated / missing / alert counters of the marks step."""
    e = _enriched(spark, sf_dir)
    a = enrich.tolerance_alerts(e, dims.thresholds(spark), run_date())
    return enrich.run_counters(a)


# --------------------------------------------------------------- sensitivities
def _sensis_last(spark, sf_dir) -> DataFrame:
    return enrich.last_wins(B.sensitivities(spark, sf_dir), ["code"], "src_row")


@register
def last_wins_by_code(spark, sf_dir):
    """AGG-11: last sensitivity row per code (by source row)."""
    return _sensis_last(spark, sf_dir)


@register
def sensitivity_enrich(spark, sf_dir):
    """JN-1, NUM-8, CTL-3: six sensitivity columns joined to the report."""
    e = enrich.enrich_sensitivities(report_rows(spark, sf_dir), _sensis_last(spark, sf_dir))
    return e.select("trade_id", "code", "sensi_matched", *enrich.SENSI_COLUMNS)


@register
def codes_missing_sensitivity(spark, sf_dir):
    """JN-2: report rows whose code has no sensitivity (repeats kept)."""
    missing = enrich.missing_codes(report_rows(spark, sf_dir), B.sensitivities(spark, sf_dir))
    return missing.orderBy("ord").select("trade_id", "code")


@register
def override_duration(spark, sf_dir):
    """JN-11, SRC-9: leg-1 modified duration overridden for Real Rate Swaps."""
    from ..sources.feeds import override_table

    e = enrich.enrich_sensitivities(report_rows(spark, sf_dir), _sensis_last(spark, sf_dir))
    o = enrich.apply_overrides(e, override_table(spark), dims.OVERRIDE_CLASS, "duration_leg1")
    return o.select("trade_id", "code", "classif", "duration_leg1", "overridden")


# --------------------------------------------------------------- bond forwards
def _forwards(spark, sf_dir) -> DataFrame:
    from ..operators import forwards

    return forwards.forward_quality(forwards.select_forwards(B.marks_feed(spark, sf_dir)))


@register
def forward_filter(spark, sf_dir):
    """FLT-3, STR-5, MAP-12: bond-forward rows of allowed books."""
    from ..operators import forwards

    f = forwards.select_forwards(B.marks_feed(spark, sf_dir))
    return f.select("o_orderkey", "free_text", F.col("book_norm").alias("book"), F.col("cp_clean").alias("cp"),
                    F.col("notional_d").alias("notional"), F.col("mtm_value_d").alias("mtm_value"),
                    F.col("mtm_diff_d").alias("mtm_diff"))


@register
def forward_quality(spark, sf_dir):
    """CHK-3 (S2): missing fields, status and message of each forward row."""
    return _forwards(spark, sf_dir).select("o_orderkey", "label", "missing", "status", "message")


@register
def forward_alerts(spark, sf_dir):
    """CTL-6, MAP-12: accepted forwards with ratios, gap and alert (A-K)."""
    from ..operators import forwards

    a = forwards.forward_alerts(_forwards(spark, sf_dir))
    return a.select("o_orderkey", "free_text", F.col("book_norm").alias("book"), F.col("cp_out").alias("cp"),
                    F.col("notional_d").alias("notional"), F.col("mtm_value_d").alias("mtm_own"),
                    "cpty_price", "mtm_pct", "cpty_pct", "threshold", "gap_pct", "alert")


@register
def report_row_placement(spark, sf_dir):
    """SRT-5, SNK-2: sheet row of each accepted forward, from row 2, rejected
    rows leaving no gap; numbered without a single-partition window."""
    from ..operators import forwards
    from ..operators.placement import sequential_index

    a = forwards.forward_alerts(_forwards(spark, sf_dir)).select("o_orderkey", "free_text", "alert")
    return sequential_index(a, ["o_orderkey"], name="sheet_row", start=2)


# --------------------------------------------------------------- perimeter
def _perimeter_input(spark, sf_dir) -> DataFrame:
    t = B.trades(spark, sf_dir)
    return t.select(F.col("trade_id").alias("Trade ID"), "code_raw", "classif",
                    F.col("cpty").alias("Counterparty"), "ord")


@register
def perimeter_dedup_first(spark, sf_dir):
    """AGG-9, MAP-11, FLT-1: perimeter projection, first row per trade id."""
    from ..operators.perimeter import build_perimeter

    p = build_perimeter(_perimeter_input(spark, sf_dir), "code_raw", "classif", ["#Ticket", "Trade ID", "External Id"],
                        ["Counterparty", "Currency"])
    return p.select(F.col("Trade ID").alias("trade_id"), "code_di", "classif_di", "class",
                    F.col("Counterparty").alias("counterparty"))


@register
def perimeter_dedup_stats(spark, sf_dir):
    """AGG-10: rows before / after dedup and the keys used."""
    from ..operators.perimeter import build_perimeter, dedup_stats

    p = build_perimeter(_perimeter_input(spark, sf_dir), "code_raw", "classif", ["#Ticket", "Trade ID", "External Id"],
                        ["Counterparty", "Currency"], dedup=False)
    return dedup_stats(p, ["Trade ID"])


# --------------------------------------------------------------- reconciliation
def _recon_trades(spark, sf_dir) -> DataFrame:
    """The lines with a valid code, one row each, as ``marked_trades`` takes them: a
    code, label and counterparty have few lines, so sums of them would be no smaller."""
    t = B.trades(spark, sf_dir).where(valid_code("code_raw"))
    return t.select(
        code_text("code_raw").alias("code"), F.col("classif").alias("classif_raw"), F.col("cpty").alias("counterparty_raw"),
        F.col("mtm_own").alias("own"), F.lit(1).cast("long").alias("n"), F.col("mtm_own").isNotNull().cast("long").alias("n_own"))


def _recon_collateral(spark, sf_dir) -> DataFrame:
    """The collateral report, summed by its labels where the lines are read and
    stored, so that tests on clean labels are not pushed into every line."""
    from ..operators import reconcile as R

    lines = materialize(B.collateral(spark, sf_dir), "recon-lines").withColumn("ord", F.struct("cpty", "typology"))
    return R.load_collateral(lines, "cpty", "typology", "mtm_own", "mtm_cpty")


def _recon_feed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Marks by code and the forward sheet's sums by label: one scan of the feed.

    A feed row may be a mark, a forward or both."""
    from ..functions import sub_optional
    from ..operators import forwards

    feed = B.marks_feed(spark, sf_dir)
    code = code_prefix("free_text_2")
    own, diff = F.col("mtm_value"), F.col("mtm_diff")
    chosen = forwards.forward_quality(forwards.forward_fields(feed))
    is_forward = forwards.is_forward() & (F.col("status") != "rejected")
    side = lambda name, key, a, b: F.struct(F.lit(name).alias("side"), key.alias("key"), a.alias("own"), b.alias("other"))
    rows = chosen.select(F.inline(F.array_compact(F.array(
        F.when(code != "", side("mark", code, own, F.coalesce(own - diff, F.lit(0)))),
        F.when(is_forward, side("forward", F.nullif(F.col("cp_clean"), F.lit("")), own, sub_optional(own, diff))),
    ))))
    both = materialize(rows.groupBy("side", "key").agg(
        F.sum("own").alias("own"), F.sum("other").alias("other"),
        F.count_if(F.col("own").isNotNull() | F.col("other").isNotNull()).alias("n"),
    ), "recon-feed")
    marks = both.where(F.col("side") == "mark").select(F.col("key").alias("code"), F.col("other").alias("mark"))
    sheet = both.where(F.col("side") == "forward").select(
        F.lit("Forward").alias("classif_raw"), F.col("key").alias("counterparty_raw"),
        F.col("own").alias("g"), F.col("other").alias("c"), "n")
    return marks, sheet


def _recon_inputs(spark, sf_dir):
    from ..operators import reconcile as R

    marks, forward_sheet = _recon_feed(spark, sf_dir)
    swaps = R.marked_trades(_recon_trades(spark, sf_dir), marks).groupBy("classif_raw", "counterparty_raw").agg(
        *[F.sum(c).alias(c) for c in ("g", "c", "n")])
    swaps = materialize(swaps, "recon-swaps")  # a row a label
    return R.by_clean_labels(swaps.unionByName(forward_sheet)), _recon_collateral(spark, sf_dir)


def _as_double(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@register
def mtm_by_class_cpty(spark, sf_dir):
    """AGG-2, SET-4, FLT-5, FLT-6: report MtM per (class, counterparty) over
    the swap and bond-forward sheets."""
    template, _ = _recon_inputs(spark, sf_dir)
    return _as_double(template, ["mtm_own", "mtm_cpty"]).orderBy("classif", "counterparty")


@register
def alias_normalise(spark, sf_dir):
    """JN-8, STR-2, STR-9: collateral labels normalised through the alias tables."""
    from ..operators import reconcile as R

    c = B.collateral(spark, sf_dir).select(F.col("cpty").alias("counterparty"), "typology")
    n = R.normalize_label(c, "counterparty", B.cpty_aliases(spark, sf_dir), "norm_counterparty")
    n = R.normalize_label(n, "typology", B.typology_aliases(spark), "norm_typology")
    return n.select("counterparty", "typology", "norm_counterparty", "norm_typology")


@register
def alias_text(spark, sf_dir):
    """DIM-1, SRC-11: alias dimension parsed from alias text lines (one to two
    lines per supplier; comments, three separators, later lines overriding)."""
    from ..operators import reconcile as R

    s = B.table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    ks = k.cast("string")
    main = (
        F.when(k % 4 == 0, F.concat(F.lit("sup"), ks, F.lit(" = SUPPLIER#"), ks, F.lit(" # desk")))
        .when(k % 4 == 1, F.concat(F.lit("sup"), ks, F.lit(" : SUPPLIER#"), ks))
        .when(k % 4 == 2, F.concat(F.lit("sup"), ks, F.lit("\tSUPPLIER#"), ks))
        .otherwise(F.concat(F.lit("# sup"), ks, F.lit(" = skipped")))
    )
    extra = F.when(k % 10 == 0, F.concat(F.lit("  SUP"), ks, F.lit(" =  Supplier#"), ks, F.lit(" bis ")))
    lines = s.select(
        F.explode(F.array(F.struct((k * 2).alias("line_no"), main.alias("line")),
                          F.struct((k * 2 + 1).alias("line_no"), extra.alias("line")))).alias("x")
    ).select("x.line_no", "x.line").where(F.col("line").isNotNull())
    return R.parse_aliases(lines)


@register
def aggregate_by_norm(spark, sf_dir):
    """AGG-3, FLT-4, UDF-2: collateral lines by normalised keys, first
    non-null labels and null-skipping sums."""
    from ..operators import reconcile as R

    c = _recon_collateral(spark, sf_dir)
    n = R.normalize_label(c, "counterparty", B.cpty_aliases(spark, sf_dir), "norm_counterparty")
    n = R.normalize_label(n, "typology", B.typology_aliases(spark), "norm_typology")
    n = n.where(F.col("norm_counterparty").isNotNull() & F.col("norm_typology").isNotNull())
    a = R.aggregate_by_norm(n, ["norm_counterparty", "norm_typology"], ["counterparty", "typology"],
                            ["mtm_own", "mtm_cpty"], "ord")
    return _as_double(a, ["mtm_own", "mtm_cpty"])


def _recon(spark, sf_dir) -> DataFrame:
    from ..operators import reconcile as R

    template, collat = _recon_inputs(spark, sf_dir)
    r = R.reconcile(template, collat, B.cpty_aliases(spark, sf_dir), B.typology_aliases(spark))
    return _as_double(r, ["mtm_own_template", "mtm_cpty_template", "mtm_own_collateral", "mtm_cpty_collateral",
                          "gap_mtm_own", "gap_mtm_cpty"])


@register
def collateral_recon(spark, sf_dir):
    """JN-6, CTL-7, SRT-1, MAP-14: report vs collateral, full outer by
    normalised (counterparty, typology), 14 columns, sorted."""
    from ..operators import reconcile as R

    return R.sort_recon(_recon(spark, sf_dir))


@register
def recon_max_gap(spark, sf_dir):
    """AGG-7, CHK-5: largest absolute gap and the concordance flag."""
    from ..operators import reconcile as R

    return R.max_gap(_recon(spark, sf_dir))


# --------------------------------------------------------------- period comparison
def _totals_long(spark, sf_dir) -> DataFrame:
    """Class totals of both productions, current (lines and orders open in whole
    or in part) and previous (filled), in one grouped pass keyed by production."""
    from ..operators import forwards
    from ..operators import period as P

    t = B.trades(spark, sf_dir)
    swaps = t.select(F.when(F.col("l_linestatus") == "F", "previous").otherwise("current").alias("production"),
                     "classif", F.col("mtm_own").alias("dirty"))
    fw = forwards.forward_alerts(_forwards(spark, sf_dir))
    fw = fw.select(F.when(F.col("o_orderstatus") == "F", "previous").otherwise("current").alias("production"),
                   F.col("mtm_value").alias("prix_gam"))
    return P.dirty_by_class(swaps, fw, keys=("production",))


@register
def dirty_by_class(spark, sf_dir):
    """AGG-4, AGG-5, FLT-7: dirty value per class of each production, bond
    forwards under 'Bond Forward'."""
    return _as_double(_totals_long(spark, sf_dir), ["total"])


@register
def period_compare(spark, sf_dir):
    """JN-7, CTL-8, NUM-10, SRT-2, SET-2: class totals of both productions,
    gap and gap %, largest gap first."""
    from ..operators import period as P

    return P.sort_by_gap(_as_double(P.compare_long(_totals_long(spark, sf_dir)), ["dirty_previous", "dirty_current", "gap"]))


@register
def period_totals(spark, sf_dir):
    """AGG-6: grand totals and delta."""
    from ..operators import period as P

    return _as_double(P.totals_long(_totals_long(spark, sf_dir)), ["total_current", "total_previous", "delta_total"])


def _rollup_wide(spark, sf_dir):
    from ..operators import period as P

    w = P.rollup_productions(_totals_long(spark, sf_dir), dims.category_bridge(spark), dims.summary_items(spark))
    return _as_double(w, ["cur", "prev"])


@register
def category_rollup(spark, sf_dir):
    """JN-10, DIM-4, AGG-8: overlapping category subtotals per production
    (both productions in one pass, unpivoted)."""
    w = _rollup_wide(spark, sf_dir)
    pairs = F.explode(F.array(F.struct(F.lit("current").alias("production"), F.col("cur").alias("value")),
                              F.struct(F.lit("previous").alias("production"), F.col("prev").alias("value"))))
    return w.select("item_ord", "item_label", pairs.alias("x")).select(
        F.col("x.production").alias("production"), "item_ord", "item_label", F.col("x.value").alias("value"))


@register
def mtm_summary_text(spark, sf_dir):
    """CTL-9, STR-7: the MtM summary text of the two productions."""
    from ..operators import period as P

    return P.summary_text_wide(_rollup_wide(spark, sf_dir), "30/06/1995", "31/03/1995")


# further query groups register themselves on import
from . import scalar_queries  # noqa: E402,F401
from . import grid_queries  # noqa: E402,F401
from . import mapping_queries  # noqa: E402,F401
from . import file_queries  # noqa: E402,F401
from . import io_queries  # noqa: E402,F401
from . import sheet_queries  # noqa: E402,F401
from . import extract_queries  # noqa: E402,F401
