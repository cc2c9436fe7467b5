"""Report enrichment: marks, sensitivities, overrides, tolerance alerts.

IDs: AGG-1, AGG-11, FLT-8, JN-1..5, JN-9, JN-11, CTL-1..5, NUM-4/5/8/9/11.

Scale notes
-----------
* ``aggregate_marks`` is a hash aggregate with a map-side partial step, so a
  code holding a third of all feed rows is pre-summed inside each map task.
* The report-to-marks and report-to-sensitivity joins are plain equi-joins
  without hints: Spark broadcasts the aggregated side only when its measured
  size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
  shuffles; AQE splits a hot code's partition on the report side.
* The threshold table is eight fixed rows and is broadcast explicitly; the
  maturity range is a residual condition on that broadcast hash join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    code_prefix,
    div_optional,
    strip_ws,
    sub_optional,
    total_or_legs,
    year_fraction,
)


def aggregate_marks(feed: DataFrame, code_col: str = "free_text_2", as_double: bool = True) -> DataFrame:
    """AGG-1 (+FLT-8, STR-4, NUM-9): counterparty marks summed per code.

    Per row: counterparty MtM = MTM_VALUE - MTM_DIFF (null if either is null);
    each amount counts 0 when null; blank codes are dropped.  Output
    ``code, mtm_value, mtm_diff, mtm_cpty`` as doubles (``as_double=False``
    keeps exact decimal inputs exact).
    """
    v, d = F.col("mtm_value"), F.col("mtm_diff")
    rows = feed.select(code_prefix(code_col).alias("code"), v.alias("v"), d.alias("d"), (v - d).alias("c"))
    def total(c: str) -> Column:
        s = F.sum(F.coalesce(c, F.lit(0)))
        return s.cast("double") if as_double else s

    return (
        rows.where(F.col("code") != "")
        .groupBy("code")
        .agg(total("v").alias("mtm_value"), total("d").alias("mtm_diff"), total("c").alias("mtm_cpty"))
    )


def _old(report: DataFrame, name: str) -> Column:
    return F.col(name) if name in report.columns else F.lit(None).cast("double")


def enrich_marks(report: DataFrame, marks: DataFrame) -> DataFrame:
    """JN-3 + CTL-1/2/3: counterparty mark and the eight gap columns.

    ``report`` needs ``code, notional (M), dirty_total (AN), dirty_pct (AO)``.
    A mark of 0.0 is a match.  Unmatched rows keep their former values (the
    report's own columns of the same name, or null).
    """
    m = marks.select("code", F.col("mtm_cpty").alias("_mark"), F.lit(True).alias("_matched"))
    j = report.join(m, "code", "left")
    matched = F.coalesce(F.col("_matched"), F.lit(False))
    an, mm, ao, aw = F.col("dirty_total"), F.col("notional"), F.col("dirty_pct"), F.col("_mark")
    bd = sub_optional(an, aw)
    be = div_optional(bd, mm)
    ax = div_optional(aw, mm)
    new = {
        "mtm_cpty": aw,
        "mtm_cpty_pct": ax,
        "mtm_gap": bd,
        "mtm_gap_pct": be,
        "mtm_gap_ctl": sub_optional(an, aw),
        # CTL-2: read the values just written in the same row
        "cmp_bs": sub_optional(an, bd),
        "cmp_bt": sub_optional(ao, be),
        "cmp_ca": sub_optional(aw, bd),
        "cmp_cb": sub_optional(ax, be),
    }
    out = j.withColumns({k: F.when(matched, v).otherwise(_old(report, k)) for k, v in new.items()})
    return out.withColumn("matched", matched).drop("_mark", "_matched")


def missing_codes(report: DataFrame, lookup: DataFrame, key: str = "code") -> DataFrame:
    """JN-2 / JN-4: report rows whose code has no entry (repeats kept)."""
    return report.join(lookup.select(key), key, "left_anti")


def unused_codes(lookup: DataFrame, report: DataFrame, key: str = "code") -> DataFrame:
    """JN-5: lookup codes the report never uses, distinct, sorted."""
    return (
        lookup.select(key).distinct()
        .join(report.select(key).distinct(), key, "left_anti")
        .orderBy(key)
    )


def last_wins(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """AGG-11: keep the last row per key (by ``order_col``).

    ``max_by`` over a struct of the other columns: a partial aggregate, so a
    hot key is reduced map-side instead of being sorted in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, F.col(order_col)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])
    )


SENSI_COLUMNS = ("duration_leg1", "sensi_leg1", "duration_leg2", "sensi_leg2", "duration_total", "sensi_total")


def enrich_sensitivities(report: DataFrame, sensis: DataFrame) -> DataFrame:
    """JN-1 + NUM-8 + CTL-3: six sensitivity columns by code.

    ``sensis`` is one row per code (see ``last_wins``); missing input columns
    count as null.  The total sensitivity is the given total, else the sum of
    the non-null legs.
    """
    def pick(name: str) -> Column:
        return F.col(name) if name in sensis.columns else F.lit(None).cast("double")

    s = sensis.select(
        "code",
        pick("duration_leg1").alias("_duration_leg1"),
        pick("sensi_leg1").alias("_sensi_leg1"),
        pick("duration_leg2").alias("_duration_leg2"),
        pick("sensi_leg2").alias("_sensi_leg2"),
        pick("duration_total").alias("_duration_total"),
        total_or_legs(pick("sensi_total"), pick("sensi_leg1"), pick("sensi_leg2")).alias("_sensi_total"),
        F.lit(True).alias("_matched"),
    )
    j = report.join(s, "code", "left")
    matched = F.coalesce(F.col("_matched"), F.lit(False))
    out = j.withColumns(
        {c: F.when(matched, F.col(f"_{c}")).otherwise(_old(report, c)) for c in SENSI_COLUMNS}
    )
    return out.withColumn("sensi_matched", matched).drop(*[f"_{c}" for c in SENSI_COLUMNS], "_matched")


def apply_overrides(report: DataFrame, overrides: DataFrame, class_name: str, column: str = "duration_leg1") -> DataFrame:
    """JN-11: replace ``column`` by the override value for codes of one class.

    ``overrides`` is ``(code, value)``; Spark broadcasts it if its size allows.
    """
    o = overrides.select(F.col("code").alias("_ocode"), F.col("value").alias("_ovalue"))
    j = report.join(o, report["code"] == o["_ocode"], "left")
    in_class = strip_ws(F.col("classif")) == F.lit(class_name)
    base = _old(report, column)
    return j.withColumn(
        column, F.when(in_class & F.col("_ocode").isNotNull(), F.col("_ovalue")).otherwise(base)
    ).withColumn("overridden", in_class & F.col("_ocode").isNotNull()).drop("_ocode", "_ovalue")


def run_date_of(report_cells: DataFrame, given=None) -> DataFrame:
    """CTL-5: run date per report file: the given date, else the report's
    cell B3 (row 3, column 2; strict date rules incl. Excel serials); stored, one
    row per file, so that rows meet it by a broadcast."""
    from ..functions import parse_date_strict, parse_number
    from ..session import materialize

    b3 = report_cells.where((F.col("row_idx") == 2) & (F.col("col_idx") == 1)).select(
        "source_file", parse_date_strict(F.col("value"), parse_number(F.col("value"))).alias("_b3"))
    files = report_cells.select("source_file").distinct()
    d = files.join(b3, "source_file", "left")
    g = F.lit(given).cast("date") if given is not None else F.lit(None).cast("date")
    return materialize(d.select("source_file", F.coalesce(g, F.col("_b3")).alias("run_date")), "run-dates")


def attach_thresholds(report: DataFrame, thresholds: DataFrame, run_date: Column) -> DataFrame:
    """JN-9 + DATE-4: maturity in years and the tolerance of its bucket.

    Class compared lower-case and stripped, index upper-case and stripped;
    a null maturity gets no threshold.
    """
    r = report.withColumns(
        {
            "maturity_years": year_fraction(run_date, F.col("end_date")),
            "_ck": F.lower(strip_ws(F.col("classif"))),
            "_ik": F.upper(strip_ws(F.col("index_rate"))),
        }
    )
    t = F.broadcast(thresholds)
    y = F.col("maturity_years")
    cond = (
        (F.col("_ck") == F.col("t_classif"))
        & (F.col("t_index").isNull() | (F.col("_ik") == F.col("t_index")))
        & y.isNotNull()
        & (F.col("t_lo").isNull() | (y >= F.col("t_lo")))
        & (F.col("t_hi").isNull() | (y < F.col("t_hi")))
    )
    return r.join(t, cond, "left").drop("_ck", "_ik", "t_classif", "t_index", "t_lo", "t_hi")


def tolerance_alerts(report: DataFrame, thresholds: DataFrame, run_date: Column, gap_col: str = "mtm_gap_pct") -> DataFrame:
    """CTL-4 (S13): ``alerte`` iff |gap| > threshold (strict); no threshold or
    no gap -> no alert.  The gap is a parameter, by default the MtM gap in
    percent of notional computed by ``enrich_marks``."""
    r = attach_thresholds(report, thresholds, run_date)
    gap = F.col(gap_col)
    alert = F.when(
        F.col("threshold").isNotNull() & gap.isNotNull() & ~F.isnan(gap) & (F.abs(gap) > F.col("threshold")),
        F.lit("alerte"),
    )
    return r.withColumn("alert", alert)


def run_counters(df: DataFrame, matched_col: str = "matched", alert_col: str = "alert") -> DataFrame:
    """AGG-12: updated / missing / alert counters in one pass."""
    return df.agg(
        F.count_if(F.col(matched_col)).alias("n_updated"),
        F.count_if(~F.col(matched_col)).alias("n_missing"),
        F.count_if(F.col(alert_col).isNotNull()).alias("n_alerts"),
    )
