"""Period comparison: this production against the previous one
(AGG-4, AGG-5, AGG-6, AGG-8, JN-7, JN-10, CTL-8, CTL-9, NUM-10, SRT-2, STR-7).

Class totals are one grouped aggregate per production; the comparison is a
full outer join of two small (one row per class) results.  The category
roll-up joins the class totals with a fixed bridge (broadcast) and groups by
summary item: groups overlap, so it is a bridge join, not ``rollup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import format_money, norm_label, pct_change, strip_ws

# Key the bond-forward total is added under, and its header.
BOND_FORWARD_KEY = "Bond Forward"
BOND_FORWARD_HEADER = "Prix GAM"
# Summary text pieces.
SUMMARY_GREETING = "Bonjour,"
SUMMARY_INTRO = "Voici le fichier des IFTs au {date}  :\n"
SUMMARY_SECTION = "I. Point MtM :\n"
SUMMARY_UNIT_DATED = " MEUR au {date} \n"
SUMMARY_UNIT = " MEUR"
SUMMARY_REASON = "-> Dégradation/Amélioration du MTM en raison (à remplir)"


def dirty_by_class(swaps: DataFrame, forwards: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-4 + AGG-5 + FLT-7: dirty value per class plus the bond-forward total.

    ``swaps``: ``classif, dirty`` (class stripped, case kept; blank class or
    missing amount skipped).  ``forwards``: ``prix_gam``; its parsed amounts
    are added under ``Bond Forward`` (no key when none parses).  ``keys``
    (e.g. a production column present in both inputs) group several
    productions in the same single pass.
    """
    s = swaps.select(*keys, F.col("classif").alias("classif_raw"), F.col("dirty").alias("amount"))
    if forwards is not None:
        f = forwards.select(*keys, F.lit(BOND_FORWARD_KEY).alias("classif_raw"), F.col("prix_gam").alias("amount"))
        s = s.unionByName(f)
    # pre-aggregate by the raw label, strip once per distinct label, regroup
    pre = s.groupBy(*keys, "classif_raw").agg(F.sum("amount").alias("t"), F.count("amount").alias("n"))
    k = pre.select(*keys, strip_ws("classif_raw").alias("classif"), "t", "n")
    keep = F.when(F.col("n") > 0, F.col("classif").isNotNull() & (F.col("classif") != "")).otherwise(F.lit(False))
    return k.where(keep).groupBy(*keys, "classif").agg(F.sum("t").alias("total"))


def compare_long(totals: DataFrame, production_col: str = "production",
                 current: str = "current", previous: str = "previous") -> DataFrame:
    """JN-7 + CTL-8 + NUM-10 + SET-2 on long totals (``production, classif,
    total``): one grouped aggregate with conditional sums instead of a full
    outer join; a class present in either production appears once, a
    missing side counts 0, gap = new - old, gap % = gap / old * 100 (null
    when |old| <= 1e-12)."""
    p = F.col(production_col)
    g = totals.groupBy("classif").agg(
        F.sum(F.when(p == current, F.col("total"))).alias("_new"),
        F.sum(F.when(p == previous, F.col("total"))).alias("_old"),
        F.count_if(p.isin(current, previous)).alias("_n"),
    ).where(F.col("_n") > 0)
    old = F.coalesce("_old", F.lit(0))
    new = F.coalesce("_new", F.lit(0))
    return g.select(
        "classif",
        old.alias("dirty_previous"),
        new.alias("dirty_current"),
        (new - old).alias("gap"),
        pct_change(old.cast("double"), new.cast("double")).alias("gap_pct"),
    )


def compare_periods(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Two productions given apart: tagged, unioned, compared by ``compare_long``."""
    u = current.select(F.lit("current").alias("production"), "classif", "total").unionByName(
        previous.select(F.lit("previous").alias("production"), "classif", "total"))
    return compare_long(u)


def sort_by_gap(df: DataFrame) -> DataFrame:
    """SRT-2: largest absolute gap first, ties by class."""
    return df.orderBy(F.abs("gap").desc(), F.col("classif").asc())


def period_totals(current: DataFrame, previous: DataFrame) -> DataFrame:
    """AGG-6: grand totals of both productions and their difference."""
    u = current.select(F.lit("current").alias("production"), "total").unionByName(
        previous.select(F.lit("previous").alias("production"), "total"))
    return totals_long(u)


def totals_long(totals: DataFrame, production_col: str = "production",
                current: str = "current", previous: str = "previous") -> DataFrame:
    """AGG-6 on long totals: one global aggregate (partial sums per task)."""
    p = F.col(production_col)
    t = totals.agg(
        F.coalesce(F.sum(F.when(p == current, F.col("total"))), F.lit(0)).alias("total_current"),
        F.coalesce(F.sum(F.when(p == previous, F.col("total"))), F.lit(0)).alias("total_previous"),
    )
    return t.withColumn("delta_total", F.col("total_current") - F.col("total_previous"))


def rollup_productions(totals: DataFrame, bridge: DataFrame, items: DataFrame, production_col: str = "production",
                       current: str = "current", previous: str = "previous") -> DataFrame:
    """JN-10 + AGG-8 for two productions in one pass over long totals
    (``production, classif, total``): one row per summary item with its
    current and previous value.

    Class labels are normalised (GRD-1) and summed per spelling; an item sums
    its categories' spellings that are present; if none is present, its
    fallback spellings; else null (S10: all present spellings are summed).
    """
    p = F.col(production_col)
    norm = totals.groupBy(p.alias("_p"), norm_label("classif").alias("alias_norm")).agg(F.sum("total").alias("v"))
    j = norm.join(F.broadcast(bridge), "alias_norm", "inner")
    cat, fb = ~F.col("is_fallback"), F.col("is_fallback")

    def side(tag: str, name: str):
        mine = F.col("_p") == tag
        return [
            F.sum(F.when(mine & cat, F.col("v"))).alias(f"_{name}_cat"),
            F.count_if(mine & cat).alias(f"_{name}_n"),
            F.sum(F.when(mine & fb, F.col("v"))).alias(f"_{name}_fb"),
        ]

    per_item = j.groupBy("item_ord").agg(*side(current, "cur"), *side(previous, "prev"))
    out = items.join(per_item, "item_ord", "left")

    def value(name: str):
        return F.when(F.col(f"_{name}_n") > 0, F.col(f"_{name}_cat")).otherwise(F.col(f"_{name}_fb"))

    return out.select("item_ord", "item_label", "bullet", "needs_reason", value("cur").alias("cur"), value("prev").alias("prev"))


def summary_text_wide(items: DataFrame, current_date: str, previous_date: str) -> DataFrame:
    """CTL-9 + STR-7: MtM summary text (one row, null when no item has a value)
    from ``item_ord, item_label, bullet, needs_reason, cur, prev``.

    One line per item with a current or previous value: bullet, label,
    current vs previous in millions; a reason placeholder where flagged.
    At most five items, so the final string assembly is one small group.
    """
    j = items.where(F.col("cur").isNotNull() | F.col("prev").isNotNull())
    unit = SUMMARY_UNIT_DATED.format(date=previous_date) if current_date else SUMMARY_UNIT
    line = F.concat(F.col("bullet"), F.col("item_label"), F.lit(" : "), format_money("cur"), F.lit(" vs "),
                    format_money("prev"), F.lit(unit))
    block = F.when(F.col("needs_reason"), F.concat_ws("\n", line, F.lit(SUMMARY_REASON), F.lit(""))).otherwise(
        F.concat_ws("\n", line, F.lit(""))
    )
    body = j.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("item_ord"), block.alias("b")))).alias("_blocks"),
        F.count(F.lit(1)).alias("_n"),
    )
    head = "\n".join([SUMMARY_GREETING, "", SUMMARY_INTRO.format(date=current_date), SUMMARY_SECTION])
    text = F.concat(F.lit(head + "\n"), F.array_join(F.transform("_blocks", lambda x: x["b"]), "\n"))
    return body.select(F.when(F.col("_n") > 0, strip_ws(text)).alias("summary"))
