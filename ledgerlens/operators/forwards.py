"""Bond-forward branch of the counterparty feed (FLT-3, CHK-3, CTL-6, STR-5).

All per-row rules are Column expressions; rows are never collected.  The
sheet placement of accepted rows (rejected rows leave no gap) is done by
``placement.sequential_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_str, div_optional, normalize_book, strip_ws, sub_optional
from ..functions.text import NBSP

# Bond-forward selection and tolerance.
FORWARD_PREFIX = "BDFWD"
FORWARD_BOOKS = ("601", "602", "603")
FORWARD_THRESHOLD = 0.005
# Quality messages.
ALERT_TEXT = "alerte"
MISSING_TEXT = " → données manquantes: "
ROW_LABEL = "Ligne "
# Fields whose absence rejects a row (the other two only warn).
REJECTING = ("NOTIONAL", "MTM_VALUE", "MTM_DIFF")


def select_forwards(feed: DataFrame, books=FORWARD_BOOKS, prefix: str = FORWARD_PREFIX) -> DataFrame:
    """FLT-3: rows whose free text starts with the prefix (case-insensitive,
    after strip, then NBSP -> blank) and whose normalised book is allowed.

    Adds the columns of ``forward_fields``.
    """
    return forward_fields(feed).where(is_forward(books, prefix))


def is_forward(books=FORWARD_BOOKS, prefix: str = FORWARD_PREFIX) -> Column:
    """FLT-3 on rows with the columns of ``forward_fields``; never null."""
    hit = F.upper(F.col("free_text")).startswith(prefix) & F.col("book_norm").isin(*books)
    return F.coalesce(hit, F.lit(False))


def forward_fields(feed: DataFrame) -> DataFrame:
    """Adds ``free_text``, ``book_norm``, ``cp_clean`` and double amounts
    ``notional_d, mtm_value_d, mtm_diff_d`` (NaN -> null, S1/S2)."""
    free_text = strip_ws(F.replace(clean_str("free_text_1"), F.lit(NBSP), F.lit(" ")))
    book = normalize_book(F.col("book"))
    return feed.withColumns(
        {
            "free_text": free_text,
            "book_norm": book,
            "cp_clean": clean_str("cp"),
            "notional_d": _num("notional"),
            "mtm_value_d": _num("mtm_value"),
            "mtm_diff_d": _num("mtm_diff"),
        }
    )


def _num(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def forward_quality(fwd: DataFrame, row_pos: str | None = None) -> DataFrame:
    """CHK-3: list the missing fields of each selected row.

    NOTIONAL (null or 0), MTM_VALUE and MTM_DIFF reject the row; blank
    FREE_TEXT_1 / CP only warn.  ``label`` is the free text, or
    ``Ligne <n>`` from ``row_pos`` (1-based) when it is blank.
    """
    notional, v, d = F.col("notional_d"), F.col("mtm_value_d"), F.col("mtm_diff_d")
    checks = [
        ("FREE_TEXT_1", F.col("free_text") == ""),
        ("CP", F.col("cp_clean") == ""),
        ("NOTIONAL", notional.isNull() | (notional == 0)),
        ("MTM_VALUE", v.isNull()),
        ("MTM_DIFF", d.isNull()),
    ]
    missing = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    rejected = F.arrays_overlap(missing, F.array(*[F.lit(x) for x in REJECTING]))
    fallback = F.concat(F.lit(ROW_LABEL), F.col(row_pos).cast("string")) if row_pos else F.lit(None).cast("string")
    label = F.when(F.col("free_text") != "", F.col("free_text")).otherwise(fallback)
    status = F.when(rejected, "rejected").when(F.size(missing) > 0, "warning").otherwise("ok")
    message = F.when(F.size(missing) > 0, F.concat(label, F.lit(MISSING_TEXT), F.array_join(missing, ", ")))
    return fwd.withColumns(
        {"missing": F.array_join(missing, ", "), "status": status, "label": label, "message": message}
    )


def forward_alerts(fwd_checked: DataFrame, threshold: float = FORWARD_THRESHOLD) -> DataFrame:
    """CTL-6: accepted rows with counterparty price, both ratios and the gap.

    price = sub_optional(MTM, DIFF); MTM % = MTM / N; cpty % = price / N;
    gap = MTM % - cpty % (null if either is null); ``alerte`` iff
    |gap| > threshold (strict).  Output columns follow the sheet A-K.
    """
    v, d, n = F.col("mtm_value_d"), F.col("mtm_diff_d"), F.col("notional_d")
    price = sub_optional(v, d)
    mtm_pct = div_optional(v, n)
    cpty_pct = div_optional(price, n)
    gap = mtm_pct - cpty_pct
    ok = fwd_checked.where(F.col("status") != "rejected")
    return ok.withColumns(
        {
            "cp_out": F.nullif(F.col("cp_clean"), F.lit("")),
            "cpty_price": price,
            "mtm_pct": mtm_pct,
            "cpty_pct": cpty_pct,
            "threshold": F.lit(threshold),
            "gap_pct": gap,
        }
    ).withColumn(
        "alert", F.when(F.col("gap_pct").isNotNull() & (F.abs(F.col("gap_pct")) > F.lit(threshold)), F.lit(ALERT_TEXT))
    )
