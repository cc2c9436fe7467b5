"""Fixed dimensions (DIM-2, DIM-3, DIM-4, override table of JN-11).

Each is a handful of rows; joins against them are the only places the
library asks for a broadcast, because their size is fixed by the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values (DIM-2): tolerance by class, index and maturity bucket.
# (class lower-case, index upper-case or None = any, years from, years to
#  (None = unbounded), threshold)
THRESHOLDS = (
    ("cms swap", None, None, 5.0, 0.005),
    ("cms swap", None, 5.0, None, 0.0075),
    ("real rate swap", "HICPXT", None, 8.0, 0.009),
    ("real rate swap", "HICPXT", 8.0, None, 0.0115),
    ("real rate swap", "FRCPIXT", None, 8.0, 0.005),
    ("real rate swap", "FRCPIXT", 8.0, None, 0.011),
    ("cross currency swap", None, None, 5.0, 0.006),
    ("cross currency swap", None, 5.0, None, 0.016),
)

# Fixed values (DIM-3): headers expected in a dealer valuation extract.
EXPECTED_HEADERS = (
    "#Ticket", "Trade ID", "External Id", "Counterparty", "Currency", "Class",
    "Custom Attribute5 Value", "Leg Type", "Pay/Rec", "Index/Fixed Rate",
    "Spread (bp)", "Start Date", "End Date", "Notional",
    "Dirty Value", "Clean Value", "Accrued Interest",
)

# Fixed values (DIM-4): category spellings and the five summary items.
CATEGORY_ALIASES = {
    "IR_SWAP": ("IR Swap", "IR - Swap", "CMS Swap"),
    "ASWI": ("ASWI", "IR ASWI", "Real Rate Swap"),
    "XCCY": ("XCCY", "IR XCCY", "Cross Currency Swap"),
    "BOND_FWD": ("Bond Forward", "Bond Fwd", "Bond FWD", "BondForward"),
}
# (order, label, bullet, needs_reason, categories, fallback spellings)
SUMMARY_ITEMS = (
    (1, "IR – ASWI – XCCY", "-  ", False, ("IR_SWAP", "ASWI", "XCCY"),
     ("IR – ASWI – XCCY", "IR - ASWI - XCCY", "IR-ASWI-XCCY")),
    (2, "IR Swap", "- ", True, ("IR_SWAP",), ()),
    (3, "ASWI", "- ", True, ("ASWI",), ()),
    (4, "XCCY", "o ", True, ("XCCY",), ()),
    (5, "Bond Forward", "- ", True, ("BOND_FWD",), ()),
)

# Fixed values (JN-11): leg-1 modified duration overrides for Real Rate Swaps.
OVERRIDE_CLASS = "Real Rate Swap"
OVERRIDE_TSV = """Code DI\tModified Duration
SWAP_258\t-0,98
SWAP_253\t-0,98
SWAP_240\t-1,83
SWAP_262\t-0,98
SWAP_254\t-0,98
SWAP_257\t-0,98
SWAP_235\t-3,65
SWAP_149\t-3,65
SWAP_255\t-0,98
SWAP_234\t-3,65
SWAP_148\t-3,65
"""


def _py_norm(s: str) -> str:
    return " ".join(s.strip().lower().split())


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(THRESHOLDS),
        "t_classif string, t_index string, t_lo double, t_hi double, threshold double",
    )


def expected_headers(spark: SparkSession) -> DataFrame:
    rows = sorted({_py_norm(h) for h in EXPECTED_HEADERS})
    return spark.createDataFrame([(h,) for h in rows], "label_norm string")


def category_bridge(spark: SparkSession) -> DataFrame:
    """Bridge (item -> category spelling), fallback spellings flagged.

    One class total can feed several items (groups overlap), so this is a
    many-to-many bridge, not a rollup.
    """
    rows = []
    for order, label, bullet, reason, cats, fallback in SUMMARY_ITEMS:
        for cat in cats:
            for alias in sorted({_py_norm(a) for a in CATEGORY_ALIASES[cat]}):
                rows.append((order, label, bullet, reason, cat, alias, False))
        for alias in sorted({_py_norm(a) for a in fallback}):
            rows.append((order, label, bullet, reason, None, alias, True))
    return spark.createDataFrame(
        rows,
        "item_ord int, item_label string, bullet string, needs_reason boolean, "
        "category string, alias_norm string, is_fallback boolean",
    )


def summary_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(o, lab, b, r) for o, lab, b, r, _, _ in SUMMARY_ITEMS],
        "item_ord int, item_label string, bullet string, needs_reason boolean",
    )
