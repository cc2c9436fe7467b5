"""Collateral reconciliation (DIM-1, STR-2, JN-8, AGG-2, AGG-3, JN-6, CTL-7,
AGG-7, CHK-5, SRT-1, MAP-14, FLT-4/5/6).

Plan shape: two aggregates (report side, collateral side), each keyed by the
normalised (counterparty, typology); one full outer join between them.  The
alias lookups are left joins on the case-folded clean label; the typology
alias table is a fixed handful of rows and is broadcast, the counterparty
alias table is left to Spark's size-checked join selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_label, parse_number, strip_ws
from ..functions.text import _c

# Counterparty labels of repeated header / total lines (FLT-5).
SKIP_COUNTERPARTY_LABELS = ("counterparty", "contrepartie", "cp", "total")
# Fixed value: gaps below this are "concordant" (CHK-5).
CONCORDANCE_TOLERANCE = 1e-6

# Default alias texts (alias = canonical, one per line).
DEFAULT_COUNTERPARTY_ALIASES = """\
# Counterparty aliases -> canonical name
SGCIB = SOCIETE GENERALE
SOCIETE GENERALE = SOCIETE GENERALE
BAMLS = BOFA SECURITIES
BOFA = BOFA SECURITIES
BOFA SECURITIES = BOFA SECURITIES
RBS = NATWEST MARKETS
NATWEST = NATWEST MARKETS
NATWEST MARKETS = NATWEST MARKETS
BARCLAYS = BARCLAYS BANK
BARCLAYS BANK = BARCLAYS BANK
GSOH = GOLDMAN SACHS
GOLDMAN SACHS = GOLDMAN SACHS
HSBCFR = HSBC CONTINENTAL EUROPE
HSBC = HSBC CONTINENTAL EUROPE
HSBC CONTINENTAL EUROPE = HSBC CONTINENTAL EUROPE
CREDIT SUISSE = CREDIT SUISSE
NOMURA = NOMURA FINANCIAL
NOMURA FINANCIAL = NOMURA FINANCIAL
MORGAN STANLEY = MORGAN STANLEY
BNPP = BNP PARIBAS
BNP PARIBAS = BNP PARIBAS
JPMSE = JP MORGAN SE
JP MORGAN = JP MORGAN SE
JP MORGAN SE = JP MORGAN SE
JPM = JP MORGAN SE
NATIXIS = NATIXIS
CA = CREDIT AGRICOLE
CEP = CREDIT AGRICOLE
CEPS = CREDIT AGRICOLE
CACIB = CREDIT AGRICOLE
CREDIT AGRICOLE = CREDIT AGRICOLE"""

DEFAULT_TYPOLOGY_ALIASES = """\
# Typology -> canonical value
Real Rate Swap = XpressInstrument
XpressInstrument = XpressInstrument
CMS Swap = IR swap, fixed/float
IR swap, fixed/float = IR swap, fixed/float
Cross Currency Swap = Cross currency, fixed/fixed
Cross currency, fixed/fixed = Cross currency, fixed/fixed
Forward = Forward"""


def alias_lines(spark, text: str) -> DataFrame:
    """Alias text as ``(line_no, line)`` rows (SRC-11 for inline text;
    ``spark.read.text`` + a line number gives the same shape for files)."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")


def parse_aliases(lines: DataFrame) -> DataFrame:
    """DIM-1: ``(line_no, line)`` -> ``(alias_key, canonical)``.

    Blank and ``#`` lines are skipped, an inline ``#`` cuts the line; the
    separator is ``=``, else ``:``, else a tab (first two non-blank fields).
    Labels are cleaned (STR-1), keys case-folded.  A later explicit alias of
    a key wins; a canonical value maps to itself unless the key has an
    explicit alias, the first such self row winning.
    """
    first = lines.select("line_no", strip_ws("line").alias("l0")).where(
        (F.col("l0") != "") & ~F.col("l0").startswith("#")
    )
    cut = F.when(F.instr("l0", "#") > 0, strip_ws(F.substring_index("l0", "#", 1))).otherwise(F.col("l0"))
    body = first.select("line_no", cut.alias("l")).where(F.col("l") != "")
    ln = F.col("l")
    tabs = F.filter(F.split(ln, "\t"), lambda x: strip_ws(x) != "")
    on_eq, on_colon = F.instr(ln, "=") > 0, F.instr(ln, ":") > 0
    alias = (
        F.when(on_eq, F.regexp_extract(ln, "^([^=]*)=", 1))
        .when(on_colon, F.regexp_extract(ln, "^([^:]*):", 1))
        .when(F.size(tabs) >= 2, tabs.getItem(0))
    )
    canonical = (
        F.when(on_eq, F.regexp_extract(ln, "^[^=]*=(.*)$", 1))
        .when(on_colon, F.regexp_extract(ln, "^[^:]*:(.*)$", 1))
        .when(F.size(tabs) >= 2, tabs.getItem(1))
    )
    parsed = body.select("line_no", clean_label(alias).alias("a"), clean_label(canonical).alias("c")).where(
        F.col("a").isNotNull() & F.col("c").isNotNull()
    )
    explicit = parsed.select("line_no", F.lower("a").alias("alias_key"), "c", F.lit(0).alias("kind"))
    selfrows = parsed.select("line_no", F.lower("c").alias("alias_key"), "c", F.lit(1).alias("kind"))
    both = explicit.unionByName(selfrows)
    return both.groupBy("alias_key").agg(
        F.coalesce(
            F.max_by(F.when(F.col("kind") == 0, F.col("c")), F.when(F.col("kind") == 0, F.col("line_no"))),
            F.min_by(F.when(F.col("kind") == 1, F.col("c")), F.when(F.col("kind") == 1, F.col("line_no"))),
        ).alias("canonical")
    )


def normalize_label(df: DataFrame, label_col: str, aliases: DataFrame, out_col: str) -> DataFrame:
    """JN-8 / STR-2: canonical label via the alias table, else the clean
    label upper-cased; null when the label is blank."""
    cleaned = clean_label(label_col)
    keyed = df.withColumn("_nk", F.lower(cleaned))
    a = aliases.select(F.col("alias_key").alias("_ak"), F.col("canonical").alias("_canon"))
    j = keyed.join(a, keyed["_nk"] == a["_ak"], "left")
    return j.withColumn(out_col, F.coalesce(F.col("_canon"), F.upper(clean_label(label_col)))).drop("_nk", "_ak", "_canon")


def sheet_amounts(df: DataFrame, classif: Column, cpty: Column, gam: Column, cp: Column) -> DataFrame:
    """AGG-2 input for one sheet: raw labels and the two amounts.

    Cleaning and the label filters (FLT-5) run in ``mtm_by_class_cpty`` after
    a pre-aggregation by raw label, i.e. once per distinct label instead of
    once per row."""
    return df.select(
        classif.alias("classif_raw"),
        cpty.alias("counterparty_raw"),
        gam.alias("mtm_own"),
        cp.alias("mtm_cpty"),
    )


def load_collateral(df: DataFrame, cpty: str, typology: str, gam: str, cp: str, order_col: str = "ord") -> DataFrame:
    """SRC-8 + FLT-4: collateral summary with clean labels; text amounts use
    NUM-2 (numbers pass through); rows lacking either label are dropped."""
    def amount(c: str) -> Column:
        return text_amount(c) if dict(df.dtypes)[c] == "string" else F.col(c)

    out = df.select(
        clean_label(cpty).alias("counterparty"),
        clean_label(typology).alias("typology"),
        amount(gam).alias("mtm_own"),
        amount(cp).alias("mtm_cpty"),
        F.col(order_col).alias("ord"),
    )
    return out.dropna(how="any", subset=["counterparty", "typology"])


def text_amount(c) -> Column:
    """Template / collateral cell text -> number (NUM-2)."""
    return parse_number(_c(c), "mixed")


def mtm_by_class_cpty(*sheets: DataFrame) -> DataFrame:
    """AGG-2 + SET-4 + FLT-5 + FLT-6: sum both amounts per (clean class,
    clean counterparty) over the union of the sheets; rows without any
    amount, blank labels and repeated header / total lines are skipped;
    nulls are skipped in the sums, a key with none sums to 0.

    Plan: partial + final aggregate by the raw labels (a few rows per
    distinct label pair), then labels are cleaned and filtered on that small
    result and the clean keys re-aggregated.  The label test is combined with
    the row count so Catalyst cannot push it back below the aggregate.
    """
    u = sheets[0]
    for s in sheets[1:]:
        u = u.unionByName(s)
    return by_clean_labels(by_raw_labels(u))


def by_raw_labels(amounts: DataFrame) -> DataFrame:
    """Sums ``g``, ``c`` of both amounts and the rows ``n`` with any, per raw label."""
    return amounts.groupBy("classif_raw", "counterparty_raw").agg(
        F.sum("mtm_own").alias("g"),
        F.sum("mtm_cpty").alias("c"),
        F.count_if(F.col("mtm_own").isNotNull() | F.col("mtm_cpty").isNotNull()).alias("n"),
    )


def marked_trades(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """AGG-2 on trades summed before they meet their marks: ``trades`` has
    ``code, classif_raw, counterparty_raw, own, n, n_own`` (rows, rows with an
    amount), ``marks`` one ``mark`` a code.  Each row of a code has its mark, so
    the marks of a group are the mark times its rows; sums of ``by_raw_labels``."""
    j = trades.join(marks.select("code", "mark"), "code", "left")
    return j.select(
        "classif_raw", "counterparty_raw", F.col("own").alias("g"), (F.col("mark") * F.col("n")).alias("c"),
        F.when(F.col("mark").isNotNull(), F.col("n")).otherwise(F.col("n_own")).alias("n"),
    )


def by_clean_labels(pre: DataFrame) -> DataFrame:
    """AGG-2 from sums by raw label (a label may come several times)."""
    k = pre.select(
        clean_label("classif_raw").alias("classif"),
        clean_label("counterparty_raw").alias("counterparty"),
        "g", "c", "n",
    )
    keep = F.when(
        F.col("n") > 0,
        F.col("classif").isNotNull()
        & F.col("counterparty").isNotNull()
        & ~F.lower("counterparty").isin(*SKIP_COUNTERPARTY_LABELS),
    ).otherwise(F.lit(False))
    return k.where(keep).groupBy("classif", "counterparty").agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("mtm_own"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("mtm_cpty"),
    )


def aggregate_by_norm(
    df: DataFrame, keys: list[str], text_cols: list[str], value_cols: list[str], order_col: str
) -> DataFrame:
    """AGG-3: per normalised key, first non-null label (by ``order_col``) and
    the sum of non-null amounts (0 when none).

    ``min_by`` alone would return null when the earliest label is null, so
    the order is masked to the non-null rows.
    """
    aggs = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in text_cols
    ] + [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in value_cols]
    return df.groupBy(*keys).agg(*aggs)


RECON_COLUMNS = (
    "norm_counterparty", "norm_typology", "counterparty_template", "classif_di",
    "mtm_own_template", "mtm_cpty_template", "counterparty_collateral", "typology",
    "mtm_own_collateral", "mtm_cpty_collateral", "gap_mtm_own", "gap_mtm_cpty",
    "present_template", "present_collateral",
)


def reconcile(template: DataFrame, collateral: DataFrame, cp_aliases: DataFrame, typ_aliases: DataFrame) -> DataFrame:
    """JN-6 + CTL-7 + MAP-14 + SRT-1: full outer comparison by normalised keys.

    ``template``: ``classif, counterparty, mtm_own, mtm_cpty`` (AGG-2 output,
    ordered by (classif, counterparty)); ``collateral``: ``counterparty,
    typology, mtm_own, mtm_cpty, ord``.  Missing amounts count 0; presence
    flags come from each side's label.  (S18: an empty side still returns the
    other side's rows.)
    """
    t = normalize_label(template, "counterparty", cp_aliases, "norm_counterparty")
    t = normalize_label(t, "classif", typ_aliases, "norm_typology")
    t = t.where(F.col("norm_counterparty").isNotNull() & F.col("norm_typology").isNotNull())
    t = t.withColumn("_ord", F.struct("classif", "counterparty"))
    t = aggregate_by_norm(t, ["norm_counterparty", "norm_typology"], ["counterparty", "classif"],
                          ["mtm_own", "mtm_cpty"], "_ord")
    c = normalize_label(collateral, "counterparty", cp_aliases, "norm_counterparty")
    c = normalize_label(c, "typology", typ_aliases, "norm_typology")
    c = c.where(F.col("norm_counterparty").isNotNull() & F.col("norm_typology").isNotNull())
    c = aggregate_by_norm(c, ["norm_counterparty", "norm_typology"], ["counterparty", "typology"],
                          ["mtm_own", "mtm_cpty"], "ord")
    t = t.select("norm_counterparty", "norm_typology",
                 F.col("counterparty").alias("counterparty_template"), F.col("classif").alias("classif_di"),
                 F.col("mtm_own").alias("_tg"), F.col("mtm_cpty").alias("_tc"))
    c = c.select("norm_counterparty", "norm_typology",
                 F.col("counterparty").alias("counterparty_collateral"), "typology",
                 F.col("mtm_own").alias("_cg"), F.col("mtm_cpty").alias("_cc"))
    j = c.join(t, ["norm_counterparty", "norm_typology"], "full")
    zero = F.lit(0)
    j = j.withColumns(
        {
            "mtm_own_template": F.coalesce("_tg", zero),
            "mtm_cpty_template": F.coalesce("_tc", zero),
            "mtm_own_collateral": F.coalesce("_cg", zero),
            "mtm_cpty_collateral": F.coalesce("_cc", zero),
        }
    ).withColumns(
        {
            "gap_mtm_own": F.col("mtm_own_template") - F.col("mtm_own_collateral"),
            "gap_mtm_cpty": F.col("mtm_cpty_template") - F.col("mtm_cpty_collateral"),
            "present_template": F.col("counterparty_template").isNotNull(),
            "present_collateral": F.col("counterparty_collateral").isNotNull(),
        }
    )
    return j.select(*RECON_COLUMNS)


def sort_recon(df: DataFrame) -> DataFrame:
    """SRT-1: by normalised keys, nulls last."""
    return df.orderBy(F.col("norm_counterparty").asc_nulls_last(), F.col("norm_typology").asc_nulls_last())


def max_gap(recon: DataFrame) -> DataFrame:
    """AGG-7 + CHK-5: largest absolute gap and the concordance flag."""
    g = F.greatest(F.abs("gap_mtm_own"), F.abs("gap_mtm_cpty"))
    return recon.agg(F.max(g).alias("max_abs_gap")).withColumn(
        "concordant", F.col("max_abs_gap") < F.lit(CONCORDANCE_TOLERANCE)
    )
