"""Input bindings: the report, feed, sensitivity, collateral and alias inputs
derived from the driver tables (FIXTURES.md section C).

Every binding is a narrow projection of one driver table (plus fixed
dimension rows), so it scales with the table and keeps column pruning and
filter pushdown intact.  Amounts stay exact decimals; operators sum them
exactly and cast to double last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed value: run date used by the tolerance and period bindings.
RUN_DATE = "1995-06-30"

LINEITEM_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def _dec(c: str, t: str = "decimal(12,2)") -> Column:
    return F.col(c).cast(t)


def _classif_of(part_key: Column) -> Column:
    m = part_key % 4
    return (
        F.when(m == 0, "CMS Swap")
        .when(m == 1, "Real Rate Swap")
        .when(m == 2, "Cross Currency Swap")
        .otherwise("Forward")
    )


def _code_raw() -> Column:
    sk = F.col("l_suppkey") % 4
    bad_code = F.when(sk == 0, "N/A").when(sk == 1, "  ").when(sk == 2, "-")
    return F.when(F.col("l_linenumber") == 7, bad_code).otherwise(
        F.concat(F.lit(" SWAP_"), F.col("l_partkey").cast("string"), F.lit(" "))
    )


def _trade_cpty() -> Column:
    return F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string"))


def _amounts() -> tuple[Column, Column]:
    """Own and counterparty mark of a line."""
    price = _dec("l_extendedprice")
    return price * _dec("l_discount", "decimal(4,2)"), price * _dec("l_tax", "decimal(4,2)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: one report row per lineitem row.

    ``ord`` is the row's position key: a struct of every lineitem column (the
    pair (orderkey, linenumber) repeats in the driver data).
    """
    li = table(spark, sf_dir, "lineitem", *LINEITEM_ORDER)
    s3 = F.col("l_suppkey") % 3
    price = _dec("l_extendedprice")
    notional = (
        F.when(F.col("l_quantity") == 50, F.lit(0).cast("decimal(12,2)"))
        .when(F.col("l_quantity") == 49, F.lit(None).cast("decimal(12,2)"))
        .otherwise(price)
    )
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        _code_raw().alias("code_raw"),
        _classif_of(F.col("l_partkey")).alias("classif"),
        F.when(s3 == 0, "HICPXT").when(s3 == 1, "frcpixt").otherwise("OTHER").alias("index_rate"),
        _trade_cpty().alias("cpty"),
        notional.alias("notional"),
        (price * _dec("l_discount", "decimal(4,2)")).alias("mtm_own"),
        (price * _dec("l_tax", "decimal(4,2)")).alias("mtm_cpty"),
        F.col("l_shipdate").cast("date").alias("end_date"),
        "l_returnflag",
        "l_linestatus",
        F.struct(*LINEITEM_ORDER).alias("ord"),
    )


def marks_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: counterparty mark feed rows, one per order (typed like a parsed feed)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    total = _dec("o_totalprice")
    free_text_2 = (
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("SWAP_"), (F.col("o_custkey") * 2).cast("string"), F.lit("/"), F.col("o_orderpriority")))
    )
    free_text_1 = (
        F.when(k % 3 == 0, F.concat(F.lit(" bdfwd "), k.cast("string")))
        .when(k % 3 == 1, F.lit("BDFWD"))
        .otherwise(F.lit("IRS"))
    )
    b = k % 5
    book = F.when(b == 0, "601").when(b == 1, "602.0").when(b == 2, " 603").when(b == 3, "604")
    cp = F.when(k % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("CP"), (F.col("o_custkey") % 9).cast("string")))
    notional = (
        F.when(k % 17 == 0, F.lit(0).cast("decimal(12,2)"))
        .when(k % 19 == 0, F.lit(None).cast("decimal(12,2)"))
        .otherwise(total)
    )
    mtm_value = total * F.lit(0.01).cast("decimal(4,2)")
    mtm_diff = F.when(
        ~((F.col("o_orderstatus") == "P") & (k % 4 == 0)),
        total * F.lit(0.0011).cast("decimal(6,4)") * (k % 10).cast("int"),
    )
    return o.select(
        k.alias("o_orderkey"),
        "o_orderstatus",
        free_text_2.alias("free_text_2"),
        free_text_1.alias("free_text_1"),
        book.alias("book"),
        cp.alias("cp"),
        notional.alias("notional"),
        mtm_value.alias("mtm_value"),
        mtm_diff.alias("mtm_diff"),
    )


def sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: sensitivity rows, two per part (``src_row`` orders them); each tenth
    part carries a code that no report row has."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    prefix = F.when(F.col("p_partkey") % 10 == 3, F.lit("UNUSED_")).otherwise(F.lit("SWAP_"))
    p = p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    size = F.col("p_size")
    price = F.col("p_retailprice")
    return p.select(
        F.concat(prefix, F.col("p_partkey").cast("string")).alias("code"),
        (F.col("p_partkey") * 2 + F.col("k")).alias("src_row"),
        F.when(size % 5 != 0, price + F.col("k")).alias("sensi_leg1"),
        F.when(size % 3 != 0, -price).alias("sensi_leg2"),
        F.when(size % 4 == 0, price * 2).alias("sensi_total"),
        size.cast("double").alias("duration_leg1"),
    )


def collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: collateral report lines (counterparty, typology, two MtM sums); each
    seventh supplier and the returned lines carry labels of their own, which
    the report side does not have."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    (cpty, typology), (own, other) = _collateral_labels(), _amounts()
    return li.groupBy(cpty.alias("cpty"), typology.alias("typology")).agg(
        F.sum(own).alias("mtm_own"), F.sum(other).alias("mtm_cpty")
    )


def _collateral_labels() -> tuple[Column, Column]:
    s = F.col("l_suppkey")
    sk = s.cast("string")
    spelling = (s + F.col("l_partkey") / 4).cast("long") % 5  # several spellings of one supplier and typology
    cpty = (
        F.when(s % 7 == 0, F.concat(F.lit("Unlisted#"), sk))
        .when(spelling == 0, F.concat(F.lit("SUP"), sk))
        .when(spelling == 1, F.concat(F.lit(" supplier#"), sk, F.lit("  ")))
        .otherwise(F.upper(F.concat(F.lit("Supplier#"), sk)))
    )
    pm = F.col("l_partkey") % 4
    typology = F.when(s % 7 == 1, F.lit("Repo")).otherwise(
        F.when(F.col("l_returnflag") == "A", "Returned line")
        .when(pm == 0, "IR swap, fixed/float")
        .when(pm == 1, "XpressInstrument")
        .when(pm == 2, "Cross currency, fixed/fixed")
        .otherwise("Forward")
    )
    return cpty, typology


def cpty_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: counterparty alias dimension, one row per supplier."""
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey").cast("string")
    return s.select(F.concat(F.lit("sup"), k).alias("alias_key"), F.concat(F.lit("SUPPLIER#"), k).alias("canonical"))


# Typology aliases (alias key -> canonical typology).
TYPOLOGY_ALIASES = (
    ("cms swap", "IR swap, fixed/float"),
    ("ir swap, fixed/float", "IR swap, fixed/float"),
    ("real rate swap", "XpressInstrument"),
    ("xpressinstrument", "XpressInstrument"),
    ("cross currency swap", "Cross currency, fixed/fixed"),
    ("cross currency, fixed/fixed", "Cross currency, fixed/fixed"),
)


def typology_aliases(spark: SparkSession) -> DataFrame:
    """Y: typology alias dimension (fixed, six rows)."""
    return spark.createDataFrame(list(TYPOLOGY_ALIASES), "alias_key string, canonical string")
