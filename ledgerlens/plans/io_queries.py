"""Queries that write derived inputs/outputs to the checkpoint folder and
read them back through the library's readers: counterparty feed files in two
header layouts (SRC-6/7, CHK-1/2), ZIP archives (SRC-2, UDF-4), alias text
files (SRC-11), and run-partitioned outputs (SNK-1, SNK-5, SRC-17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import code_prefix
from ..operators import forwards
from ..operators import reconcile as R
from ..session import ensure_checkpoint_dir
from ..sources import archives as A
from ..sources import bindings as B
from ..sources import feeds, sinks
from . import bindings_sql as BS
from . import sqltext as S
from .catalog import _forwards, register
from .oracle import ORACLE


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-io/{name}-{uuid.uuid4().hex}"


def _write_feed_files(spark, sf_dir) -> str:
    """Feed CSV files from M: open orders in layout A (all columns, decimal
    point), the others in layout B (reordered, no FREE_TEXT_1/BOOK, decimal
    comma, NA tokens)."""
    m = B.marks_feed(spark, sf_dir)
    base = _scratch(spark, "feeds")
    a = m.where(F.col("o_orderstatus") == "O").select(
        F.col("free_text_2").alias("FREE_TEXT_2"), F.col("mtm_value").cast("string").alias("MTM_VALUE"),
        F.col("mtm_diff").cast("string").alias("MTM_DIFF"), F.col("free_text_1").alias("FREE_TEXT_1"),
        F.col("book").alias("BOOK"), F.col("cp").alias("CP"), F.col("notional").cast("string").alias("NOTIONAL"))
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    b = m.where(F.col("o_orderstatus") != "O").select(
        F.coalesce(comma("notional"), F.lit("N/A")).alias("NOTIONAL"), F.col("cp").alias("CP"),
        F.coalesce(comma("mtm_diff"), F.lit("nan")).alias("MTM_DIFF"), F.col("free_text_2").alias("FREE_TEXT_2"),
        comma("mtm_value").alias("MTM_VALUE"))
    opts = {"header": True, "sep": ";", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    a.write.options(**opts).csv(f"{base}/layout_a")
    b.write.options(**opts).csv(f"{base}/layout_b")
    return base


@register
def feed_csv(spark, sf_dir):
    """SRC-6, SRC-7, CHK-2, STR-4, STR-6, NUM-1: counterparty feed files with
    two header layouts read by name, NA tokens nulled, amounts parsed."""
    base = _write_feed_files(spark, sf_dir)
    rows, layouts = feeds.read_delimited(spark, [f"{base}/layout_a/*.csv", f"{base}/layout_b/*.csv"], sep=";")
    feed = feeds.feed_from_text(rows)
    has_ft1 = layouts.select("source_file", F.array_contains("header", "FREE_TEXT_1").alias("full_layout"))
    return feed.join(has_ft1, "source_file").select(
        "free_text_2", code_prefix("free_text_2").alias("code"), "free_text_1", "book", "cp",
        "notional", "mtm_value", "mtm_diff", "full_layout")


_NA = "(" + ", ".join(S.q(t) for t in feeds.NA_TOKENS) + ")"


def _na(x: str) -> str:
    return f"case when {x} in {_NA} then null else {x} end"


ORACLE["feed_csv"] = f"""with m as ({BS.M}), f as (
 select {_na('free_text_2')} as free_text_2, case when o_orderstatus = 'O' then {_na('free_text_1')} end as free_text_1,
  case when o_orderstatus = 'O' then {_na('book')} end as book, {_na('cp')} as cp,
  cast(notional as double) as notional, cast(mtm_value as double) as mtm_value, cast(mtm_diff as double) as mtm_diff,
  o_orderstatus = 'O' as full_layout from m)
select free_text_2, {S.code_prefix('free_text_2')} as code, free_text_1, book, cp, notional, mtm_value, mtm_diff, full_layout from f"""


@register
def feed_missing_columns(spark, sf_dir):
    """CHK-1, CHK-2: per feed file, required and optional columns its header lacks."""
    base = _write_feed_files(spark, sf_dir)
    _, layouts = feeds.read_delimited(spark, [f"{base}/layout_a/*.csv", f"{base}/layout_b/*.csv"], sep=";")
    req = feeds.missing_columns(layouts, feeds.FEED_REQUIRED, "required")
    opt = feeds.missing_columns(layouts, feeds.FEED_OPTIONAL, "optional")
    out = req.unionByName(opt)
    return out.select(F.regexp_extract("source_file", r"/(layout_[ab])/", 1).alias("layout"), "check",
                      F.array_join("missing", ", ").alias("missing")).distinct()


@register
def feed_multiline(spark, sf_dir):
    """SRC-6, SRC-7, STR-4, NUM-1: feed files whose quoted fields hold line feeds,
    separators and doubled quotes; a record may span lines and read splits."""
    k = F.col("o_orderkey")
    note = (
        F.when(k % 6 == 0, F.concat(F.lit("first "), k.cast("string"), F.lit("\nsecond; line\n")))
        .when(k % 6 == 1, F.concat(F.lit('said "'), k.cast("string"), F.lit('"\n"twice"')))
        .when(k % 6 == 2, F.lit('5" pipe'))
        .otherwise(F.col("free_text_1"))
    )
    m = B.marks_feed(spark, sf_dir).select(
        "free_text_2", note.alias("FREE_TEXT_1"), F.col("mtm_value").cast("string").alias("MTM_VALUE"),
        F.col("mtm_diff").cast("string").alias("MTM_DIFF"), k.cast("string").alias("CP"),
    ).withColumnRenamed("free_text_2", "FREE_TEXT_2")
    base = _scratch(spark, "multiline")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    m.write.options(header=True, sep=";", escape='"', **keep).csv(base)
    rows, _ = feeds.read_delimited(spark, [f"{base}/*.csv"], sep=";")
    feed = feeds.feed_from_text(rows)
    return feed.select(code_prefix("free_text_2").alias("code"), "free_text_1", "cp", "mtm_value", "mtm_diff")


ORACLE["feed_multiline"] = f"""with m as ({BS.M}), f as (
 select free_text_2, cast(o_orderkey as varchar) as cp, cast(mtm_value as double) as mtm_value, cast(mtm_diff as double) as mtm_diff,
  case o_orderkey % 6 when 0 then concat('first ', o_orderkey, chr(10), 'second; line', chr(10))
   when 1 then concat('said "', o_orderkey, '"', chr(10), '"twice"') when 2 then '5" pipe' else free_text_1 end as note from m)
select {S.code_prefix(_na('free_text_2'))} as code, {_na('note')} as free_text_1, cp, mtm_value, mtm_diff from f"""


def _members(spark, sf_dir):
    """Archive rows from the listing binding: one member per order, grouped
    into one archive per folder, some in sub-folders, some folder entries."""
    from .file_queries import listing

    lst = listing(spark, sf_dir)
    k = F.col("o_orderkey")
    member = F.when(k % 5 == 0, F.concat(F.lit("sub/"), F.col("file_name"))).otherwise(F.col("file_name"))
    files = lst.select(F.regexp_replace("folder", "/", "_").alias("archive"), member.alias("member"),
                       F.col("file_name").alias("text"))
    dirs = lst.select(F.regexp_replace("folder", "/", "_").alias("archive")).distinct().select(
        "archive", F.lit("sub/").alias("member"), F.lit("").alias("text"))
    return files.unionByName(dirs)


@register
def archive_members(spark, sf_dir):
    """SRC-2, UDF-4, SRC-3: archives written from the listing, expanded in
    Python workers (zipfile), filtered to .xls/.xlsx files (any case),
    flattened and given collision-free names per archive."""
    from ..sources.files import collision_names

    base = _scratch(spark, "archives")
    A.write_archives(_members(spark, sf_dir), base).write.format("noop").mode("overwrite").save()
    mem = A.select_members(A.read_archives(spark, base))
    mem = mem.withColumn("dest", F.regexp_extract("archive", r"^(.*)-p[0-9]+-b[0-9]+\.zip$", 1))
    named = collision_names(mem.select("dest", "basename", F.col("member").alias("ord"), "size"),
                            mem.sparkSession.createDataFrame([], "dest string, file_name string"))
    return named.select("dest", F.col("ord").alias("member"), "basename", "target_name", "size")


@register
def alias_file(spark, sf_dir):
    """SRC-11, DIM-1: alias text written as files and read back with
    ``spark.read.text`` (line order from the file position)."""
    from .catalog import alias_text

    base = _scratch(spark, "aliases")
    # the same lines as the alias_text query, one file, one line each
    s = B.table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    ks = k.cast("string")
    main = (F.when(k % 4 == 0, F.concat(F.lit("sup"), ks, F.lit(" = SUPPLIER#"), ks, F.lit(" # desk")))
            .when(k % 4 == 1, F.concat(F.lit("sup"), ks, F.lit(" : SUPPLIER#"), ks))
            .when(k % 4 == 2, F.concat(F.lit("sup"), ks, F.lit("\tSUPPLIER#"), ks))
            .otherwise(F.concat(F.lit("# sup"), ks, F.lit(" = skipped"))))
    extra = F.when(k % 10 == 0, F.concat(F.lit("  SUP"), ks, F.lit(" =  Supplier#"), ks, F.lit(" bis ")))
    lines = s.select(F.explode(F.array(F.struct((k * 2).alias("n"), main.alias("line")),
                                       F.struct((k * 2 + 1).alias("n"), extra.alias("line")))).alias("x")) \
        .select("x.n", "x.line").where(F.col("line").isNotNull())
    # plain lines in ranges of their order: part file names and positions keep it
    lines.repartitionByRange("n").sortWithinPartitions("n").select("line").write.text(base)
    txt = spark.read.text(base).select(
        F.col("_metadata.file_name").alias("file"), feeds.line_position(), F.col("value").alias("line"))
    return R.parse_aliases(txt.select(F.struct("file", "position").alias("line_no"), "line"))


@register
def sinks_roundtrip(spark, sf_dir):
    """SNK-1, SNK-5, SNK-6, SRC-17: accepted bond forwards written as run
    partitions (year / MM-yyyy / mode), the fast runs rewritten (dynamic
    overwrite replaces only them), everything read back."""
    base = _scratch(spark, "runs")
    m = B.marks_feed(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("_st"))
    o = B.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    fw = forwards.forward_alerts(_forwards(spark, sf_dir)).select("o_orderkey", "free_text", "gap_pct", "alert")
    fw = fw.join(o, "o_orderkey").withColumn("run_mode", F.when(F.col("o_orderkey") % 2 == 0, "Fast").otherwise("Close"))
    out = sinks.with_run_partitions(fw, "o_orderdate", "run_mode").drop("run_mode", "o_orderdate")
    sinks.write_runs(out, base)
    sinks.write_runs(out.where(F.col("mode") == "fast"), base)
    back = spark.read.parquet(base)
    return back.select("o_orderkey", "free_text", "gap_pct", "alert", F.col("year").cast("string").alias("year"),
                       "month", "mode")


ORACLE["sinks_roundtrip"] = ORACLE["forward_alerts"].replace(
    "select *, case when gap_pct is not null and abs(gap_pct) > 0.005 then 'alerte' end as alert from fa",
    """select fa.o_orderkey, fa.free_text, fa.gap_pct,
 case when gap_pct is not null and abs(gap_pct) > 0.005 then 'alerte' end as alert,
 strftime(o.o_orderdate, '%Y') as year, strftime(o.o_orderdate, '%m-%Y') as month,
 case when fa.o_orderkey % 2 = 0 then 'fast' else 'close' end as mode
from fa join orders o on o.o_orderkey = fa.o_orderkey""")

ORACLE["alias_file"] = ORACLE["alias_text"]

ORACLE["feed_missing_columns"] = """select distinct 'layout_b' as layout, 'optional' as "check", 'BOOK, FREE_TEXT_1' as missing
from orders where o_orderstatus <> 'O'"""


def _archive_oracle() -> str:
    from .file_queries import _L

    return f"""with l as ({_L}),
m as (select replace(folder, '/', '_') as dest, case when o_orderkey % 5 = 0 then concat('sub/', file_name) else file_name end as member,
  file_name as basename, cast(strlen(file_name) as bigint) as size from l),
s as (select *, row_number() over (partition by dest, basename order by member) - 1 as j from m
  where ends_with(lower(member), '.xls') or ends_with(lower(member), '.xlsx'))
select dest, member, basename, case when j = 0 then basename
  else concat(regexp_extract(basename, '^(.*?)(\\.[^.]*)?$', 1), '_', cast(j as varchar), regexp_extract(basename, '^(.*?)(\\.[^.]*)?$', 2)) end as target_name,
  size from s"""


ORACLE["archive_members"] = _archive_oracle()


# Collateral report headers (with their trailing blanks) and our names.
COLLATERAL_HEADERS = ("Counterparty ", "Typologie ", "MTM Gam ", "MTM Counterparty ")


@register
def collateral_file(spark, sf_dir):
    """SRC-8, CHK-1, FLT-4, NUM-2, STR-1: collateral report file with
    trailing-blank headers, matched on trimmed names, labels cleaned, text
    amounts parsed (mixed dialect), rows without both labels dropped."""
    base = _scratch(spark, "collateral")
    c = B.collateral(spark, sf_dir)
    dec_comma = (F.hash("cpty", "typology") % 2) == 0
    as_text = lambda x: F.when(dec_comma, F.replace(F.col(x).cast("string"), F.lit("."), F.lit(","))).otherwise(F.col(x).cast("string"))
    blank_label = F.when(F.col("typology") == "Repo", F.lit("  ")).otherwise(F.col("typology"))
    out = c.select(F.col("cpty").alias(COLLATERAL_HEADERS[0]), blank_label.alias(COLLATERAL_HEADERS[1]),
                   as_text("mtm_own").alias(COLLATERAL_HEADERS[2]), as_text("mtm_cpty").alias(COLLATERAL_HEADERS[3]))
    out.write.options(header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(base)
    # CHK-1 is a report over the layouts (feeds.missing_columns), not a plan-time stop
    wanted = tuple(h.strip() for h in COLLATERAL_HEADERS)
    rows_, _ = feeds.read_delimited(spark, [f"{base}/*.csv"], sep=";", columns=wanted)
    named = rows_.select(*[F.col(f"`{h}`").alias(n) for h, n in zip(wanted, ("cpty", "typology", "mtm_own", "mtm_cpty"))],
                         F.struct("source_file", "position").alias("ord"))
    loaded = R.load_collateral(named, "cpty", "typology", "mtm_own", "mtm_cpty")
    return loaded.select("counterparty", "typology", "mtm_own", "mtm_cpty")


ORACLE["collateral_file"] = f"""with c as ({BS.C}),
t as (select {S.clean_label('cpty')} as counterparty,
  {S.clean_label("case when typology = 'Repo' then '  ' else typology end")} as typology,
  cast(mtm_own as double) as mtm_own, cast(mtm_cpty as double) as mtm_cpty from c)
select * from t where counterparty is not null and typology is not null"""


@register
def csv_export(spark, sf_dir):
    """SNK-3, SNK-4: the reconciliation exported as CSV with a header line
    and as a table, both read back (CSV columns as text)."""
    from .catalog import _recon

    base = _scratch(spark, "export")
    r = _recon(spark, sf_dir)
    sinks.write_csv(r, f"{base}/csv")
    r.write.mode("overwrite").parquet(f"{base}/table")
    csv = spark.read.option("header", True).csv(f"{base}/csv")
    tbl = spark.read.parquet(f"{base}/table")
    keys = ["norm_counterparty", "norm_typology"]
    return csv.select(*keys, F.col("present_template").alias("present_template_text")).join(
        tbl.select(*keys, "gap_mtm_own", "gap_mtm_cpty"), keys, "inner")


ORACLE["csv_export"] = ORACLE["collateral_recon"].replace(
    "select * from rc order by norm_counterparty nulls last, norm_typology nulls last",
    "select norm_counterparty, norm_typology, cast(present_template as varchar) as present_template_text, gap_mtm_own, gap_mtm_cpty from rc")
