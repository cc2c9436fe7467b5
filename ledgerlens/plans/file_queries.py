"""File-selection queries (SRC-1, SRC-3, SRC-4, SRC-12..16, DATE-6, DATE-7,
STR-8, CHK-4) over a listing derived from every ``orders`` row, and the
set / text queries SET-1, MAP-13, AGG-13, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code_text, valid_code
from ..sources import bindings as B
from ..sources import files as FS
from . import bindings_sql as BS
from . import sqltext as S
from .catalog import register
from .oracle import ORACLE

ORG = "org"  # feed-name organisation token (a parameter of the rule)


def listing(spark, sf_dir):
    """Listing binding L: one file per order, nine naming families."""
    o = B.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    ks = k.cast("string")
    dmy, mdy, ymd = F.date_format(d, "dd-MM-yyyy"), F.date_format(d, "MMddyyyy"), F.date_format(d, "yyyy-MM-dd")
    mode = F.when(k % 2 == 0, F.lit("fast")).otherwise(F.lit("close"))
    tag = F.date_format(F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1)), "MMddyyyy")
    m9 = k % 9
    name = (
        F.when(m9 == 0, F.concat(F.lit("IFT - "), dmy, F.lit(".xlsm")))
        .when(m9 == 1, F.concat(F.lit("IFT - "), dmy, F.lit(" v"), (k % 3).cast("string"), F.lit(".xlsx")))
        .when(m9 == 2, F.concat(F.lit("IFT - draft "), ks, F.lit(".xlsx")))
        .when(m9 == 3, F.concat(F.lit("IFT - 31-02-"), F.date_format(d, "yyyy"), F.lit(".xlsm")))
        .when(m9 == 4, F.concat(F.lit("IR_"), mdy, F.lit("_"), ks, F.lit(".xls")))
        .when(m9 == 5, F.concat(F.lit("xcy_ir_"), mdy, F.lit("_"), ks, F.lit(".XLS")))
        .when(m9 == 6, F.concat(F.when(k % 2 == 0, "sensis_IR_").otherwise("Sensis_IR_"), ks, F.lit(".xlsx")))
        .when(m9 == 7, F.concat(F.when(k % 4 == 3, f"search_{ORG}_").otherwise(f"SEARCH_{ORG.upper()}_"), ymd,
                                F.lit("_"), ks, F.lit(".csv")))
        .otherwise(F.when(k % 2 == 0, F.concat(F.lit("Run "), ks, F.lit(" Report Collatéral.xlsx")))
                   .otherwise(F.concat(F.lit("IFT_"), tag, F.lit("_"), mode, F.when(k % 4 == 0, ".xlsx").otherwise(".xlsm"))))
    )
    return o.select(
        F.concat(F.lit("runs/"), (F.col("o_custkey") % 40).cast("string")).alias("folder"),
        name.alias("file_name"),
        F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate")) + k % 86400).alias("modificationTime"),
        k.alias("o_orderkey"), d.alias("run_date"), mode.alias("mode"), "o_orderstatus",
    )


_L = f"""select concat('runs/', cast(o_custkey % 40 as varchar)) as folder,
 case o_orderkey % 9
  when 0 then concat('IFT - ', strftime(o_orderdate, '%d-%m-%Y'), '.xlsm')
  when 1 then concat('IFT - ', strftime(o_orderdate, '%d-%m-%Y'), ' v', cast(o_orderkey % 3 as varchar), '.xlsx')
  when 2 then concat('IFT - draft ', cast(o_orderkey as varchar), '.xlsx')
  when 3 then concat('IFT - 31-02-', strftime(o_orderdate, '%Y'), '.xlsm')
  when 4 then concat('IR_', strftime(o_orderdate, '%m%d%Y'), '_', cast(o_orderkey as varchar), '.xls')
  when 5 then concat('xcy_ir_', strftime(o_orderdate, '%m%d%Y'), '_', cast(o_orderkey as varchar), '.XLS')
  when 6 then concat(case when o_orderkey % 2 = 0 then 'sensis_IR_' else 'Sensis_IR_' end, cast(o_orderkey as varchar), '.xlsx')
  when 7 then concat(case when o_orderkey % 4 = 3 then 'search_{ORG}_' else 'SEARCH_{ORG.upper()}_' end, strftime(o_orderdate, '%Y-%m-%d'), '_', cast(o_orderkey as varchar), '.csv')
  else case when o_orderkey % 2 = 0 then concat('Run ', cast(o_orderkey as varchar), ' Report Collatéral.xlsx')
   else concat('IFT_', strftime(cast(cast(o_orderdate as date) + (case isodow(cast(o_orderdate as date)) when 5 then 3 when 6 then 2 else 1 end) as date), '%m%d%Y'),
     '_', case when o_orderkey % 2 = 0 then 'fast' else 'close' end, case when o_orderkey % 4 = 0 then '.xlsx' else '.xlsm' end) end end as file_name,
 o_orderdate + to_seconds(o_orderkey % 86400) as modificationTime,
 o_orderkey, cast(o_orderdate as date) as run_date, case when o_orderkey % 2 = 0 then 'fast' else 'close' end as mode, o_orderstatus
from orders"""


@register
def file_select(spark, sf_dir):
    """SRC-4, STR-8: perimeter extracts (``IR_*`` / ``XCY_IR*``, ``.xls``, any case) per folder."""
    return FS.perimeter_files(listing(spark, sf_dir)).select("folder", "file_name").orderBy("folder", "file_name")


ORACLE["file_select"] = f"""with l as ({_L}) select folder, file_name from l
where lower(file_name) like '%.xls' and (starts_with(upper(file_name), 'IR_') or starts_with(upper(file_name), 'XCY_IR'))
order by folder, file_name"""

# Glob patterns of the pattern report (the last matches nothing).
PATTERNS = ["IR_*.xls", "xcy_ir_*.XLS", "XCY_IR_*.zip"]


@register
def pattern_counts(spark, sf_dir):
    """SRC-1, CHK-4: files per glob pattern, zero-match patterns reported."""
    return FS.pattern_counts(listing(spark, sf_dir), PATTERNS)


ORACLE["pattern_counts"] = f"""with l as ({_L}), p as (select * from (values {', '.join(f"({S.q(p)}, {S.q(FS._glob_regex(p))})" for p in PATTERNS)}) v(pattern, re))
select p.pattern, (select count(*) from l where regexp_matches(l.file_name, p.re)) as n_files from p"""


# Wanted sources (folder, pattern): found, no match, missing folder.
SOURCES = [(f"runs/{i}", p) for i in range(0, 45, 5) for p in ("IR_*.xls", "search_*.csv", "*.zip")]


@register
def source_status(spark, sf_dir):
    """CHK-4: found, no match or missing source for each wanted folder and pattern."""
    return FS.source_status(listing(spark, sf_dir), SOURCES)


ORACLE["source_status"] = f"""with l as ({_L}), p as (select * from (values {', '.join(f"({S.q(f)}, {S.q(p)}, {S.q(FS._glob_regex(p))})" for f, p in SOURCES)}) v(folder, pattern, re)),
n as (select folder, pattern, (select count(*) from l where l.folder = p.folder) as here,
 (select count(*) from l where l.folder = p.folder and regexp_matches(l.file_name, p.re)) as n_files from p)
select folder, pattern, n_files, case when here = 0 then 'missing source' when n_files = 0 then 'no match' else 'found' end as status from n"""


def _latest_sql(group: str) -> str:
    return f"""select {group}, file_name as latest from (
 select *, row_number() over (partition by {group} order by dd is not null desc, dd desc nulls last, file_name desc) as rn
 from (select *, case when regexp_matches(file_name, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')
   then try_strptime(regexp_extract(file_name, '([0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})', 1), '%d-%m-%Y') end as dd
  from l where starts_with(file_name, 'IFT - ') and (ends_with(file_name, '.xlsm') or ends_with(file_name, '.xlsx'))) a) b where rn = 1"""


@register
def latest_by_name_date(spark, sf_dir):
    """SRC-14, DATE-6: per folder, the production file with the latest date
    in its name (undated names only when no dated one)."""
    return FS.latest_by_name_date(listing(spark, sf_dir))


ORACLE["latest_by_name_date"] = f"with l as ({_L}) " + _latest_sql("folder")


@register
def previous_run(spark, sf_dir):
    """SRC-15, DATE-7: for every (run date, mode), the previous production:
    same month's fast for a close, previous quarter's close otherwise."""
    lst = listing(spark, sf_dir).withColumns({"year": F.year("run_date"), "month": F.month("run_date")})
    # each eleventh file lies in the bare month folder
    placed = lst.withColumn("mode", F.when(F.col("o_orderkey") % 11 != 0, F.col("mode")))
    winners = FS.latest_by_name_date(placed, ("year", "month", "mode"))
    runs = lst.select("run_date", "mode").distinct()
    return FS.previous_production(runs, winners)


ORACLE["previous_run"] = f"""with l0 as ({_L}), l as (select *, year(run_date) as year, month(run_date) as month from l0),
w as (select *, case when regexp_matches(file_name, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')
   then try_strptime(regexp_extract(file_name, '([0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})', 1), '%d-%m-%Y') end as dd
  from l where starts_with(file_name, 'IFT - ') and (ends_with(file_name, '.xlsm') or ends_with(file_name, '.xlsx'))),
r as (select distinct run_date, mode from l0),
t as (select run_date, mode,
  case when lower(mode) = 'close' then year(run_date) else year(date_trunc('quarter', run_date) - interval 1 month) end as t_year,
  case when lower(mode) = 'close' then month(run_date) else month(date_trunc('quarter', run_date) - interval 1 month) end as t_month,
  case when lower(mode) = 'close' then 'fast' else 'close' end as t_mode from r),
c as (select t.*, w.file_name, row_number() over (partition by t.run_date, t.mode
  order by w.dd is not null desc, w.dd desc nulls last, w.file_name desc nulls last) as rn
 from t left join w on w.year = t.t_year and w.month = t.t_month and (w.mode = t.t_mode or w.o_orderkey % 11 = 0))
select t_year, t_month, t_mode, run_date, mode, file_name as previous from c where rn = 1"""


@register
def current_run(spark, sf_dir):
    """SRC-16 (S14): each (folder, date, mode) run's own file: the exact
    ``IFT_<tag>_<mode>`` name, else the greatest ``IFT*.xls*`` of the folder."""
    lst = listing(spark, sf_dir)
    runs = lst.select("folder", "run_date", "mode").distinct()
    return FS.current_production(runs, lst)


ORACLE["current_run"] = f"""with l as ({_L}),
r as (select distinct folder, run_date, mode from l),
r2 as (select *, concat('IFT_', strftime(cast(run_date + (case isodow(run_date) when 5 then 3 when 6 then 2 else 1 end) as date), '%m%d%Y'), '_', lower(mode)) as base from r),
fb as (select folder, max(file_name) as last from l where regexp_matches(file_name, '^IFT.*\\.xls.*$') group by folder)
select r2.folder, r2.run_date, r2.mode,
 coalesce((select min(file_name) from l where l.folder = r2.folder and l.file_name = concat(r2.base, '.xlsm')),
          (select min(file_name) from l where l.folder = r2.folder and l.file_name = concat(r2.base, '.xlsx')), fb.last) as current
from r2 left join fb using (folder)"""


@register
def first_by_name(spark, sf_dir):
    """SRC-13: first feed file per folder and date (exact case preferred)
    and the first sensitivity file per folder."""
    lst = listing(spark, sf_dir)
    feed = FS.first_by_prefix(lst, ORG)
    sens = FS.first_sensitivity_file(lst)
    return feed.join(sens, "folder", "left")


ORACLE["first_by_name"] = f"""with l as ({_L}),
f as (select *, regexp_extract(file_name, '(?i)^search_{ORG}_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) as feed_date from l where ends_with(lower(file_name), '.csv')),
g as (select folder, feed_date, first(file_name order by not starts_with(file_name, concat('search_{ORG}_', feed_date)), file_name) as feed_file,
  bool_or(starts_with(file_name, concat('search_{ORG}_', feed_date))) as exact_case from f where feed_date <> '' group by 1, 2),
s as (select folder, min(file_name) as sensis_file from l where regexp_matches(file_name, {S.q(FS.SENSITIVITY_PATTERN)}) group by 1)
select g.*, s.sensis_file from g left join s using (folder)"""


@register
def latest_by_mtime(spark, sf_dir):
    """SRC-12: per folder, the collateral report modified last."""
    return FS.latest_by_mtime(listing(spark, sf_dir))


ORACLE["latest_by_mtime"] = f"""with l as ({_L})
select folder, first(file_name order by modificationTime desc, file_name desc) as latest
from l where ends_with(file_name, 'Report Collatéral.xlsx') group by folder"""


def _members(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    base = F.concat(F.lit("IR_"), F.date_format(F.col("o_orderdate"), "MMyyyy"), F.lit(".xls"))
    return o.select(F.concat(F.lit("dest/"), (F.col("o_custkey") % 40).cast("string")).alias("dest"),
                    base.alias("basename"), F.col("o_orderkey").alias("ord"), "o_orderstatus")


@register
def collision_names(spark, sf_dir):
    """SRC-3: unique names for members flattened into one folder (``_1``,
    ``_2`` ... after the files already there)."""
    m = _members(spark, sf_dir)
    existing = m.where(F.col("o_orderstatus") == "F").select("dest", F.col("basename").alias("file_name"))
    new = m.where(F.col("o_orderstatus") != "F").select("dest", "basename", "ord")
    return FS.collision_names(new, existing).select("dest", "basename", "ord", "target_name", "collides")


ORACLE["collision_names"] = """with m as (select concat('dest/', cast(o_custkey % 40 as varchar)) as dest,
  concat('IR_', strftime(o_orderdate, '%m%Y'), '.xls') as basename, o_orderkey as ord, o_orderstatus from orders),
ex as (select distinct dest, basename from m where o_orderstatus = 'F'),
n as (select m.dest, m.basename, m.ord, (row_number() over (partition by m.dest, m.basename order by m.ord) - 1)
  + case when ex.basename is not null then 1 else 0 end as j from m left join ex on ex.dest = m.dest and ex.basename = m.basename
  where m.o_orderstatus <> 'F'),
t as (select dest, basename, ord, case when j = 0 then basename
  else concat(regexp_extract(basename, '^(.*?)(\\.[^.]*)?$', 1), '_', cast(j as varchar), regexp_extract(basename, '^(.*?)(\\.[^.]*)?$', 2)) end as target_name from n)
select t.*, t.target_name <> t.basename as collides from t"""


# ------------------------------------------------------------------ set operations and code lists
@register
def union_by_name(spark, sf_dir):
    """SET-1, MAP-13: report rows of two extracts with different column sets
    unioned by name; absent columns are null; only existing columns kept."""
    t = B.trades(spark, sf_dir)
    a = t.where(F.col("l_linestatus") == "O").select(F.col("trade_id").alias("#Ticket"), "code_raw", "classif", "cpty")
    b = t.where(F.col("l_linestatus") != "O").select("code_raw", F.col("classif").alias("classif"),
                                                     F.col("end_date").alias("end_date"), F.col("trade_id").alias("External Id"))
    u = a.unionByName(b, allowMissingColumns=True)
    keep = [c for c in ("#Ticket", "Trade ID", "External Id", "code_raw", "classif", "cpty", "Currency", "end_date") if c in u.columns]
    return u.select(*keep)


ORACLE["union_by_name"] = f"""with t as ({BS.T})
select "#Ticket", "External Id", code_raw, classif, cpty, end_date from (
 select trade_id as "#Ticket", code_raw, classif, cpty from t where l_linestatus = 'O'
 union all by name
 select code_raw, classif, end_date, trade_id as "External Id" from t where l_linestatus <> 'O') u"""


@register
def code_list_text(spark, sf_dir):
    """AGG-13: per class, the first ten codes missing a mark (report order)
    as one text, with an ellipsis when there are more."""
    from ..operators.enrich import aggregate_marks, missing_codes

    t = B.trades(spark, sf_dir).where(valid_code("code_raw")).withColumn("code", code_text("code_raw"))
    miss = missing_codes(t.select("classif", "code", "ord"), aggregate_marks(B.marks_feed(spark, sf_dir)))
    from ..operators.placement import top_k_per_group

    top = top_k_per_group(miss, ["classif"], "ord", 10)
    lines = top.groupBy("classif").agg(
        F.array_sort(F.collect_list(F.struct("rank", "code"))).alias("_l"), F.max("n_group").alias("n_missing")
    )
    first10 = F.transform("_l", lambda x: x["code"])
    text = F.concat(F.array_join(first10, ", "), F.when(F.col("n_missing") > 10, F.lit(" …")).otherwise(F.lit("")))
    return lines.select("classif", "n_missing", text.alias("preview"))


ORACLE["code_list_text"] = f"""with t as ({BS.T}), m as ({BS.M}), mk as ({BS.MK}),
r as (select classif, {S.code_text('code_raw')} as code, {BS.ORD} from t where {S.valid_code('code_raw')}),
x as (select * from r where code not in (select code from mk)),
y as (select classif, code, row_number() over (partition by classif order by {BS.ORD}) as rn, count(*) over (partition by classif) as n from x)
select classif, max(n) as n_missing, concat(string_agg(code, ', ' order by rn) filter (where rn <= 10), case when max(n) > 10 then ' …' else '' end) as preview
from y group by classif"""
