"""Queries over sheets in row form: positional layouts, several sheets per
file, run date from the report, stop at the first blank row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parse_date_strict, parse_number
from ..operators import dims, enrich, forwards, period, reconcile
from ..operators import sheets as SH
from ..operators.placement import numbered_as_read, with_read_position
from ..session import ensure_checkpoint_dir
from ..sources import bindings
from ..sources import productions as P
from ..sources import sheets as B
from ..sources.feeds import NA_TOKENS
from . import bindings_sql as BS
from . import sqltext as S
from .catalog import register
from .oracle import _THR, ORACLE

MAIN = SH.REPORT_SHEETS[0][0]


def _stored(spark, rows):
    """The workbooks as a stored table, read back through the reader."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-io/sheets-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def _report(spark, sf_dir):
    return B.read_sheet_rows(spark, _stored(spark, B.report_sheets(spark, sf_dir)))


def _sensitivities(spark, sf_dir):
    path = _stored(spark, B.sensitivity_sheets(spark, sf_dir))
    return SH.blank_tokens(B.read_sheet_rows(spark, path, first_sheet=True), NA_TOKENS)


def _code_headers(rows):
    return SH.code_columns(rows, SH.label_rows(rows, SH.CODE_LABELS, default=3))


def _sensi_records(rows):
    """Last entry per file and code, cells read as numbers."""
    b = SH.body(rows, _code_headers(rows)).where(F.col("code").isNotNull())
    rec = b.select("source_file", "code", "row_idx",
                   *[parse_number(SH.cell(x)).alias(n) for n, x in SH.SENSI_POSITIONS.items()])
    return enrich.last_wins(rec, ["source_file", "code"], "row_idx")


# ------------------------------------------------------------------ headers
@register
def sheet_headers(spark, sf_dir):
    """GRD-5, GRD-15, GRD-16, CHK-1, SRC-5: header row and code column of each
    sheet of the reports and the extracts; a sheet without a code column is
    reported as missing."""
    h = _code_headers(_report(spark, sf_dir)).unionByName(_code_headers(_sensitivities(spark, sf_dir)))
    return h.withColumn("missing_code", F.col("code_col").isNull())


ORACLE["sheet_headers"] = f"""with names as (
 select concat('REPORT_', f, '.xlsm') as source_file, '{MAIN}' as sheet, f from range(3) r(f)
 union all select concat('REPORT_', f, '.xlsm'), 'BND FWD', f + 10 from range(3) r(f)
 union all select concat('SENSI_', f, '.xls'), 'Sheet1', f + 20 from range(3) r(f))
select source_file, sheet, cast(case f when 0 then 5 when 1 then 7 when 20 then 2 when 21 then 5 else 3 end as integer) as header_row,
 cast(case f when 0 then 2 when 1 then 3 when 2 then 0 when 20 then 4 when 21 then 0 when 22 then 2 end as integer) as code_col,
 f between 10 and 19 as missing_code from names
where f <> 12 or exists (select 1 from customer where c_custkey % 3 = 2)"""


# ------------------------------------------------------------------ sensitivities
@register
def sensitivity_sheet(spark, sf_dir):
    """DIM-5, GRD-5, GRD-16, GRD-20, SRC-7, AGG-11: sensitivity extracts read by
    position under the found header; NA tokens are blank, columns beyond a
    narrow sheet are null, the last row of a code wins."""
    return _sensi_records(_sensitivities(spark, sf_dir))


_SENSI_SQL = """parts as (select *, cast(p_retailprice as decimal(12,2)) as price from part, range(2) k(kk)),
sr as (select concat('SENSI_', p_partkey % 3, '.xls') as source_file,
 concat(case when p_partkey % 10 = 3 then 'UNUSED_' else 'SWAP_' end, p_partkey) as code,
 cast(case p_partkey % 3 when 0 then 3 when 1 then 6 else 4 end + p_partkey // 3 * 2 + kk as integer) as row_idx,
 cast(p_size as double) as duration_leg1,
 case when p_size % 5 <> 0 then cast(price + kk as double) end as sensi_leg1,
 case when p_partkey % 4 <> 0 then cast(p_size + kk as double) end as duration_leg2,
 case when p_size % 3 <> 0 then cast(-price as double) end as sensi_leg2,
 case when p_partkey % 3 <> 1 then cast(p_size * 2 as double) end as duration_total,
 case when p_size % 4 = 0 then cast(price as double) end as sensi_total
 from parts where not (kk = 1 and p_partkey % 9 in (0, 4))),
sensi as (select * from sr where not exists (select 1 from sr s2 where s2.source_file = sr.source_file and s2.code = sr.code and s2.row_idx > sr.row_idx))"""

ORACLE["sensitivity_sheet"] = f"with {_SENSI_SQL} select * from sensi"


@register
def report_sheet_sensitivities(spark, sf_dir):
    """JN-1, NUM-8, GRD-19, CTL-3, CTL-4, CTL-5, JN-9, DIM-5, DATE-3: rows of the
    main report sheet up to its first blank code, with the sensitivities
    written over the former cells where the code is known, the run date from
    B3, the tolerance and the alert on the report's own gap."""
    rows = _report(spark, sf_dir).where(F.col("sheet") == MAIN)
    kept = SH.until_first_blank(SH.body(rows, _code_headers(rows)))
    report = kept.select(
        "source_file", "row_idx", "code",
        SH.cell(SH.REPORT_POSITIONS["classif"]).alias("classif"),
        SH.cell(SH.REPORT_POSITIONS["index_rate"]).alias("index_rate"),
        parse_number(SH.cell(SH.REPORT_POSITIONS["notional"])).alias("notional"),
        parse_number(SH.cell(SH.REPORT_POSITIONS["gap"])).alias("gap"),
        parse_date_strict(SH.cell(SH.REPORT_POSITIONS["end_date"])).alias("end_date"),
        *[parse_number(SH.cell(x)).alias(n) for n, x in SH.REPORT_SENSI_POSITIONS.items()],
    )
    sensi = enrich.last_wins(_sensi_records(_sensitivities(spark, sf_dir)).withColumn(
        "ord", F.struct("source_file", "row_idx")), ["code"], "ord").drop("source_file", "row_idx", "ord")
    j = enrich.enrich_sensitivities(report, sensi).join(enrich.run_date_of(SH.run_date_cells(rows)), "source_file")
    a = enrich.tolerance_alerts(j, dims.thresholds(spark), F.col("run_date"), gap_col="gap")
    known = F.col("sensi_matched")
    return a.select(
        "source_file", "row_idx", "code", "notional", "gap", "sensi_matched", "run_date", *enrich.SENSI_COLUMNS,
        *[F.when(known, F.col(c)).alias(c) for c in ("maturity_years", "threshold", "alert")],
    )


ORACLE["report_sheet_sensitivities"] = f"""with {_SENSI_SQL}, th as ({_THR}),
ol as (select *, o_orderkey as k, o_orderkey % 3 as f from orders),
cl as (select *, case o_custkey % 4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end as cls0,
 case k % 7 % 3 when 0 then 'HICPXT' when 1 then 'FRCPIXT' else 'OTHER' end as ik, concat('SWAP_', o_custkey) as code,
 case when f < 2 then date '1995-06-30' end as run_date from ol),
r as (select *, case when k % 8 = 0 then replace(cls0, ' ', '  ') else cls0 end as classif,
 {S.year_fraction('run_date', 'cast(o_orderdate as date)')} as my from cl)
select concat('REPORT_', f, '.xlsm') as source_file,
 cast(case f when 0 then 6 when 1 then 8 else 4 end + k // 3 as integer) as row_idx, r.code,
 cast(cast(o_totalprice as decimal(12,2)) as double) as notional, -(cast(k % 1000 as double) / 1000) as gap,
 s.code is not null as sensi_matched, run_date,
 case when s.code is null then 7.0 else s.duration_leg1 end as duration_leg1,
 case when s.code is null then case when k % 2 = 0 then 8.5 end else s.sensi_leg1 end as sensi_leg1,
 s.duration_leg2, s.sensi_leg2, s.duration_total,
 coalesce(s.sensi_total, case when s.sensi_leg1 is not null or s.sensi_leg2 is not null
  then coalesce(s.sensi_leg1, 0) + coalesce(s.sensi_leg2, 0) end) as sensi_total,
 case when s.code is not null then my end as maturity_years, case when s.code is not null then t.threshold end as threshold,
 case when s.code is not null and t.threshold is not null and cast(k % 1000 as double) / 1000 > t.threshold then 'alerte' end as alert
from r left join sensi s on s.code = r.code left join th t on lower(r.classif) = t.t_classif and (t.t_index is null or t.t_index = r.ik)
 and my is not null and (t.t_lo is null or my >= t.t_lo) and (t.t_hi is null or my < t.t_hi)"""


# ------------------------------------------------------------------ marks
@register
def report_sheet_marks(spark, sf_dir):
    """JN-3, CTL-1, CTL-2, CTL-3, SNK-6, GRD-19, DIM-5: the main report sheet with
    the nine mark and gap cells written back at their positions, up to the
    first blank code; rows without a mark and rows beyond keep their cells."""
    rows = _report(spark, sf_dir).where(F.col("sheet") == MAIN)
    marks = enrich.aggregate_marks(bindings.marks_feed(spark, sf_dir))
    w = SH.write_marks(rows, _code_headers(rows), marks, parse_number)
    return w.select(
        "source_file", "row_idx", "inside", "code", "matched", F.size("values").alias("width"),
        *[parse_number(SH.cell(x)).alias(n) for n, x in SH.REPORT_MARK_POSITIONS.items()],
        *[SH.cell(x).alias(f"cell_{x.lower()}") for x in ("B", "AN", "AO", "BL")],
    )


def _report_sheet_marks_sql() -> str:
    gap = S.sub_opt("an", "mark")
    new = {
        "mtm_cpty": "mark", "mtm_cpty_pct": S.div_opt("mark", "m"), "mtm_gap": gap, "mtm_gap_pct": S.div_opt(gap, "m"),
        "mtm_gap_ctl": gap, "cmp_bs": S.sub_opt("an", "bd"), "cmp_bt": S.sub_opt("ao", "be"),
        "cmp_ca": S.sub_opt("mark", "bd"), "cmp_cb": S.sub_opt("ax", "be"),
    }
    old = {"mtm_cpty": "aw0", "mtm_gap_ctl": "bk0"}
    written = ", ".join(f"case when matched then {v} else {old.get(n, 'null')} end as {n}" for n, v in new.items())
    empty = ", ".join(f"{'1.0' if n == 'mtm_cpty' else 'cast(null as double)'} as {n}" for n in new)
    blank = ", ".join(f"cast(null as double) as {n}" for n in new)
    return BS.with_(m=BS.M, mk=BS.MK) + f""", r as (select o_orderkey as k, o_orderkey % 3 as f, concat('SWAP_', o_custkey) as code,
 cast(o_totalprice as decimal(12,2)) as total, case o_custkey % 4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end as cls from orders),
x as (select *, case when k % 41 = 0 then 'N/A' when k % 43 <> 0 then replace(cast(total as varchar), '.', ',') end as cell_an,
 case when k % 47 <> 0 then concat('0,', lpad(cast(k % 100 as varchar), 2, '0')) end as cell_ao from r),
j as (select x.*, mk.mtm_cpty as mark, mk.code is not null as matched, cast(total as double) as m,
 case when k % 41 <> 0 and k % 43 <> 0 then cast(total as double) end as an, {S.parse_eu('cell_ao')} as ao,
 case when k % 41 <> 0 then cast(total as double) end as aw0, case when k % 2 = 0 then 5.0 end as bk0
 from x left join mk on mk.code = x.code),
w as (select *, {gap} as bd, {S.div_opt(gap, 'm')} as be, {S.div_opt('mark', 'm')} as ax from j)
select concat('REPORT_', f, '.xlsm') as source_file, cast(case f when 0 then 6 when 1 then 8 else 4 end + k // 3 as integer) as row_idx,
 true as inside, code, matched, {B.REPORT_WIDTH} as width, {written},
 case when k % 8 = 0 then replace(cls, ' ', '  ') else cls end as cell_b, cell_an, cell_ao, concat('-0.', lpad(cast(k % 1000 as varchar), 3, '0')) as cell_bl from w
union all select concat('REPORT_', f, '.xlsm'), cast(n_nationkey + {B.FOOTER_START} as integer), false, null, false, {B.REPORT_WIDTH}, {empty},
 'CMS Swap', '1', null, null from nation, range(3) t(f)
union all select concat('REPORT_', f, '.xlsm'), r, false, null, false, {B.REPORT_WIDTH}, {blank}, b, null, null, null
 from (values (0, 2, '30/06/1995'), (1, 2, '34880'), (2, 2, null), (0, 5, 'Classif DI'), (1, 7, ' classif  di'), (2, 3, 'Class')) h(f, r, b)"""


ORACLE["report_sheet_marks"] = _report_sheet_marks_sql()


@register
def forward_sheet(spark, sf_dir):
    """CTL-6, CHK-3, SRT-5, SNK-6, DIM-5: the bond-forward sheet: accepted forwards
    of the stored feed in feed order, from the second row, in columns A..K,
    rejected ones leaving no gap."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-io/feed-{uuid.uuid4().hex}"
    feed = bindings.marks_feed(spark, sf_dir)
    feed.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    stored = with_read_position(spark.read.schema(feed.schema).parquet(path))
    accepted = forwards.forward_alerts(forwards.forward_quality(forwards.select_forwards(stored)))
    sheet = SH.forward_sheet(numbered_as_read(accepted, "place", start=0), "place", "REPORT.xlsm")
    numeric = "DEFGHIJ"
    return sheet.select(
        "source_file", "sheet", "row_idx", F.size("values").alias("width"),
        *[(parse_number(SH.cell(x)) if x in numeric else SH.cell(x)).alias(x.lower()) for x in SH.FORWARD_POSITIONS.values()],
    )


# the forward rules are those of forward_alerts; only place and cells are new
ORACLE["forward_sheet"] = f"""with a as ({ORACLE['forward_alerts']})
select 'REPORT.xlsm' as source_file, 'BND FWD' as sheet, cast(row_number() over (order by o_orderkey) as integer) as row_idx, {SH.FORWARD_WIDTH} as width,
 nullif(free_text, '') as a, book as b, cp as c, notional as d, mtm_own as e, cpty_price as f, mtm_pct as g, cpty_pct as h,
 threshold as i, gap_pct as j, alert as k from a"""


# ------------------------------------------------------------------ totals
def _exact(c):
    """Cell text as an exact amount, so that sums do not depend on row order."""
    return reconcile.text_amount(c).cast("decimal(28,6)")


@register
def report_sheet_totals(spark, sf_dir):
    """AGG-2, SET-4, FLT-5, FLT-6, DIM-5, GRD-6, GRD-20, NUM-2: own and
    counterparty amounts by class and counterparty over both report sheets,
    each read by its own columns under its own header."""
    rows = _report(spark, sf_dir)
    out = reconcile.mtm_by_class_cpty(*SH.report_amounts(rows, _exact))
    return out.withColumns({c: F.col(c).cast("double") for c in ("mtm_own", "mtm_cpty")})


ORACLE["report_sheet_totals"] = """with a as (
 select case o_custkey % 4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end as classif,
  concat('Supplier#', o_orderkey % 50) as counterparty,
  case when o_orderkey % 43 <> 0 then cast(o_totalprice as decimal(12,2)) end as own, cast(o_totalprice as decimal(12,2)) as cp
 from orders where o_orderkey % 31 <> 0 and o_orderkey % 37 <> 0 and o_orderkey % 41 <> 0
 union all select 'Forward', concat('CP', c_custkey % 9), cast(c_acctbal as decimal(12,2)),
  case when c_custkey % 13 <> 0 then cast(c_acctbal as decimal(12,2)) end from customer where c_custkey % 29 <> 0)
select classif, counterparty, cast(coalesce(sum(own), 0) as double) as mtm_own, cast(coalesce(sum(cp), 0) as double) as mtm_cpty
from a group by 1, 2"""


# ------------------------------------------------------------------ productions
def _chosen(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-io/productions-{uuid.uuid4().hex}"
    P.write_productions(P.production_rows(spark, sf_dir), path)
    runs = spark.createDataFrame([(bindings.RUN_DATE, "Fast")], "run_date string, mode string")
    return path, P.chosen_productions(P.list_productions(spark, path), runs.withColumn("run_date", F.col("run_date").cast("date")))


@register
def production_totals(spark, sf_dir):
    """AGG-4, AGG-5, FLT-7, GRD-7, SRC-1, SRC-14, SRC-15, SRC-16, DATE-7: dirty value
    by class of the current production of a run and of the one it compares
    with, bond forwards under their price header included; the listing picks
    the two files and only they are read."""
    path, chosen = _chosen(spark, sf_dir)
    rows = P.read_productions(spark, path, chosen)
    swaps, prices = SH.production_amounts(rows, _exact, P.MAIN, P.FORWARD, P.HEADER_ROW, ("production", "file"))
    out = period.dirty_by_class(swaps, prices, ("production", "file"))
    return out.withColumn("total", F.col("total").cast("double"))


ORACLE["production_totals"] = """with p as (select *, o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m,
 case when o_orderkey % 2 = 0 then 'fast' else 'close' end as mode, cast(o_totalprice as decimal(12,2)) as total,
 concat(case when o_orderkey % 10 >= 8 then 'IFT - 02-' else 'IFT - 15-' end, strftime(o_orderdate, '%m-%Y'), case when o_orderkey % 10 >= 8 then '.xlsx' else '.xlsm' end) as file from orders),
c as (select 'current' as production, max(file) as file from p where y = 1995 and m = 6 and mode = 'fast'
 union all select 'previous', max(file) from p where y = 1995 and m = 3 and mode = 'close'),
r as (select p.*, c.production from p join c on c.file = p.file and p.mode = case c.production when 'current' then 'fast' else 'close' end),
a as (select production, file, case o_custkey % 4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end as classif, total
 from r where k % 9 not in (1, 2) and k % 41 <> 0 and k % 43 <> 0
 union all select production, file, 'Bond Forward', total from r where k % 5 < 2 and k % 7 <> 0)
select production, file, classif, cast(sum(total) as double) as total from a group by all"""
