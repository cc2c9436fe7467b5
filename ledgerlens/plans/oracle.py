"""DuckDB oracle SQL for the registered queries (same names, same columns)."""

from __future__ import annotations

from . import bindings_sql as B
from . import sqltext as S
from ..operators import dims

ORACLE: dict[str, str] = {}

_THR = "select * from (values " + ",".join(
    "(" + ",".join("null" if v is None else (S.q(v) if isinstance(v, str) else repr(float(v))) for v in row) + ")"
    for row in dims.THRESHOLDS
) + ") v(t_classif, t_index, t_lo, t_hi, threshold)"

ORACLE["valid_code_filter"] = B.with_(t=B.T) + f"""
select trade_id, code_raw, {S.code_text('code_raw')} as code from t where {S.valid_code('code_raw')}"""

ORACLE["legacy_blank_filter"] = B.with_(t=B.T) + f"""
select trade_id, code_raw from t where code_raw is not null and {S.strip('code_raw')} <> ''"""

ORACLE["marks_by_code"] = B.with_(m=B.M, mk=B.MK) + "select * from mk order by code"

_ENRICH = f"""select r.*, k.mtm_cpty as mark, k.code is not null as matched from r left join mk k on r.code = k.code"""

_GAPS = f"""select trade_id, code, notional, dirty_total, dirty_pct, matched,
 case when matched then mark end as mtm_cpty,
 case when matched then {S.div_opt('mark', 'notional')} end as mtm_cpty_pct,
 case when matched then {S.sub_opt('dirty_total', 'mark')} end as mtm_gap,
 case when matched then {S.div_opt(S.sub_opt('dirty_total', 'mark'), 'notional')} end as mtm_gap_pct,
 case when matched then {S.sub_opt('dirty_total', 'mark')} end as mtm_gap_ctl,
 case when matched then {S.sub_opt('dirty_total', S.sub_opt('dirty_total', 'mark'))} end as cmp_bs,
 case when matched then {S.sub_opt('dirty_pct', S.div_opt(S.sub_opt('dirty_total', 'mark'), 'notional'))} end as cmp_bt,
 case when matched then {S.sub_opt('mark', S.sub_opt('dirty_total', 'mark'))} end as cmp_ca,
 case when matched then {S.sub_opt(S.div_opt('mark', 'notional'), S.div_opt(S.sub_opt('dirty_total', 'mark'), 'notional'))} end as cmp_cb,
 classif, index_rate, end_date
from e"""

_MARK_CTES = dict(t=B.T, r=B.R, m=B.M, mk=B.MK, e=_ENRICH, g=_GAPS)

ORACLE["marks_enrich_gap"] = B.with_(**_MARK_CTES) + """
select trade_id, code, notional, dirty_total, dirty_pct, matched, mtm_cpty, mtm_cpty_pct, mtm_gap, mtm_gap_pct,
 mtm_gap_ctl, cmp_bs, cmp_bt, cmp_ca, cmp_cb from g"""

ORACLE["codes_missing_marks"] = B.with_(t=B.T, r=B.R, m=B.M, mk=B.MK) + """
select trade_id, code from r where not exists (select 1 from mk where mk.code = r.code)"""

ORACLE["codes_unused_marks"] = B.with_(t=B.T, r=B.R, m=B.M, mk=B.MK) + """
select distinct code from mk where code not in (select code from r) order by code"""

ORACLE["maturity_years"] = B.with_(t=B.T) + f"""
select trade_id, end_date, {S.year_fraction(B.RUN, 'end_date')} as maturity_years from t"""

_MAT = f"""select *, {S.year_fraction(B.RUN, "end_date")} as maturity_years,
 lower({S.strip('classif')}) as ck, upper({S.strip('index_rate')}) as ik from """ + "{src}"

_THRESH = """select x.*, th.threshold from x left join th on x.ck = th.t_classif
 and (th.t_index is null or x.ik = th.t_index) and x.maturity_years is not null
 and (th.t_lo is null or x.maturity_years >= th.t_lo) and (th.t_hi is null or x.maturity_years < th.t_hi)"""

ORACLE["threshold_lookup"] = B.with_(t=B.T, r=B.R, th=_THR, x=_MAT.replace("{src}", "r"), y=_THRESH) + """
select trade_id, classif, index_rate, maturity_years, threshold from y"""

_ALERTS = B.with_(**_MARK_CTES, th=_THR, x=_MAT.replace("{src}", "g"), y=_THRESH) + """,
a as (select *, case when threshold is not null and mtm_gap_pct is not null and abs(mtm_gap_pct) > threshold
 then 'alerte' end as alert from y)
"""

ORACLE["tolerance_alerts"] = _ALERTS + """
select trade_id, code, classif, maturity_years, threshold, mtm_gap_pct as gap, alert from a"""

ORACLE["alerts_by_class"] = _ALERTS + """
select classif, count(*) as n_trades, count(*) filter (where matched) as n_matched,
 count(*) filter (where alert is not null) as n_alerts, max(abs(mtm_gap_pct)) as max_abs_gap_pct
from a group by classif"""

ORACLE["run_counters"] = _ALERTS + """
select count(*) filter (where matched) as n_updated, count(*) filter (where not matched) as n_missing,
 count(*) filter (where alert is not null) as n_alerts from a"""

_SL = "select * from (select *, row_number() over (partition by code order by src_row desc) as rn from s) z where rn = 1"

ORACLE["last_wins_by_code"] = B.with_(s=B.SENS, sl=_SL) + """
select code, src_row, sensi_leg1, sensi_leg2, sensi_total, duration_leg1 from sl"""

_SENS_ENRICH = B.with_(t=B.T, r=B.R, s=B.SENS, sl=_SL) + """,
se as (select r.trade_id, r.code, r.classif, sl.code is not null as sensi_matched,
 sl.duration_leg1, sl.sensi_leg1, cast(null as double) as duration_leg2, sl.sensi_leg2,
 cast(null as double) as duration_total,
 coalesce(sl.sensi_total, case when sl.sensi_leg1 is not null or sl.sensi_leg2 is not null
   then coalesce(sl.sensi_leg1, 0) + coalesce(sl.sensi_leg2, 0) end) as sensi_total
 from r left join sl on r.code = sl.code)
"""

ORACLE["sensitivity_enrich"] = _SENS_ENRICH + """
select trade_id, code, sensi_matched, duration_leg1, sensi_leg1, duration_leg2, sensi_leg2, duration_total, sensi_total from se"""

ORACLE["codes_missing_sensitivity"] = B.with_(t=B.T, r=B.R, s=B.SENS) + """
select trade_id, code from r where code not in (select code from s)"""

_OVR = "select * from (values " + ",".join(
    f"({S.q(line.split(chr(9))[0].strip())}, {float(line.split(chr(9))[1].replace(',', '.'))!r})"
    for line in dims.OVERRIDE_TSV.splitlines()[1:] if line.strip()
) + ") v(code, value)"

ORACLE["override_duration"] = _SENS_ENRICH + f""",
o as ({_OVR})
select se.trade_id, se.code, se.classif,
 case when {S.strip('se.classif')} = {S.q(dims.OVERRIDE_CLASS)} and o.code is not null then o.value else se.duration_leg1 end as duration_leg1,
 ({S.strip('se.classif')} = {S.q(dims.OVERRIDE_CLASS)} and o.code is not null) as overridden
from se left join o on se.code = o.code"""

_BOOK = f"""case when {S.parse_eu('book')} is not null then
  case when {S.parse_eu('book')} = floor({S.parse_eu('book')}) then cast(cast({S.parse_eu('book')} as decimal(38,0)) as varchar)
       else cast({S.parse_eu('book')} as varchar) end
 when {S.strip('book')} = '' or lower({S.strip('book')}) = 'nan' then null else {S.strip('book')} end"""

_FWD = B.with_(m=B.M) + f""",
f0 as (select o_orderkey, {S.strip("replace(coalesce(" + S.strip('free_text_1') + ", ''), chr(160), ' ')")} as free_text,
 {_BOOK} as book_norm, coalesce({S.strip('cp')}, '') as cp_clean,
 cast(notional as double) as n, cast(mtm_value as double) as v, cast(mtm_diff as double) as d from m),
f as (select * from f0 where starts_with(upper(free_text), 'BDFWD') and book_norm in ('601','602','603')),
fq as (select *, (case when free_text = '' then 1 else 0 end) + (case when cp_clean = '' then 1 else 0 end) as n_warn,
   (case when n is null or n = 0 then 1 else 0 end) + (case when v is null then 1 else 0 end) + (case when d is null then 1 else 0 end) as n_rej,
   concat_ws(', ', case when free_text = '' then 'FREE_TEXT_1' end, case when cp_clean = '' then 'CP' end,
   case when n is null or n = 0 then 'NOTIONAL' end, case when v is null then 'MTM_VALUE' end,
   case when d is null then 'MTM_DIFF' end) as missing from f),
fs as (select *, case when n_rej > 0 then 'rejected' when n_warn > 0 then 'warning' else 'ok' end as status,
  case when free_text <> '' then free_text end as label from fq)
"""

ORACLE["forward_filter"] = _FWD + """
select o_orderkey, free_text, book_norm as book, cp_clean as cp, n as notional, v as mtm_value, d as mtm_diff from f"""

ORACLE["forward_quality"] = _FWD + """
select o_orderkey, label, missing, status,
 case when n_rej + n_warn > 0 then concat(label, ' → données manquantes: ', missing) end as message from fs"""

_FWD_ALERTS = _FWD + f""",
fa as (select o_orderkey, free_text, book_norm as book, nullif(cp_clean, '') as cp, n as notional, v as mtm_own,
 {S.sub_opt('v', 'd')} as cpty_price, {S.div_opt('v', 'n')} as mtm_pct, {S.div_opt(S.sub_opt('v', 'd'), 'n')} as cpty_pct,
 0.005 as threshold, {S.div_opt('v', 'n')} - {S.div_opt(S.sub_opt('v', 'd'), 'n')} as gap_pct
 from fs where status <> 'rejected')
"""

ORACLE["forward_alerts"] = _FWD_ALERTS + """
select *, case when gap_pct is not null and abs(gap_pct) > 0.005 then 'alerte' end as alert from fa"""

ORACLE["report_row_placement"] = _FWD_ALERTS + """
select o_orderkey, free_text, case when gap_pct is not null and abs(gap_pct) > 0.005 then 'alerte' end as alert,
 row_number() over (order by o_orderkey) + 1 as sheet_row from fa"""

ORACLE["perimeter_dedup_first"] = B.with_(t=B.T) + f""",
p as (select trade_id, {S.code_text('code_raw')} as code_di, classif as classif_di, classif as class, cpty as counterparty,
 row_number() over (partition by trade_id order by {B.ORD}) as rn from t where {S.valid_code('code_raw')})
select trade_id, code_di, classif_di, class, counterparty from p where rn = 1"""

ORACLE["perimeter_dedup_stats"] = B.with_(t=B.T) + f"""
select 'Trade ID' as dedup_keys, count(*) as dedup_before, count(distinct trade_id) as dedup_after
from t where {S.valid_code('code_raw')}"""

# ------------------------------------------------------------------ reconciliation
_FWD_DEC = _FWD.replace(" cast(notional as double) as n,", " o_orderstatus, mtm_value as mv, mtm_diff as md, cast(notional as double) as n,")

_TPL = _FWD_DEC + f""",
t as ({B.T}),
mkd as (select code, sum(coalesce(mtm_value - mtm_diff, 0)) as mark
  from (select {S.code_prefix('free_text_2')} as code, mtm_value, mtm_diff from m) x where code <> '' group by code),
sw as (select t.classif, t.cpty, t.mtm_own as gam, mkd.mark as cp from t left join mkd on {S.code_text('t.code_raw')} = mkd.code
  where {S.valid_code('t.code_raw')}),
fw as (select 'Forward' as classif, nullif(cp_clean, '') as cpty, mv as gam, {S.sub_opt('mv', 'md')} as cp from fs where status <> 'rejected'),
sh0 as (select {S.clean_label('classif')} as classif, {S.clean_label('cpty')} as counterparty, gam, cp from sw
  union all select {S.clean_label('classif')}, {S.clean_label('cpty')}, gam, cp from fw),
sh as (select * from sh0 where classif is not null and counterparty is not null
  and lower(counterparty) not in ('counterparty', 'contrepartie', 'cp', 'total') and (gam is not null or cp is not null)),
tpl as (select classif, counterparty, coalesce(sum(gam), 0) as mtm_own, coalesce(sum(cp), 0) as mtm_cpty from sh group by classif, counterparty),
a as ({B.A}), y as ({B.Y}), c as ({B.C}),
col as (select {S.clean_label('cpty')} as counterparty, {S.clean_label('typology')} as typology, mtm_own as mtm_own, mtm_cpty,
  cpty as o1, typology as o2 from c),
col2 as (select * from col where counterparty is not null and typology is not null)
"""

ORACLE["mtm_by_class_cpty"] = _TPL + """
select classif, counterparty, cast(mtm_own as double) as mtm_own, cast(mtm_cpty as double) as mtm_cpty from tpl order by classif, counterparty"""

def _norm(src: str, label: str, alias: str, out: str) -> str:
    return (f"coalesce((select {alias}.canonical from {alias} where {alias}.alias_key = lower({S.clean_label(src + '.' + label)})), "
            f"upper({S.clean_label(src + '.' + label)})) as {out}")

ORACLE["alias_normalise"] = B.with_(c=B.C, a=B.A, y=B.Y) + f"""
select c.cpty as counterparty, c.typology, {_norm('c', 'cpty', 'a', 'norm_counterparty')}, {_norm('c', 'typology', 'y', 'norm_typology')} from c"""

_ALIAS_LINES = f"""select s_suppkey*2 as line_no,
 case s_suppkey%4 when 0 then concat('sup', cast(s_suppkey as varchar), ' = SUPPLIER#', cast(s_suppkey as varchar), ' # desk')
  when 1 then concat('sup', cast(s_suppkey as varchar), ' : SUPPLIER#', cast(s_suppkey as varchar))
  when 2 then concat('sup', cast(s_suppkey as varchar), chr(9), 'SUPPLIER#', cast(s_suppkey as varchar))
  else concat('# sup', cast(s_suppkey as varchar), ' = skipped') end as line from supplier
 union all select s_suppkey*2+1, concat('  SUP', cast(s_suppkey as varchar), ' =  Supplier#', cast(s_suppkey as varchar), ' bis ')
 from supplier where s_suppkey%10 = 0"""

ORACLE["alias_text"] = B.with_(lines=_ALIAS_LINES) + f""",
l0 as (select line_no, {S.strip('line')} as l0 from lines),
l1 as (select line_no, case when strpos(l0, '#') > 0 then {S.strip("split_part(l0, '#', 1)")} else l0 end as l from l0
  where l0 <> '' and not starts_with(l0, '#')),
l2 as (select line_no, l from l1 where l <> ''),
p as (select line_no,
  case when strpos(l, '=') > 0 then split_part(l, '=', 1) when strpos(l, ':') > 0 then split_part(l, ':', 1)
   else {S.strip("split_part(l, chr(9), 1)")} end as a0,
  case when strpos(l, '=') > 0 then substr(l, strpos(l, '=') + 1) when strpos(l, ':') > 0 then substr(l, strpos(l, ':') + 1)
   else {S.strip("split_part(l, chr(9), 2)")} end as c0 from l2),
p2 as (select line_no, {S.clean_label('a0')} as a, {S.clean_label('c0')} as c from p),
p3 as (select * from p2 where a is not null and c is not null),
e as (select lower(a) as alias_key, arg_max(c, line_no) as ce from p3 group by 1),
d as (select lower(c) as alias_key, arg_min(c, line_no) as cd from p3 group by 1)
select coalesce(e.alias_key, d.alias_key) as alias_key, coalesce(e.ce, d.cd) as canonical from e full join d on e.alias_key = d.alias_key"""

_COLN = """coln as (select col2.*, """ + _norm('col2', 'counterparty', 'a', 'norm_counterparty') + ", " + _norm('col2', 'typology', 'y', 'norm_typology') + """ from col2),
cola as (select norm_counterparty, norm_typology,
  first(counterparty order by o1, o2) filter (where counterparty is not null) as counterparty,
  first(typology order by o1, o2) filter (where typology is not null) as typology,
  coalesce(sum(mtm_own), 0) as mtm_own, coalesce(sum(mtm_cpty), 0) as mtm_cpty
  from coln where norm_counterparty is not null and norm_typology is not null group by 1, 2)"""

ORACLE["aggregate_by_norm"] = _TPL + "," + _COLN + """
select norm_counterparty, norm_typology, counterparty, typology, cast(mtm_own as double) as mtm_own, cast(mtm_cpty as double) as mtm_cpty from cola"""

_RECON = _TPL + "," + _COLN + """,
tn as (select tpl.*, """ + _norm('tpl', 'counterparty', 'a', 'norm_counterparty') + ", " + _norm('tpl', 'classif', 'y', 'norm_typology') + """ from tpl),
tpa as (select norm_counterparty, norm_typology,
  first(counterparty order by classif, counterparty) filter (where counterparty is not null) as counterparty_template,
  first(classif order by classif, counterparty) filter (where classif is not null) as classif_di,
  coalesce(sum(mtm_own), 0) as tg, coalesce(sum(mtm_cpty), 0) as tc
  from tn where norm_counterparty is not null and norm_typology is not null group by 1, 2),
rc as (select coalesce(cola.norm_counterparty, tpa.norm_counterparty) as norm_counterparty,
  coalesce(cola.norm_typology, tpa.norm_typology) as norm_typology,
  tpa.counterparty_template, tpa.classif_di,
  cast(coalesce(tg, 0) as double) as mtm_own_template, cast(coalesce(tc, 0) as double) as mtm_cpty_template,
  cola.counterparty as counterparty_collateral, cola.typology,
  cast(coalesce(cola.mtm_own, 0) as double) as mtm_own_collateral, cast(coalesce(cola.mtm_cpty, 0) as double) as mtm_cpty_collateral,
  cast(coalesce(tg, 0) - coalesce(cola.mtm_own, 0) as double) as gap_mtm_own,
  cast(coalesce(tc, 0) - coalesce(cola.mtm_cpty, 0) as double) as gap_mtm_cpty,
  tpa.counterparty_template is not null as present_template, cola.counterparty is not null as present_collateral
  from cola full join tpa on cola.norm_counterparty = tpa.norm_counterparty and cola.norm_typology = tpa.norm_typology)
"""

ORACLE["collateral_recon"] = _RECON + "select * from rc order by norm_counterparty nulls last, norm_typology nulls last"

ORACLE["recon_max_gap"] = _RECON + """
select max(greatest(abs(gap_mtm_own), abs(gap_mtm_cpty))) as max_abs_gap,
 max(greatest(abs(gap_mtm_own), abs(gap_mtm_cpty))) < 1e-6 as concordant from rc"""

# ------------------------------------------------------------------ period comparison
def _prod(name: str, filled: str) -> str:
    return f"""{name} as (select classif, sum(amount) as total from (
  select {S.strip('classif')} as classif, mtm_own as amount from t where l_linestatus {filled} 'F'
  union all select 'Bond Forward', mv from fs where status <> 'rejected' and o_orderstatus {filled} 'F') z
 where classif is not null and classif <> '' and amount is not null group by classif)"""

_PERIOD = _FWD_DEC + f""",
t as ({B.T}),
{_prod('cur', '<>')},
{_prod('prev', '=')}
"""

ORACLE["dirty_by_class"] = _PERIOD + """
select classif, cast(total as double) as total, 'current' as production from cur
union all select classif, cast(total as double), 'previous' from prev"""

ORACLE["period_compare"] = _PERIOD + """,
j as (select coalesce(p.classif, c.classif) as classif, coalesce(p.total, 0) as o, coalesce(c.total, 0) as n
 from prev p full join cur c on p.classif = c.classif)
select classif, cast(o as double) as dirty_previous, cast(n as double) as dirty_current, cast(n - o as double) as gap,
 case when abs(cast(o as double)) > 1e-12 then (cast(n as double) - cast(o as double)) / cast(o as double) * 100.0 end as gap_pct
from j order by abs(n - o) desc, classif"""

ORACLE["period_totals"] = _PERIOD + """
select cast(coalesce((select sum(total) from cur), 0) as double) as total_current,
 cast(coalesce((select sum(total) from prev), 0) as double) as total_previous,
 cast(coalesce((select sum(total) from cur), 0) - coalesce((select sum(total) from prev), 0) as double) as delta_total"""

_BRIDGE = "select * from (values " + ",".join(
    f"({o}, {S.q(lab)}, {S.q(b)}, {str(r).lower()}, {('null' if cat is None else S.q(cat))}, {S.q(al)}, {str(fb).lower()})"
    for o, lab, b, r, cat, al, fb in [
        (o, lab, b, r, cat, " ".join(a.strip().lower().split()), False)
        for o, lab, b, r, cats, _ in dims.SUMMARY_ITEMS for cat in cats for a in sorted(set(dims.CATEGORY_ALIASES[cat]))
    ] + [
        (o, lab, b, r, None, " ".join(a.strip().lower().split()), True)
        for o, lab, b, r, _, fbs in dims.SUMMARY_ITEMS for a in fbs
    ]
) + ") v(item_ord, item_label, bullet, needs_reason, category, alias_norm, is_fallback)"

_ITEMS = "select distinct item_ord, item_label, bullet, needs_reason from br"


def _roll(name: str, src: str) -> str:
    return f"""{name}_n as (select {S.norm_label('classif')} as alias_norm, sum(total) as v from {src} group by 1),
{name}_i as (select item_ord, sum(v) filter (where not is_fallback) as cat, count(*) filter (where not is_fallback) as ncat,
  sum(v) filter (where is_fallback) as fb from (select distinct * from br) b join {name}_n using (alias_norm) group by item_ord),
{name} as (select it.item_ord, it.item_label, it.bullet, it.needs_reason,
  cast(case when ncat > 0 then cat else fb end as double) as value from it left join {name}_i using (item_ord))"""

_ROLL = _PERIOD + f""",
br as ({_BRIDGE}), it as ({_ITEMS}),
{_roll('rc', 'cur')},
{_roll('rp', 'prev')}
"""

ORACLE["category_rollup"] = _ROLL + """
select 'current' as production, item_ord, item_label, value from rc
union all select 'previous', item_ord, item_label, value from rp"""


def _summary_sql() -> str:
    from ..operators import period as P

    head = "\n".join([P.SUMMARY_GREETING, "", P.SUMMARY_INTRO.format(date="30/06/1995"), P.SUMMARY_SECTION]) + "\n"
    unit = P.SUMMARY_UNIT_DATED.format(date="31/03/1995")
    line = f"concat(bullet, item_label, ' : ', {S.format_money('cur')}, ' vs ', {S.format_money('prev')}, {S.q(unit)})"
    block = (f"case when needs_reason then concat({line}, chr(10), {S.q(P.SUMMARY_REASON)}, chr(10)) "
             f"else concat({line}, chr(10)) end")
    text = f"concat({S.q(head)}, string_agg({block}, chr(10) order by item_ord))"
    return _ROLL + f""",
j as (select rc.item_ord, rc.item_label, rc.bullet, rc.needs_reason, rc.value as cur, rp.value as prev
  from rc join rp using (item_ord) where rc.value is not null or rp.value is not null)
select case when count(*) > 0 then {S.strip(text)} end as summary from j"""


ORACLE["mtm_summary_text"] = _summary_sql()
