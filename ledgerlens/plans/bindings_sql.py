"""The input bindings of FIXTURES.md section C as DuckDB SQL (oracle side)."""

from __future__ import annotations

from ..sources.bindings import RUN_DATE, TYPOLOGY_ALIASES
from . import sqltext as S

T = """select l_orderkey*10+l_linenumber as trade_id,
 case when l_linenumber=7 then case l_suppkey%4 when 0 then 'N/A' when 1 then '  ' when 2 then '-' else null end
      else concat(' SWAP_',cast(l_partkey as varchar),' ') end as code_raw,
 case l_partkey%4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end as classif,
 case l_suppkey%3 when 0 then 'HICPXT' when 1 then 'frcpixt' else 'OTHER' end as index_rate,
 concat('Supplier#',cast(l_suppkey as varchar)) as cpty,
 case when l_quantity=50 then cast(0 as decimal(12,2)) when l_quantity=49 then null else cast(l_extendedprice as decimal(12,2)) end as notional,
 cast(l_extendedprice as decimal(12,2))*cast(l_discount as decimal(4,2)) as mtm_own,
 cast(l_extendedprice as decimal(12,2))*cast(l_tax as decimal(4,2)) as mtm_cpty,
 cast(l_shipdate as date) as end_date, l_returnflag, l_linestatus,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate
from lineitem"""

ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

# report rows: valid codes only, amounts as doubles
R = f"""select trade_id, {S.code_text('code_raw')} as code, classif, index_rate, cpty,
 cast(notional as double) as notional, cast(mtm_own as double) as dirty_total,
 {S.div_opt('cast(mtm_own as double)', 'cast(notional as double)')} as dirty_pct,
 end_date, l_returnflag, l_linestatus, {ORD}
from t where {S.valid_code('code_raw')}"""

M = """select o_orderkey, o_orderstatus,
 case when o_orderkey%11=0 then null when o_orderkey%13=0 then '' else concat('SWAP_',cast(o_custkey*2 as varchar),'/',o_orderpriority) end as free_text_2,
 case o_orderkey%3 when 0 then concat(' bdfwd ',cast(o_orderkey as varchar)) when 1 then 'BDFWD' else 'IRS' end as free_text_1,
 case o_orderkey%5 when 0 then '601' when 1 then '602.0' when 2 then ' 603' when 3 then '604' else null end as book,
 case when o_orderkey%7=0 then ' ' else concat('CP',cast(o_custkey%9 as varchar)) end as cp,
 case when o_orderkey%17=0 then cast(0 as decimal(12,2)) when o_orderkey%19=0 then null else cast(o_totalprice as decimal(12,2)) end as notional,
 cast(o_totalprice as decimal(12,2))*cast(0.01 as decimal(4,2)) as mtm_value,
 case when o_orderstatus='P' and o_orderkey%4=0 then null
      else cast(o_totalprice as decimal(12,2))*cast(0.0011 as decimal(6,4))*cast(o_orderkey%10 as int) end as mtm_diff
from orders"""

# marks per code (AGG-1)
MK = f"""select code, cast(sum(coalesce(mtm_value,0)) as double) as mtm_value,
 cast(sum(coalesce(mtm_diff,0)) as double) as mtm_diff,
 cast(sum(coalesce(mtm_value-mtm_diff,0)) as double) as mtm_cpty
from (select {S.code_prefix('free_text_2')} as code, mtm_value, mtm_diff from m) x
where code <> '' group by code"""

SENS = """select concat(case when p_partkey%10=3 then 'UNUSED_' else 'SWAP_' end,cast(p_partkey as varchar)) as code, p_partkey*2+k.k as src_row,
 case when p_size%5=0 then null else p_retailprice+k.k end as sensi_leg1,
 case when p_size%3=0 then null else -p_retailprice end as sensi_leg2,
 case when p_size%4=0 then p_retailprice*2 else null end as sensi_total,
 cast(p_size as double) as duration_leg1
from part cross join (select 0 as k union all select 1 as k) k"""

C = """select case when l_suppkey%7=0 then concat('Unlisted#',cast(l_suppkey as varchar))
        when (l_suppkey+l_partkey//4)%5=0 then concat('SUP',cast(l_suppkey as varchar))
        when (l_suppkey+l_partkey//4)%5=1 then concat(' supplier#',cast(l_suppkey as varchar),'  ') else upper(concat('Supplier#',cast(l_suppkey as varchar))) end as cpty,
 case when l_suppkey%7=1 then 'Repo' when l_returnflag='A' then 'Returned line' else case l_partkey%4 when 0 then 'IR swap, fixed/float' when 1 then 'XpressInstrument'
        when 2 then 'Cross currency, fixed/fixed' else 'Forward' end end as typology,
 sum(cast(l_extendedprice as decimal(12,2))*cast(l_discount as decimal(4,2))) as mtm_own,
 sum(cast(l_extendedprice as decimal(12,2))*cast(l_tax as decimal(4,2))) as mtm_cpty
from lineitem group by 1,2"""

A = """select concat('sup',cast(s_suppkey as varchar)) as alias_key, concat('SUPPLIER#',cast(s_suppkey as varchar)) as canonical from supplier"""

Y = "select * from (values " + ",".join(f"({S.q(a)},{S.q(c)})" for a, c in TYPOLOGY_ALIASES) + ") v(alias_key, canonical)"

RUN = f"date {S.q(RUN_DATE)}"


def with_(**ctes: str) -> str:
    """``WITH name AS (...)`` prefix for the given bindings, in order."""
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n"
