"""Mapping projection queries (MAP-1..10, MAP-12, NUM-5, UDF-1, SRT-4, SNK-2)
over the cells binding G and over lineitem, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, mapping
from ..sources import bindings as B
from . import sqltext as S
from .catalog import register
from .grid_queries import _HEAD_SQL, _bind_sql, _grid
from .oracle import ORACLE

# A mapping for the G layouts (letters, names and a leg spec;
# one target outside the template, one formula outside the whitelist).
G_MAPPING = {
    "variables": {
        "notional_leg1": {"source_letter": "E"},
        "notional_leg2": {"source_leg": {"base": "Notional", "leg": 2}},
        "dirtyvalue_tot": {"source": "Dirty Value"},
    },
    "columns": [
        {"target": "Code DI", "source": "Custom Attribute5 Value"},
        {"target": "Classif DI", "source": "Class"},
        {"target": "Class", "source": "Class"},
        {"target": "External Id", "source": "External Id"},
        {"target": "Counterparty", "source": "Counterparty"},
        {"target": "#Ticket", "source_letter": "A"},
        {"target": "Notional", "target_occurrence": 1, "source_letter": "E"},
        {"target": "Notional", "target_occurrence": 2, "source_leg": {"base": "Notional", "leg": 2}},
        {"target": "Dirty Value", "target_occurrence": 3, "source": "Dirty Value"},
        {"target": "Start Date", "source_letter": "F"},
        {"target": "Not In Template", "source": "Class"},
    ],
    "computed": [
        {"target": "Dirty Value (%)", "target_occurrence": 3, "expr": "dirtyvalue_tot / notional_leg1"},
        {"target": "Dirty Value (%)", "target_occurrence": 2, "expr": "_div(dirtyvalue_tot, notional_leg2)"},
        {"target": "Dirty Value (%)", "target_occurrence": 1, "expr": "(dirtyvalue_tot - notional_leg2) * 2 / notional_leg1 + 1"},
        {"target": "Accrued Interest (%)", "expr": "dirtyvalue_tot ** 2"},
    ],
}
G_TEMPLATE = [
    "Code DI", "Classif DI", "Class", "External Id", "Counterparty", "#Ticket", "Start Date", "Notional", "Notional",
    "Dirty Value", "Dirty Value", "Dirty Value", "Dirty Value (%)", "Dirty Value (%)", "Dirty Value (%)",
    "Accrued Interest (%)",
]


PREVIEW_ROWS = 200  # fixed value: rows of the preview
HEADER_ROW = 6  # fixed value: header row of the template


def _mapped(spark, sf_dir, preview: bool, placed_from: int | None = None):
    c, h, lay = _grid(spark, sf_dir)
    m = mapping.compile_mapping(G_MAPPING)
    rec = mapping.mapped_records(c, h, lay, m, first=PREVIEW_ROWS if preview else None)
    keep = ()
    if placed_from is not None:
        rec, keep = mapping.placed_records(rec, grid.row_slices(c), start=placed_from), ("sheet_row",)
    out, _ = mapping.apply_mapping(rec, m, None if preview else G_TEMPLATE, preview=preview, keep=keep)
    return out


@register
def mapped_report(spark, sf_dir):
    """MAP-1..9, MAP-12, DIM-5, JN-12, SNK-2: report rows in template column
    order (target#occurrence), valid codes only; unknown targets skipped."""
    return _mapped(spark, sf_dir, False).drop("ord")


@register
def mapping_preview(spark, sf_dir):
    """MAP-10, SRT-4: flat var:/direct:/calc: preview, first 200 rows in
    source order (a top-k, found on the code cells of all rows)."""
    return mapping.preview(_mapped(spark, sf_dir, True), PREVIEW_ROWS)


def _srcs_sql() -> dict[str, str]:
    m = mapping.compile_mapping(G_MAPPING)
    out = {}
    for s in m.sources():
        kind = {"letter": "letter", "name": "name", "leg": "leg"}[s.kind]
        out[s.key] = _bind_sql(kind, s.value)
    return out


_SRC = _srcs_sql()
_ALIAS = {k: f"s{i}" for i, k in enumerate(_SRC)}


def _src(key: str) -> str:
    return _ALIAS[key]


def _lenient_ts(x: str) -> str:
    st = S.strip(x)
    num = S.parse_eu(x)

    def g(pat, fmt):
        return f"case when regexp_matches({st}, '{pat}') then try_strptime({st}, '{fmt}') end"

    text = (f"coalesce({g('^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$', '%d/%m/%Y')}, {g('^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$', '%d-%m-%Y')}, "
            f"{g(r'^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$', '%d.%m.%Y')}, {g('^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$', '%Y-%m-%d')}, "
            f"{g('^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$', '%m/%d/%Y')})")
    return (f"coalesce(case when {num} > 59 then timestamp '1899-12-30 00:00:00' + to_seconds(cast(round({num} * 86400.0) as bigint)) end, "
            f"{text})")


_CODE = _src("N:custom attribute5 value")
_V1, _V2, _VD = _src("L:E"), _src("G:notional:2"), _src("N:dirty value")
_n1, _n2, _nd = S.parse_eu(_V1), S.parse_eu(_V2), S.parse_eu(_VD)

_MAP_SQL = _HEAD_SQL + f""",
rows_ as (select distinct g.source_file, g.row_idx from g join hd using (source_file) where g.row_idx >= hd.body_start),
bind as (select r.source_file, r.row_idx, {', '.join(f'{sql} as p_{_ALIAS[k]}' for k, sql in _SRC.items())} from rows_ r),
rec as (select b.source_file, b.row_idx, {', '.join(f'(select value from g where g.source_file = b.source_file and g.row_idx = b.row_idx and g.col_idx = b.p_{a}) as {a}' for a in _ALIAS.values())}
  from bind b),
v as (select *, {_n1} as notional_leg1, {_n2} as notional_leg2, {_nd} as dirtyvalue_tot from rec where {S.valid_code(_CODE)})
"""

_COLS = [
    ("Code DI#1", _CODE), ("Classif DI#1", _src("N:class")), ("Class#1", _src("N:class")),
    ("External Id#1", _src("N:external id")), ("Counterparty#1", _src("N:counterparty")), ("#Ticket#1", _src("L:A")),
    ("Start Date#1", _lenient_ts(_src("L:F"))), ("Notional#1", _n1), ("Notional#2", _n2), ("Dirty Value#3", _nd),
]
_CALC = [
    ("Dirty Value (%)#1", "((dirtyvalue_tot - notional_leg2) * 2.0) / nullif(notional_leg1, 0) + 1.0"),
    ("Dirty Value (%)#2", "dirtyvalue_tot / nullif(notional_leg2, 0)"),
    ("Dirty Value (%)#3", "dirtyvalue_tot / nullif(notional_leg1, 0)"),
    ("Accrued Interest (%)#1", "cast(null as double)"),
]

ORACLE["mapped_report"] = _MAP_SQL + "select source_file, row_idx, " + _CODE + " as code_raw, " + ", ".join(
    f'{sql} as "{name}"' for name, sql in _COLS + _CALC
) + " from v"

ORACLE["mapping_preview"] = _MAP_SQL + "select source_file, row_idx, " + _CODE + " as code_raw, " + ", ".join(
    [f'{v} as "var:{v}"' for v in ("notional_leg1", "notional_leg2", "dirtyvalue_tot")]
    + [f'{sql} as "direct:{name}"' for name, sql in _COLS]
    + [f'{_src("N:class")} as "direct:Not In Template#1"']
    + [f'{sql} as "calc:{name}"' for name, sql in _CALC]
) + " from v order by source_file, row_idx limit 200"


# ------------------------------------------------------------------ shipped ratios
def _legs(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")
    p, q, d, t = (F.col(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    v = {
        "notional_leg1": p,
        "notional_leg2": F.when(q == 50, F.lit(0.0)).otherwise(q * 1000),
        "dirtyvalue_leg1": p * d,
        "cleanvalue_leg1": p * t,
        "accrued_leg1": p * (d - t),
        "dirtyvalue_leg2": q * d,
        "cleanvalue_leg2": q * t,
        "accrued_leg2": F.when(F.col("l_linenumber") != 7, q),
    }
    x = li.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in v.items()])
    return x.withColumns({
        "dirtyvalue_tot": F.col("dirtyvalue_leg1") + F.col("dirtyvalue_leg2"),
        "cleanvalue_tot": F.col("cleanvalue_leg1") + F.col("cleanvalue_leg2"),
        "accrued_tot": F.col("accrued_leg1") + F.col("accrued_leg2"),
    })


@register
def ratio_columns(spark, sf_dir):
    """MAP-5, MAP-7, MAP-8, NUM-5, SRC-10: the nine shipped ratio formulas
    (legs over their notional, total over the leg-1 notional) loaded from the
    YAML config and compiled to Columns."""
    m = mapping.compile_mapping(mapping.shipped_config())
    x = _legs(spark, sf_dir)
    env = {n: F.col(n) for n in x.columns if n not in ("l_orderkey", "l_linenumber")}
    return x.select("l_orderkey", "l_linenumber",
                    *[mapping.compile_expr(it.expr, env).alias(it.column) for it in m.computed])


_LEGS_SQL = """select l_orderkey, l_linenumber, notional_leg1, notional_leg2, dirtyvalue_leg1, cleanvalue_leg1, accrued_leg1,
 dirtyvalue_leg2, cleanvalue_leg2, accrued_leg2, dirtyvalue_leg1 + dirtyvalue_leg2 as dirtyvalue_tot,
 cleanvalue_leg1 + cleanvalue_leg2 as cleanvalue_tot, accrued_leg1 + accrued_leg2 as accrued_tot from (
 select l_orderkey, l_linenumber, l_extendedprice as notional_leg1, case when l_quantity = 50 then 0.0 else l_quantity * 1000 end as notional_leg2,
  l_extendedprice * l_discount as dirtyvalue_leg1, l_extendedprice * l_tax as cleanvalue_leg1, l_extendedprice * (l_discount - l_tax) as accrued_leg1,
  l_quantity * l_discount as dirtyvalue_leg2, l_quantity * l_tax as cleanvalue_leg2, case when l_linenumber <> 7 then l_quantity end as accrued_leg2
 from lineitem) z"""


def _ratio_sql() -> str:
    m = mapping.compile_mapping(mapping.shipped_config())
    cols = []
    for it in m.computed:
        a, b = [s.strip() for s in it.expr.split("/")]
        cols.append(f'{a} / nullif({b}, 0) as "{it.column}"')
    return f"with x as ({_LEGS_SQL}) select l_orderkey, l_linenumber, " + ", ".join(cols) + " from x"


ORACLE["ratio_columns"] = _ratio_sql()

# Formula texts exercising the whitelist (the last four give null).
FORMULAS = (
    "a / b", "_div(a, b)", "-a + b * 2", "(a - b) / (b + 0.04)", "a / c",
    "a ** 2", "__import__('os')", "a +", "unknown / a",
)


@register
def computed_expression(spark, sf_dir):
    """MAP-7, UDF-1: formula texts compiled at plan time (no eval); zero
    divisors, nulls and rejected syntax give null."""
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    x = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("a"),
                  (F.col("l_discount") - F.lit(0.04)).alias("b"),
                  F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("c"))
    env = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
    return x.select("l_orderkey", "l_linenumber",
                    *[mapping.compile_expr(f, env).alias(f"e{i + 1}") for i, f in enumerate(FORMULAS)])


ORACLE["computed_expression"] = """select l_orderkey, l_linenumber,
 a / nullif(b, 0) as e1, a / nullif(b, 0) as e2, (-a) + (b * 2.0) as e3, (a - b) / nullif(b + 0.04, 0) as e4, a / nullif(c, 0) as e5,
 cast(null as double) as e6, cast(null as double) as e7, cast(null as double) as e8, cast(null as double) as e9
from (select l_orderkey, l_linenumber, l_extendedprice as a, l_discount - 0.04 as b,
 case when l_linenumber <> 7 then l_extendedprice end as c from lineitem) z"""


@register
def report_cells(spark, sf_dir):
    """SNK-2, SRT-5, MAP-6, CTL-5: the mapped report as sheet cells: rows
    from header row 6 + 1 in source order without gaps, columns at the
    template position of each target occurrence, run date in B3."""
    from ..sources.bindings import RUN_DATE

    out = _mapped(spark, sf_dir, False, placed_from=HEADER_ROW + 1)
    return mapping.report_cells(out, G_TEMPLATE, HEADER_ROW, RUN_DATE)


def _cells_sql() -> str:
    from ..sources.bindings import RUN_DATE

    idx = mapping.template_index(G_TEMPLATE)
    numeric = {"Notional#1", "Notional#2", "Dirty Value#3"} | {n for n, _ in _CALC}
    parts = []
    for name, _ in _COLS + _CALC:
        label, occ = name.rsplit("#", 1)
        pos = idx.get((" ".join(label.strip().lower().split()), int(occ)))
        if pos is None:
            continue
        text, num, stamp = "cast(null as varchar)", "cast(null as double)", "cast(null as timestamp)"
        if name == "Start Date#1":
            stamp = f'cast("{name}" as timestamp)'
        elif name in numeric:
            num = f'cast("{name}" as double)'
        else:
            text = f'"{name}"'
        parts.append(f"select sheet_row, {pos + 1} as sheet_col, {text} as text, {num} as number, {stamp} as stamp from rp")
    head, sel = ORACLE["mapped_report"].rsplit("select source_file, row_idx, ", 1)
    sel = sel[: sel.rindex(" from v")]
    return head.rstrip() + f""",
rp as (select row_number() over (order by source_file, row_idx) + 6 as sheet_row, {sel} from v),
rc as ({" union all ".join(parts)})
select cast(sheet_row as bigint) as sheet_row, cast(sheet_col as bigint) as sheet_col, text, number, stamp from rc
where text is not null or number is not null or stamp is not null
union all select 3, 2, null, null, cast(date '{RUN_DATE}' as timestamp)"""


ORACLE["report_cells"] = _cells_sql()
