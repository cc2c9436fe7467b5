"""Queries over dealer extracts in row form at their real width: layouts, the
shipped mapping, and the report placed in the order in which rows are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dims, enrich, mapping
from ..operators import sheets as SH
from ..operators.grid import letter_to_index_py
from ..operators.placement import numbered_as_read, with_read_position
from ..session import ensure_checkpoint_dir
from ..sources import extracts as X
from ..sources import sheets as B
from . import sqltext as S
from .catalog import register
from .grid_queries import _EXPECTED, _HEAD_SQL, _bind_sql
from .mapping_queries import _lenient_ts
from .oracle import ORACLE

#: Header row of the report sheet that the mapping fills.
TEMPLATE = [
    "Code DI", "Classif DI", "Class", "External Id", "Counterparty",
    "Leg Type", "Pay/Rec", "Index/Fixed Rate", "Spread (bp)", "Start Date", "End Date", "Notional",
    "Dirty Value", "Clean Value", "Accrued Interest", "Dirty Value (%)", "Clean Value (%)", "Accrued Interest (%)",
    "Comment",
    "Leg Type", "Pay/Rec", "Index/Fixed Rate", "Spread (bp)", "Start Date", "End Date", "Currency", "Notional",
    "Dirty Value", "Clean Value", "Accrued Interest", "Dirty Value (%)", "Clean Value (%)", "Accrued Interest (%)",
    "Dirty Value", "Clean Value", "Accrued Interest", "Dirty Value (%)", "Clean Value (%)", "Accrued Interest (%)",
]


def _mapping() -> mapping.Mapping:
    return mapping.compile_mapping(mapping.shipped_config())


def _extracts(spark, sf_dir):
    """The extracts as a stored table in sheet order, read back with the read position."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-io/extracts-{uuid.uuid4().hex}"
    X.in_sheet_order(X.dealer_extracts(spark, sf_dir)).write.parquet(path)
    return with_read_position(B.read_sheet_rows(spark, path, first_sheet=True))


def _records(spark, sf_dir):
    rows = _extracts(spark, sf_dir)
    headers, lay = SH.prepare(rows, dims.expected_headers(spark))
    return mapping.sheet_records(rows, headers, lay, _mapping())


@register
def extract_layout(spark, sf_dir):
    """GRD-2, GRD-3, GRD-4, GRD-8, GRD-10, GRD-11, GRD-12, SRC-5: column layout
    of each extract in row form; headed columns without cells are dropped,
    unnamed ones blanked, repeated and dotted labels suffixed."""
    return SH.prepare(_extracts(spark, sf_dir), dims.expected_headers(spark))[1]


@register
def extract_mapping(spark, sf_dir):
    """DIM-5, MAP-1..5, MAP-7..9, JN-12, GRD-9, GRD-20, GRD-21: the shipped mapping
    (11 variables, 29 direct columns, 9 ratios) over extracts of 125 columns;
    body rows are projected where they are read."""
    out, _ = mapping.apply_mapping(_records(spark, sf_dir), _mapping(), preview=True)
    return out.drop("ord")


@register
def extract_report_cells(spark, sf_dir):
    """SNK-2, SRT-5, MAP-6, CTL-5: the mapped extracts as cells of the configured
    sheet, rows numbered in read order without gaps, each target at its
    template position, B3 with the run date of the earlier report's B3."""
    m = _mapping()
    report, _ = mapping.apply_mapping(_records(spark, sf_dir), m, TEMPLATE, keep=("_file", "_split"))
    placed = numbered_as_read(report, "sheet_row", start=m.header_row + 1)
    earlier = SH.run_date_cells(B.report_sheets(spark, sf_dir).where(F.col("sheet") == m.sheet))
    dates = enrich.run_date_of(earlier).where(F.col("source_file") == "REPORT_0.xlsm")
    return mapping.cells_at(placed, report, TEMPLATE, dates, m.sheet)


# ------------------------------------------------------------------ oracle
def _cell_sql(letter: str, layout: int) -> str:
    """A body cell of a layout as SQL over orders (k: the key, c: the customer)."""
    named = {
        "ticket": "cast(k as varchar)", "external": "concat('EXT', c)", "cpty": "concat('Supplier#', k % 50)",
        "currency": "case k % 3 when 0 then 'EUR' when 1 then 'USD' else 'GBP' end",
        "class": "case c % 4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end",
        "code": "case when k % 13 = 0 then case k % 4 when 0 then 'N/A' when 1 then '  ' when 2 then '-' end else concat(' SWAP_', c, ' ') end",
    }
    comma = lambda x: f"replace(cast({x} as varchar), '.', ',')"
    for name, at in X.NAMED_LETTERS[layout].items():
        if at == letter:
            return named[name]
    for i, letters in enumerate(X.LEG_LETTERS):
        if letter in letters:
            fixed = f"(k + {i}) % 2 = 0"
            return (
                f"case when {fixed} then 'Fixed' else 'Float' end", f"case when {fixed} then 'P' else 'R' end",
                f"case when k % 3 = 0 then 'HICPXT' else {comma('rate')} end",
                f"case when k % 5 <> {i} then {comma('tax')} end", f"strftime(o_orderdate, '{('%d/%m/%Y', '%Y-%m-%d')[i]}')",
                f"case when k % 17 = 0 then 'n.c.' else cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) + lots * {i + 1} as varchar) end",
            )[letters.index(letter)]
    if letter in X.NOTIONAL_LETTERS:
        return ("case when k % 19 = 0 then '0' else cast(price as varchar) end",
                f"case when k % 23 <> 0 then concat(' ', {comma('price * 2')}) end")[X.NOTIONAL_LETTERS.index(letter)]
    amounts = (
        ("(price + lots) * rate", "(price + lots) * tax", "lots"),
        ("price * rate", "price * tax", "case when k % 41 = 0 then 'abc' else cast(price * rate - price * tax as varchar) end"),
        ("lots * rate", "lots * tax", "case when k % 29 <> 0 then lots end"),
    )
    for letters, cells in zip(X.AMOUNT_LETTERS, amounts, strict=True):
        if letter in letters:
            return f"cast({cells[letters.index(letter)]} as varchar)"
    other = {"H": "'x'", "J": "cast(k % 10 as varchar)"} | ({"F": "'second'"} if layout == X.NARROW else {})
    return other.get(letter, "cast(null as varchar)")


def _letter(i: int) -> str:
    return next(a + b for a in ("", *"ABCD") for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if letter_to_index_py(a + b) == i)


def _wide_sql() -> str:
    """Body rows of all files with their cells as a list, and header cells."""
    lists = []
    for layout in range(X.LAYOUTS):
        width = X.NARROW_WIDTH if layout == X.NARROW else X.WIDTH
        lists.append(f"when {layout} then [{', '.join(_cell_sql(_letter(i), layout) for i in range(width))}]")
    heads = [
        (layout, row, i, text) for layout in range(X.LAYOUTS) for row, texts in X._labels(layout)
        for i, text in enumerate(texts) if text is not None
    ]
    return f"""with o as (select *, o_orderkey as k, o_custkey as c, cast(o_totalprice as decimal(12,2)) as price,
 cast(o_orderkey % 11 as integer) * cast(0.01 as decimal(4,2)) as rate, cast(o_orderkey % 7 as integer) * cast(0.01 as decimal(4,2)) as tax,
 cast(o_orderkey % 50 + 1 as integer) as lots, o_orderkey % {X.LAYOUTS} as f from orders),
wide as (select concat('IFT_', f, '_', lpad(cast(k // {X.BLOCK_KEYS} as varchar), 6, '0'), '.xls') as source_file, f,
 cast(k % {X.BLOCK_KEYS} // {X.LAYOUTS} + case f {' '.join(f'when {i} then {r}' for i, r in enumerate(X.BODY_ROW))} end as integer) as row_idx,
 case f {' '.join(lists)} end as vals from o),
hcells as (select * from (values {', '.join(f"({a},{b},{c},{S.q(v)})" for a, b, c, v in heads)}) h(f, row_idx, col_idx, value)),
g as (select source_file, row_idx, cast(i as integer) as col_idx, vals[i + 1] as value from wide, range({X.WIDTH}) r(i) where vals[i + 1] is not null
 union all select w.source_file, cast(h.row_idx as integer), cast(h.col_idx as integer), value from hcells h join (select distinct source_file, f from wide) w using (f)),
"""


#: The header and layout rules are those of the cells form, over these cells.
_LAYOUT_SQL = _wide_sql() + _HEAD_SQL[_HEAD_SQL.index("hn as ("):]
assert _EXPECTED in _LAYOUT_SQL
ORACLE["extract_layout"] = _LAYOUT_SQL + "select * from lay"

_M = _mapping()
_KEYS = {s.key: (f"s{i}", _bind_sql(s.kind, s.value)) for i, s in enumerate(_M.sources())}
_RECORD_SQL = _LAYOUT_SQL + f""",
bind as (select r.source_file, r.body_start, {', '.join(f'{sql} as p_{a}' for a, sql in _KEYS.values())} from hd r),
rec as (select w.source_file, w.row_idx, {', '.join(f'vals[p_{a} + 1] as {a}' for a, _ in _KEYS.values())} from wide w join bind using (source_file)),
v as (select *, {', '.join(f'{S.parse_eu(_KEYS[s.key][0])} as {n}' for n, s in _M.variables.items())} from rec
 where {S.valid_code(_KEYS['N:custom attribute5 value'][0])})
"""


def _target_sql(item: mapping.Item) -> str:
    if item.expr is not None:
        top, bottom = [x.strip() for x in item.expr.split("/")]
        return f"{top} / nullif({bottom}, 0)"
    x = _KEYS[item.source.key][0]
    return {"number": S.parse_eu, "date": _lenient_ts, "text": str}[mapping.target_kind(item.target)](x)


_ITEMS = [*_M.columns, *_M.computed]
ORACLE["extract_mapping"] = _RECORD_SQL + "select source_file, row_idx, " + _KEYS["N:custom attribute5 value"][0] + " as code_raw, " + ", ".join(
    [f'{n} as "var:{n}"' for n in _M.variables]
    + [f'{_target_sql(i)} as "{"calc" if i.expr is not None else "direct"}:{i.column}"' for i in _ITEMS]
) + " from v"


def _cells_sql() -> str:
    index = mapping.template_index(TEMPLATE)
    parts = []
    for i in _ITEMS:
        kind, empty = mapping.target_kind(i.target), {"text": "varchar", "number": "double", "date": "timestamp"}
        fields = [f"{_target_sql(i)} as {n}" if k == kind else f"cast(null as {empty[k]}) as {n}"
                  for k, n in (("text", "text"), ("number", "number"), ("date", "stamp"))]
        pos = index[(" ".join(i.target.strip().lower().split()), i.occurrence)]
        parts.append(f"select sheet_row, {pos + 1} as sheet_col, {', '.join(fields)} from rp")
    return _RECORD_SQL + f""",
rp as (select *, row_number() over (order by source_file, row_idx) + {_M.header_row} as sheet_row from v),
rc as ({' union all '.join(parts)})
select {S.q(_M.sheet)} as sheet, cast(sheet_row as bigint) as sheet_row, cast(sheet_col as bigint) as sheet_col, text, number, stamp from rc
where text is not null or number is not null or stamp is not null
union all select {S.q(_M.sheet)}, 3, 2, null, null, timestamp '1995-06-30'"""


ORACLE["extract_report_cells"] = _cells_sql()
