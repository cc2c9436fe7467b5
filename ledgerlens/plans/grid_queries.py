"""Queries over the cells binding G (GRD-*, MAP-*, SRT-4, DIM-3, DIM-5,
JN-12, CHK-1/2, UDF-1), with DuckDB oracles that run the same header
detection, layout and resolution rules in SQL on the same cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import norm_label
from ..operators import dims, grid, mapping
from ..sources import bindings as B
from ..sources.cells import BODY_START, HEADER_CELLS, IR1_POSITIONS
from ..sources.cells import cells as cells_binding
from . import bindings_sql as BS
from . import sqltext as S
from .catalog import register
from .oracle import ORACLE

# ------------------------------------------------------------------ shared Spark steps
_CACHE: dict = {}


def _grid(spark, sf_dir):
    """Cells, headers and layout of G (the cells are numbered once per session
    and state of the table's files: their row numbering checkpoints)."""
    files = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").agg(
        F.max("_metadata.file_modification_time"), F.count_distinct("_metadata.file_path"), F.count(F.lit(1))).first()
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, *files)
    if key not in _CACHE:
        c = cells_binding(spark, sf_dir)
        h, lay = grid.prepare(c, dims.expected_headers(spark))
        _CACHE.clear()
        _CACHE[key] = (c, h, lay)
    return _CACHE[key]


# ------------------------------------------------------------------ shared SQL steps
_EXPECTED = ", ".join(sorted({S.q(" ".join(h.strip().lower().split())) for h in dims.EXPECTED_HEADERS}))


def _norm(x: str) -> str:
    return S.norm_label(x)


def _letter(n: str) -> str:
    n1 = f"({n} + 1)"
    return (f"case when {n1} <= 26 then chr(64 + {n1}) "
            f"when {n1} <= 702 then concat(chr(64 + ({n1} - 1) // 26), chr(65 + ({n1} - 1) % 26)) "
            f"else concat(chr(65 + ({n1} - 27) // 676), chr(65 + (({n1} - 27) % 676) // 26), chr(65 + ({n1} - 27) % 26)) end")


_G_SQL = "with h as (select * from (values " + ",".join(
    f"({f},{r},{c},{S.q(v)})" for f, r, c, v in HEADER_CELLS
) + f""") v(f,row_idx,col_idx,value)),
b as (select l_suppkey%3 as f, row_number() over (partition by l_suppkey%3 order by {BS.ORD}) + {BODY_START - 1} as row_idx, l.* from lineitem l),
c as (select f,row_idx,0 as k,cast(l_orderkey as varchar) as value from b
 union all select f,row_idx,1,case when l_linenumber=7 then null else concat('SWAP_',cast(l_partkey as varchar)) end from b
 union all select f,row_idx,2,case l_partkey%4 when 0 then 'CMS Swap' when 1 then 'Real Rate Swap' when 2 then 'Cross Currency Swap' else 'Forward' end from b
 union all select f,row_idx,3,concat('Supplier#',cast(l_suppkey as varchar)) from b
 union all select f,row_idx,4,cast(cast(l_extendedprice as decimal(12,2)) as varchar) from b
 union all select f,row_idx,5,cast(cast(l_quantity as decimal(12,2)) as varchar) from b
 union all select f,row_idx,6,cast(cast(l_extendedprice as decimal(12,2))*cast(l_discount as decimal(4,2)) as varchar) from b),
g as (select concat('IR_',cast(f as varchar),'.xls') as source_file, cast(row_idx as integer) as row_idx, cast(col_idx as integer) as col_idx, value from h
 union all select concat('IR_',cast(f as varchar),'.xls'), cast(row_idx as integer),
  cast(case when f=1 then case k {' '.join(f'when {a} then {b}' for a, b in IR1_POSITIONS.items())} else k end else k end as integer), value
 from c where value is not null),
"""

_HEAD_SQL = _G_SQL + f"""hn as (select source_file, row_idx, {_norm(S.strip('value'))} as n from g where row_idx < 12),
sc as (select source_file, row_idx, count(*) filter (where n in ({_EXPECTED})) as score from hn group by 1, 2),
files as (select distinct source_file from g),
best as (select f.source_file, case when b.mx > 0 then b.br else 0 end as header_row from files f left join
  (select source_file, max(score) as mx, first(row_idx order by score desc, row_idx) as br from sc group by 1) b using (source_file)),
hl as (select g.source_file, g.col_idx,
  max(case when g.row_idx = best.header_row then {S.strip('value')} end) as upper,
  max(case when g.row_idx = best.header_row + 1 then {S.strip('value')} end) as lower
  from g join best using (source_file) where g.row_idx = best.header_row or g.row_idx = best.header_row + 1 group by 1, 2),
hl2 as (select *, coalesce(nullif(lower, ''), upper) as merged_label from hl),
hs as (select source_file, count(*) filter (where upper is not null and {_norm('upper')} in ({_EXPECTED})) as single_score,
  count(*) filter (where merged_label is not null and {_norm('merged_label')} in ({_EXPECTED})) as two_score from hl2 group by 1),
hd as (select best.source_file, header_row, coalesce(single_score, 0) as single_score, coalesce(two_score, 0) as two_score,
  coalesce(two_score, 0) > coalesce(single_score, 0) as merged,
  header_row + case when coalesce(two_score, 0) > coalesce(single_score, 0) then 2 else 1 end as body_start
  from best left join hs using (source_file)),
bc as (select distinct g.source_file, g.col_idx from g join hd using (source_file) where g.row_idx >= hd.body_start),
lb as (select bc.source_file, bc.col_idx, case when hd.merged then hl2.merged_label else hl2.upper end as raw
  from bc join hd using (source_file) left join hl2 on hl2.source_file = bc.source_file and hl2.col_idx = bc.col_idx),
lb2 as (select source_file, col_idx, case when starts_with(coalesce(raw, ''), 'Unnamed') then '' else coalesce(raw, '') end as base from lb),
lb3 as (select *, regexp_extract(base, '^(.*)\\.([0-9]+)$', 2) as dn, regexp_extract(base, '^(.*)\\.([0-9]+)$', 1) as db,
  row_number() over (partition by source_file, base, regexp_extract(base, '^(.*)\\.([0-9]+)$', 2) <> '' order by col_idx) as occ from lb2),
lay0 as (select source_file, col_idx,
  case when dn <> '' then concat(db, ' (Leg', cast(cast(dn as bigint) + 1 as varchar), ')')
   when occ = 1 then base else concat(base, ' (Leg', cast(occ as varchar), ')') end as label from lb3),
lay as (select source_file, col_idx, {_letter('col_idx')} as letter, label, {_norm('label')} as label_norm from lay0)
"""


# ------------------------------------------------------------------ header detection and layout
@register
def header_detect(spark, sf_dir):
    """GRD-1, GRD-2, GRD-3, GRD-4, DIM-3, SRC-5: header row of each file
    (cells table written as parquet and scanned back), scores, two-row merge
    and first body row."""
    return _grid(spark, sf_dir)[1]


ORACLE["header_detect"] = _HEAD_SQL + "select source_file, header_row, single_score, two_score, merged, body_start from hd"


@register
def header_labels(spark, sf_dir):
    """GRD-4, GRD-8, GRD-10, GRD-11, GRD-12: column layout per file (kept
    positions, letters, labels with duplicates suffixed)."""
    return _grid(spark, sf_dir)[2]


ORACLE["header_labels"] = _HEAD_SQL + "select * from lay"


@register
def header_lookup(spark, sf_dir):
    """GRD-5, GRD-6, GRD-7, STR-3: label-driven header lookups per file
    ('Class' cell row-major in 12 rows; 'code di'/'code' row, default 3;
    'Counterparty' in column D over the whole sheet, default 1)."""
    c = _grid(spark, sf_dir)[0]
    cls = grid.find_header_cell(c, "Class")
    code = grid.find_label_row(c, ["code di", "code"], search_rows=12, default=3)
    cp = grid.find_label_row(c, ["Counterparty"], search_rows=None, col_idx=3, default=1, normaliser=norm_label)
    return (
        code.withColumnRenamed("row_idx", "code_row")
        .join(cp.withColumnRenamed("row_idx", "cpty_row"), "source_file")
        .join(cls.select("source_file", F.col("row_idx").alias("class_row"), F.col("col_idx").alias("class_col")),
              "source_file", "left")
    )


_HN = S.norm_label(f"replace(replace(replace(replace({S.norm_label('value')}, '(', ' '), ')', ' '), '/', ' '), '%', ' %')")
ORACLE["header_lookup"] = _HEAD_SQL + f""",
cls as (select source_file, first(row_idx order by row_idx, col_idx) as class_row, first(col_idx order by row_idx, col_idx) as class_col
  from g where row_idx < 12 and {_norm('value')} = 'class' group by 1),
cd as (select source_file, min(row_idx) as r from g where row_idx < 12 and {_HN} in ('code di', 'code') group by 1),
cp as (select source_file, min(row_idx) as r from g where col_idx = 3 and {_norm('value')} = 'counterparty' group by 1)
select f.source_file, coalesce(cd.r, 3) as code_row, coalesce(cp.r, 1) as cpty_row, cls.class_row, cls.class_col
from files f left join cd using (source_file) left join cp using (source_file) left join cls using (source_file)"""


@register
def header_occurrence(spark, sf_dir):
    """GRD-14: normalised header label -> k-th position on each file's header row."""
    c, h, _ = _grid(spark, sf_dir)
    return grid.header_occurrences(c, h.select("source_file", F.col("header_row").alias("row_idx")))


ORACLE["header_occurrence"] = _HEAD_SQL + f""",
ho as (select g.source_file, {_norm('g.value')} as label_norm, g.col_idx from g join hd on g.source_file = hd.source_file and g.row_idx = hd.header_row)
select source_file, label_norm, row_number() over (partition by source_file, label_norm order by col_idx) as occurrence, col_idx
from ho where label_norm <> ''"""


@register
def header_map_first(spark, sf_dir):
    """GRD-15, GRD-16, STR-3: first-wins header map (punctuation-normalised)
    and the logical 'code' column via its alias list."""
    c, h, _ = _grid(spark, sf_dir)
    hm = grid.first_wins_map(c, h.select("source_file", F.col("header_row").alias("row_idx")))
    code = grid.column_for(hm, ["code di", "code", "custom attribute5 value"])
    return hm.join(code.withColumnRenamed("col_idx", "code_col"), "source_file", "left")


ORACLE["header_map_first"] = _HEAD_SQL + f""",
hm as (select g.source_file, {_HN} as key, min(g.col_idx) as col_idx from g join hd on g.source_file = hd.source_file and g.row_idx = hd.header_row
  where {_HN} <> '' group by 1, 2),
cc as (select source_file, first(col_idx order by case key when 'code di' then 0 when 'code' then 1 else 2 end) as code_col
  from hm where key in ('code di', 'code', 'custom attribute5 value') group by 1)
select hm.source_file, hm.key, hm.col_idx, cc.code_col from hm left join cc using (source_file)"""


@register
def letter_index(spark, sf_dir):
    """GRD-12: column index <-> Excel letters over every lineitem row
    (positions up to XFD) and back."""
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    pos = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 16384).cast("int")
    x = li.select("l_orderkey", "l_linenumber", pos.alias("col_idx"))
    x = x.withColumn("letter", grid.letter_of("col_idx"))
    return x.withColumn("index_back", grid.index_of("letter"))


ORACLE["letter_index"] = f"""select l_orderkey, l_linenumber, col_idx, letter,
 (case length(letter) when 1 then ascii(letter) - 64
   when 2 then (ascii(substr(letter, 1, 1)) - 64) * 26 + ascii(substr(letter, 2, 1)) - 64
   else ((ascii(substr(letter, 1, 1)) - 64) * 26 + ascii(substr(letter, 2, 1)) - 64) * 26 + ascii(substr(letter, 3, 1)) - 64 end) - 1 as index_back
from (select l_orderkey, l_linenumber, col_idx, {_letter('col_idx')} as letter
 from (select l_orderkey, l_linenumber, cast((l_orderkey * 7 + l_linenumber) % 16384 as integer) as col_idx from lineitem) a) b"""


# Logical columns of a dealer extract, and the required ones.
LOGICAL = ("Custom Attribute5 Value", "Class", "#Ticket", "Trade ID", "External Id", "Counterparty", "Currency")
REQUIRED = ("Custom Attribute5 Value", "Class")


@register
def resolve_columns(spark, sf_dir):
    """GRD-13, CHK-1, CHK-2: per file, the column of each logical name
    (null when absent) and whether it is required and missing."""
    lay = _grid(spark, sf_dir)[2]
    r = grid.resolve_by_name(lay, LOGICAL)
    return r.withColumn("missing_required", F.col("col_idx").isNull() & F.col("name").isin(*REQUIRED))


ORACLE["resolve_columns"] = _HEAD_SQL + f""",
names as (select * from (values {', '.join(f'({S.q(n)}, {S.q(" ".join(n.lower().split()))})' for n in LOGICAL)}) v(name, nn)),
pairs as (select f.source_file, n.name, n.nn from (select distinct source_file from lay) f cross join names n)
select p.source_file, p.name, (select min(col_idx) from lay where lay.source_file = p.source_file and lay.label_norm = p.nn) as col_idx,
 (select min(col_idx) from lay where lay.source_file = p.source_file and lay.label_norm = p.nn) is null
  and p.name in ({', '.join(S.q(n) for n in REQUIRED)}) as missing_required
from pairs p"""


@register
def leg_columns(spark, sf_dir):
    """GRD-17, GRD-18: leg-1 / leg-2 / total columns of 'Notional' and 'Dirty Value'."""
    lay = _grid(spark, sf_dir)[2]
    return grid.leg_columns(lay, "Notional").unionByName(grid.leg_columns(lay, "Dirty Value"))


def _tok(x: str) -> str:
    parts = []
    for tok, subs in grid.LEG_TOKENS:
        cond = " or ".join(f"contains({x}, {S.q(s)})" for s in subs)
        parts.append(f"when {cond} then {S.q(tok)}")
    return "case " + " ".join(parts) + " else '' end"


def _legs_sql(base: str) -> str:
    t = " ".join(base.lower().split())
    return f"""select source_file, {S.q(base)} as base,
  coalesce(l1, case when l1 is null and l2 is null and tt is null and np = 1 then pl end) as leg1, l2 as leg2,
  coalesce(tt, case when l1 is not null or l2 is not null then pl end) as total
 from (select source_file,
  first(label order by col_idx) filter (where tok = '1') as l1, first(label order by col_idx) filter (where tok = '2') as l2,
  first(label order by col_idx) filter (where tok = 'total') as tt, first(label order by col_idx) filter (where tok = '') as pl,
  count(*) filter (where tok = '') as np
  from (select *, {_tok('label_norm')} as tok from lay where starts_with(label_norm, {S.q(t)})) c group by source_file) x"""


ORACLE["leg_columns"] = _HEAD_SQL + f"{_legs_sql('Notional')} union all {_legs_sql('Dirty Value')}"


# ------------------------------------------------------------------ records
_REC_NAMES = {"ticket": ("name", "#Ticket"), "code": ("name", "Custom Attribute5 Value"), "class": ("name", "Class"),
              "cpty": ("name", "Counterparty"), "notional": ("letter", "E"), "notional_leg2": ("leg", "Notional"),
              "dirty": ("name", "Dirty Value"), "currency": ("name", "Currency")}


def _record_mapping() -> mapping.Mapping:
    cfg = {"columns": [
        {"target": k, **({"source": v} if kind == "name" else {"source_letter": v} if kind == "letter"
                         else {"source_leg": {"base": v, "leg": 2}})}
        for k, (kind, v) in _REC_NAMES.items()
    ]}
    return mapping.compile_mapping(cfg)


@register
def grid_to_records(spark, sf_dir):
    """GRD-9, GRD-20, GRD-21, MAP-1, MAP-2, MAP-3, JN-12: cells -> one record
    per body row, columns found per file by name, letter or leg."""
    c, h, lay = _grid(spark, sf_dir)
    m = _record_mapping()
    rec = mapping.mapped_records(c, h, lay, m)
    return rec.select("source_file", "row_idx", *[F.col(f"`{it.source.key}`").alias(it.target) for it in m.columns])


def _bind_sql(kind: str, v: str) -> str:
    if kind == "name":
        return f"(select min(col_idx) from lay where lay.source_file = r.source_file and lay.label_norm = {S.q(' '.join(v.lower().split()))})"
    if kind == "letter":
        return f"(select min(col_idx) from lay where lay.source_file = r.source_file and lay.letter = {S.q(v)})"
    t = " ".join(v.lower().split())
    return (f"coalesce((select min(col_idx) from lay where lay.source_file = r.source_file and starts_with(lay.label_norm, {S.q(t)}) "
            f"and contains(lay.label_norm, '(leg2)')), (select min(col_idx) from lay where lay.source_file = r.source_file and lay.label_norm = {S.q(t)}))")


_REC_SQL = _HEAD_SQL + f""",
rows_ as (select distinct g.source_file, g.row_idx from g join hd using (source_file) where g.row_idx >= hd.body_start),
bind as (select r.source_file, r.row_idx, {', '.join(f'{_bind_sql(kind, v)} as p_{k}' for k, (kind, v) in _REC_NAMES.items())} from rows_ r),
rec as (select b.source_file, b.row_idx, {', '.join(f'(select value from g where g.source_file = b.source_file and g.row_idx = b.row_idx and g.col_idx = b.p_{k}) as "{k}"' for k in _REC_NAMES)}
  from bind b)
"""

ORACLE["grid_to_records"] = _REC_SQL + "select * from rec"


@register
def stop_at_blank(spark, sf_dir):
    """GRD-19: per file, the first row without a code (from the first body
    row) and the number of rows kept before it."""
    c, h, lay = _grid(spark, sf_dir)
    m = _record_mapping()
    rec = mapping.mapped_records(c, h, lay, m).withColumnRenamed(m.columns[1].source.key, "code")
    start = h.select("source_file", F.col("body_start").alias("start_row"))
    kept = grid.stop_at_blank(rec.select("source_file", "row_idx", "code"), "code", start)
    per = kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_kept"), F.max("row_idx").alias("last_kept"))
    return start.join(per, "source_file", "left").fillna(0, ["n_kept"])


ORACLE["stop_at_blank"] = _REC_SQL + f""",
st as (select source_file, body_start as start_row from hd),
keyed as (select distinct source_file, row_idx from rec join st using (source_file) where row_idx >= start_row and code is not null and {S.strip('code')} <> ''),
cand as (select source_file, row_idx + 1 as r from keyed k where not exists (select 1 from keyed k2 where k2.source_file = k.source_file and k2.row_idx = k.row_idx + 1)
  union all select source_file, start_row from st where not exists (select 1 from keyed k where k.source_file = st.source_file and k.row_idx = st.start_row)),
cut as (select source_file, min(r) as cut_row from cand group by 1),
kept as (select rec.source_file, rec.row_idx from rec join st using (source_file) left join cut using (source_file)
  where rec.row_idx >= st.start_row and rec.row_idx < coalesce(cut.cut_row, 2147483647))
select st.source_file, st.start_row, coalesce(count(kept.row_idx), 0) as n_kept, max(kept.row_idx) as last_kept
from st left join kept using (source_file) group by st.source_file, st.start_row"""
