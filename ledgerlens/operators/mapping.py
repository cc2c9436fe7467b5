"""Declarative column mapping (MAP-1..10, MAP-12, SRC-10, UDF-1, SNK-2).

The config (bounded: tens of items) is compiled on the driver into Column
expressions; the data never leaves the executors.  Source specs resolve per
file against the layout dimension (``grid.layout``) into a
``(source_file, col_idx, key)`` binding, the cells become records in one
conditional aggregation (``grid.to_records``), and the report columns are a
single ``select`` over those records.

Computed columns are arithmetic over variables written as text; the text is
compiled with a whitelist (numbers, variable names, + - * /, parentheses and
``_div(a, b)``) into ``try_divide`` / null-propagating Columns.  Nothing is
evaluated with ``eval``.
"""

from __future__ import annotations

import ast
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse_date_lenient, parse_number, valid_code
from . import grid

CONFIG_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "config")

# Report labels typed as numbers, percentages and dates (MAP-9).
NUMERIC_TARGETS = (
    "Notional", "Dirty Value", "Clean Value", "Accrued Interest", "Spread (bp)",
    "Dirty Value(%)", "Clean Value(%)", "Accrued Interest(%)",
)
PERCENT_TARGETS = ("Dirty Value(%)", "Clean Value(%)", "Accrued Interest(%)")
DATE_TARGETS = ("Start Date", "End Date")
CODE_SOURCE = "Custom Attribute5 Value"


def _norm(s: str) -> str:
    return " ".join(str(s).strip().lower().split())


def _type_key(label: str) -> str:
    # S4: compare with blanks before '(' removed, so "Dirty Value (%)" is a percentage
    return _norm(label).replace(" (", "(")


def target_kind(label: str) -> str:
    k = _type_key(label)
    if k in {_type_key(x) for x in NUMERIC_TARGETS} | {_type_key(x) for x in PERCENT_TARGETS}:
        return "number"
    if k in {_type_key(x) for x in DATE_TARGETS}:
        return "date"
    return "text"


@dataclass(frozen=True)
class Source:
    kind: str  # letter | name | leg | none
    value: str = ""
    leg: int = 1

    @property
    def key(self) -> str:
        if self.kind == "letter":
            return f"L:{self.value.upper()}"
        if self.kind == "name":
            return f"N:{_norm(self.value)}"
        if self.kind == "leg":
            return f"G:{_norm(self.value)}:{self.leg}"
        return ""


@dataclass
class Item:
    target: str
    occurrence: int = 1
    source: Source | None = None
    expr: str | None = None
    target_letter: str | None = None

    @property
    def column(self) -> str:
        return f"{self.target}#{self.occurrence}"


@dataclass
class Mapping:
    variables: dict[str, Source] = field(default_factory=dict)
    columns: list[Item] = field(default_factory=list)
    computed: list[Item] = field(default_factory=list)
    header_row: int = 6
    sheet: str = ""

    def sources(self) -> list[Source]:
        seen: dict[str, Source] = {}
        for s in [*self.variables.values(), *[i.source for i in self.columns if i.source]]:
            if s.kind != "none":
                seen.setdefault(s.key, s)
        seen.setdefault(Source("name", CODE_SOURCE).key, Source("name", CODE_SOURCE))
        return list(seen.values())


def load_cfg(text: str) -> dict:
    """SRC-10: YAML text -> mapping; empty -> {}; a non-mapping root is an error."""
    import yaml

    cfg = yaml.safe_load(text) or {}
    if not isinstance(cfg, dict):
        raise ValueError("mapping config: the root must be a mapping")
    return cfg


def shipped_config() -> dict:
    with open(os.path.join(CONFIG_DIR, "report_mapping.yaml"), encoding="utf-8") as fh:
        return load_cfg(fh.read())


def _source(spec: dict | None) -> Source:
    """MAP-4: precedence letter > name > leg; none -> null."""
    if not spec:
        return Source("none")
    if spec.get("source_letter"):
        return Source("letter", str(spec["source_letter"]).upper())
    if spec.get("source"):
        return Source("name", str(spec["source"]))
    if "source_leg" in spec and spec["source_leg"]:
        leg = spec["source_leg"]
        return Source("leg", str(leg.get("base", "")), int(leg.get("leg", 1)))
    return Source("none")


def compile_mapping(cfg: dict) -> Mapping:
    m = Mapping(header_row=int(cfg.get("header_row", 6)), sheet=str(cfg.get("sheet") or ""))
    for name, spec in (cfg.get("variables") or {}).items():
        m.variables[str(name)] = _source(spec)
    for it in cfg.get("columns") or []:
        m.columns.append(Item(str(it.get("target")), int(it.get("target_occurrence", 1)), _source(it),
                              target_letter=it.get("target_letter")))
    for it in cfg.get("computed") or []:
        m.computed.append(Item(str(it.get("target")), int(it.get("target_occurrence", 1)), expr=str(it.get("expr", "")),
                               target_letter=it.get("target_letter")))
    return m


# ------------------------------------------------------------------ expressions
class _Compiler(ast.NodeVisitor):
    def __init__(self, env: dict[str, Column]):
        self.env = env

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_BinOp(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return F.try_divide(a, b)
        raise ValueError(f"operator not allowed: {type(node.op).__name__}")

    def visit_UnaryOp(self, node):
        v = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -v
        if isinstance(node.op, ast.UAdd):
            return v
        raise ValueError("unary operator not allowed")

    def visit_Constant(self, node):
        if node.value is None:
            return F.lit(None).cast("double")
        if isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        raise ValueError("only numeric constants are allowed")

    def visit_Name(self, node):
        if node.id == "None":
            return F.lit(None).cast("double")
        if node.id not in self.env:
            raise KeyError(node.id)
        return self.env[node.id]

    def visit_Call(self, node):
        if isinstance(node.func, ast.Name) and node.func.id == "_div" and len(node.args) == 2 and not node.keywords:
            return F.try_divide(self.visit(node.args[0]), self.visit(node.args[1]))
        raise ValueError("only _div(a, b) may be called")

    def generic_visit(self, node):
        raise ValueError(f"syntax not allowed: {type(node).__name__}")


def compile_expr(text: str, env: dict[str, Column]) -> Column:
    """MAP-7 / UDF-1: formula text -> Column.  Any null operand, a zero
    divisor, an unknown name or a syntax outside the whitelist gives null
    (the reference returns None on any evaluation error)."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
        return _Compiler(env).visit(tree).cast("double")
    except (SyntaxError, ValueError, KeyError, TypeError):
        return F.lit(None).cast("double")


# ------------------------------------------------------------------ resolution
def source_binding(lay: DataFrame, mapping: Mapping) -> DataFrame:
    """MAP-1..3 + JN-12: per file, the column each source spec reads.

    letter -> the kept column at that position of the row's own file;
    name -> first column whose normalised label matches (per file, S8);
    leg -> first label starting with the base and containing ``(legN)``,
    else the base name.  Returns ``source_file, col_idx, name``.
    """
    spark = lay.sparkSession
    srcs = mapping.sources()
    rows = []
    for s in srcs:
        if s.kind == "letter":
            rows.append((s.key, "letter", s.value, None, None))
        elif s.kind == "name":
            rows.append((s.key, "name", None, _norm(s.value), None))
        elif s.kind == "leg":
            rows.append((s.key, "leg", None, _norm(s.value), f"(leg{s.leg})"))
    specs = F.broadcast(spark.createDataFrame(rows, "name string, kind string, letter string, base string, tag string"))
    by_letter = lay.join(specs.where(F.col("kind") == "letter"), "letter").select("source_file", "col_idx", "name")
    by_name = (
        lay.join(specs.where(F.col("kind").isin("name", "leg")), lay["label_norm"] == F.col("base"))
        .groupBy("source_file", "name").agg(F.min("col_idx").alias("col_idx"))
    )
    # "starts with base" as an equi-join: every prefix of a label is a row
    # (labels are short and the layout has files x columns rows)
    prefixes = lay.select(
        "source_file", "col_idx", "label_norm",
        F.explode(F.sequence(F.lit(1), F.greatest(F.length("label_norm"), F.lit(1)))).alias("_n"),
    ).withColumn("base", F.substring("label_norm", F.lit(1), F.col("_n")))
    by_leg = (
        prefixes.join(specs.where(F.col("kind") == "leg"), "base")
        .where(F.col("label_norm").contains(F.col("tag")))
        .groupBy("source_file", "name").agg(F.min("col_idx").alias("col_idx"))
    )
    leg_names = specs.where(F.col("kind") == "leg").select("name")
    plain_names = by_name.join(leg_names, "name", "left_anti")
    leg_fallback = by_name.join(leg_names, "name", "left_semi").join(by_leg, ["source_file", "name"], "left_anti")
    return (
        by_letter.unionByName(plain_names.select("source_file", "col_idx", "name"))
        .unionByName(by_leg.select("source_file", "col_idx", "name"))
        .unionByName(leg_fallback.select("source_file", "col_idx", "name"))
    )


def mapped_records(cells: DataFrame, headers: DataFrame, lay: DataFrame, mapping: Mapping, first: int | None = None) -> DataFrame:
    """Records with one text column per source key (plus ``ord``); with ``first``,
    those of the first rows in source order that hold a valid code, as many as a
    preview shows."""
    from ..session import materialize

    keys = [s.key for s in mapping.sources()]
    binding = materialize(source_binding(lay, mapping), "binding")
    if first is not None:
        cells = _first_rows(cells, binding, headers, first)
    return grid.to_records(cells, binding, headers, keys)


def _first_rows(cells: DataFrame, binding: DataFrame, headers: DataFrame, n: int) -> DataFrame:
    """The cells of the first ``n`` rows in source order with a valid code: records
    of the code columns alone tell these rows, then their cells are read (the columns'
    and rows' numbers are given to the reader; both are few)."""
    from ..session import materialize

    code = Source("name", CODE_SOURCE).key
    bound = binding.where(F.col("name") == code)
    at = [c for (c,) in bound.select("col_idx").distinct().collect()]
    codes = cells.where(F.col("col_idx").isin(at)).join(bound.select("source_file", "col_idx"), ["source_file", "col_idx"], "left_semi")
    records = grid.to_records(codes, bound, headers, [code]).where(valid_code(F.col(f"`{code}`")))
    rows = materialize(records.orderBy("ord").limit(n).select("source_file", "row_idx"), "first-rows")
    least, most = rows.agg(F.min("row_idx"), F.max("row_idx")).first()
    near = cells.where(F.col("row_idx").between(F.lit(least), F.lit(most)))
    return near.join(rows, ["source_file", "row_idx"], "left_semi")


def placed_records(records: DataFrame, slices: list[Column] | None, name: str = "sheet_row", start: int = 1) -> DataFrame:
    """SRT-5: the records with a valid code, with ``name`` = ``start`` + their place in
    source order, stored as the texts that were read; ``slices`` cut ``row_idx``
    (``grid.row_slices`` of the cells), and cells become records a slice at a time."""
    from .placement import sequential_index

    code = Source("name", CODE_SOURCE).key
    kept = records.where(valid_code(F.col(f"`{code}`"))).drop("ord")
    placed = sequential_index(kept, ["row_idx"], ["source_file"], name=name, start=start, slices=slices, restart=False)
    return placed.withColumn("ord", F.struct("source_file", "row_idx"))


def sheet_records(rows: DataFrame, headers: DataFrame, lay: DataFrame, mapping: Mapping) -> DataFrame:
    """GRD-9, GRD-20, GRD-21 on sheets in row form: one text column per source
    key, read by position from the row's ``values`` (plus ``ord`` and all columns
    of ``rows``).

    What a file lacks, or a row is too short for, is null.  The positions of a
    file are one array in a table with one row per file, stored so that Spark
    knows its size; body rows are projected where they are read."""
    from ..session import materialize

    keys = [s.key for s in mapping.sources()]
    bound = source_binding(lay, mapping).groupBy("source_file").agg(
        F.array(*[F.max(F.when(F.col("name") == k, F.col("col_idx"))) for k in keys]).alias("_places")
    )
    starts = headers.select("source_file", "body_start")
    places = materialize(starts.join(bound, "source_file", "left"), "places")
    j = rows.join(places, "source_file").where(F.col("row_idx") >= F.col("body_start"))
    return j.select(
        *rows.columns, *[F.get("values", F.get("_places", F.lit(i))).alias(k) for i, k in enumerate(keys)],
        F.struct("source_file", "row_idx").alias("ord"),
    )


def _cast_for_target(label: str, c: Column) -> Column:
    kind = target_kind(label)
    if kind == "number":
        return parse_number(c, "eu")
    if kind == "date":
        num = parse_number(c, "eu")
        return parse_date_lenient(c, num)
    return c


def template_index(template_header: list[str]) -> dict[tuple[str, int], int]:
    """GRD-14 on a template header row given as ordered labels."""
    idx: dict[tuple[str, int], int] = {}
    count: dict[str, int] = {}
    for pos, lab in enumerate(template_header):
        k = _norm(lab)
        if not k:
            continue
        count[k] = count.get(k, 0) + 1
        idx[(k, count[k])] = pos
    return idx


def apply_mapping(records: DataFrame, mapping: Mapping, template_header: list[str] | None = None,
                  preview: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[Item]]:
    """MAP-5..9 (+FLT-1): the mapped report rows.

    Rows need a valid code (FLT-1 on the ``Custom Attribute5 Value`` column).
    Variables are numbers (NUM-1); direct columns are cast by target label
    (MAP-9); computed columns are compiled formulas.  Items whose target is
    not in ``template_header`` (label, occurrence) are skipped and returned.
    In ``preview`` form the columns are ``var:*``, ``direct:T#k``, ``calc:T#k``;
    otherwise ``T#k`` in template order.  Columns of ``keep`` stay beside them.
    """
    code = F.col(f"`{Source('name', CODE_SOURCE).key}`")
    r = records.where(valid_code(code))
    env = {n: parse_number(F.col(f"`{s.key}`"), "eu") if s.kind != "none" else F.lit(None).cast("double")
           for n, s in mapping.variables.items()}
    index = template_index(template_header) if template_header is not None else None
    skipped: list[Item] = []
    out: list[tuple[int, str, Column]] = []

    def place(item: Item) -> int | None:
        if item.target_letter:
            return grid.letter_to_index_py(item.target_letter)
        if index is None:
            return len(out)
        return index.get((_norm(item.target), item.occurrence))

    for it in mapping.columns:
        pos = place(it)
        if pos is None and not preview:
            skipped.append(it)
            continue
        src = F.col(f"`{it.source.key}`") if it.source and it.source.kind != "none" else F.lit(None).cast("string")
        out.append((pos if pos is not None else 10_000 + len(out), ("direct:" if preview else "") + it.column,
                    _cast_for_target(it.target, src)))
    for it in mapping.computed:
        pos = place(it)
        if pos is None and not preview:
            skipped.append(it)
            continue
        out.append((pos if pos is not None else 10_000 + len(out), ("calc:" if preview else "") + it.column,
                    compile_expr(it.expr or "", env)))
    cols = [F.col("source_file"), F.col("row_idx"), code.alias("code_raw")]
    if preview:
        cols += [v.alias(f"var:{n}") for n, v in env.items()]
        cols += [c.alias(name) for _, name, c in out]
    else:
        cols += [c.alias(name) for _, name, c in sorted(out, key=lambda t: t[0])]
    return r.select(*cols, *keep, "ord"), skipped


def preview(mapped: DataFrame, limit: int = 200) -> DataFrame:
    """MAP-10 + SRT-4: the first rows in source order (a top-k, not a sort)."""
    return mapped.orderBy("ord").limit(limit).drop("ord")


def report_cells(report: DataFrame, template_header: list[str], header_row: int, run_date) -> DataFrame:
    """SNK-2: the mapped report in the sheet's long cell form.

    Report rows (in source order, ``ord``) are placed from ``header_row + 1``
    (1-based sheet rows) with no gaps (SRT-5, numbered without a
    single-partition window, unless ``placed_records`` gave them their
    ``sheet_row``); every ``target#k`` column goes to the position
    of the k-th ``target`` label of the template header; the run date goes to
    B3.  Values keep their type in one of three columns.
    """
    from .placement import sequential_index

    placed = report
    if "sheet_row" not in report.columns:
        placed = sequential_index(report, ["ord"], name="sheet_row", start=header_row + 1)
    dates = report.sparkSession.range(1).select(F.lit(run_date).cast("date").alias("run_date"))
    return cells_at(placed, report, template_header, dates)


def cells_at(placed: DataFrame, report: DataFrame, template_header: list[str], dates: DataFrame, sheet: str | None = None) -> DataFrame:
    """The cells of report rows that know their ``sheet_row``, and B3 from the
    ``run_date`` of ``dates``; with a ``sheet`` column where it is named."""
    index = template_index(template_header)
    fields = []
    for name in report.columns:
        if "#" not in name:
            continue
        label, occ = name.rsplit("#", 1)
        pos = index.get((_norm(label), int(occ)))
        if pos is None:
            continue
        dtype = dict(report.dtypes)[name]
        v = F.col(f"`{name}`")
        fields.append(F.struct(
            F.lit(pos + 1).alias("col"),
            (v if dtype == "string" else F.lit(None).cast("string")).alias("text"),
            (v.cast("double") if dtype in ("double", "float", "int", "bigint") else F.lit(None).cast("double")).alias("number"),
            (v.cast("timestamp_ntz") if dtype.startswith("timestamp") or dtype == "date" else F.lit(None).cast("timestamp_ntz")).alias("stamp"),
        ))
    cells = placed.select("sheet_row", F.explode(F.array(*fields)).alias("c")).select(
        F.col("sheet_row").cast("long").alias("sheet_row"), F.col("c.col").cast("long").alias("sheet_col"),
        "c.text", "c.number", "c.stamp",
    ).where(F.col("text").isNotNull() | F.col("number").isNotNull() | F.col("stamp").isNotNull())
    b3 = dates.select(F.lit(3).cast("long").alias("sheet_row"), F.lit(2).cast("long").alias("sheet_col"),
                      F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number"),
                      F.col("run_date").cast("timestamp_ntz").alias("stamp"))
    out = cells.unionByName(b3)
    return out if sheet is None else out.select(F.lit(sheet).alias("sheet"), *out.columns)
