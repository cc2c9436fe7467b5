"""SQL text builders for the DuckDB oracles.

Each helper renders the same rule as the Column function of the same name in
``ledgerlens.functions``, written independently in portable SQL so the
oracle checks the Spark plan rather than sharing code with it.
"""

from __future__ import annotations

from ..functions.numbers import NUMBER_GATE
from ..functions.text import INVALID_CODE_PATTERN, WS_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(WS_CLASS + '+')}, ' ', 'g')")


def clean_label(x: str) -> str:
    return f"nullif({collapse(x)}, '')"


def norm_label(x: str) -> str:
    return f"lower({collapse(x)})"


def code_text(x: str) -> str:
    return strip(f"replace({x}, chr(160), ' ')")


def valid_code(x: str) -> str:
    s = code_text(x)
    pat = INVALID_CODE_PATTERN.replace("^", "").replace("$", "")
    return f"({x} is not null and {s} <> '' and not regexp_full_match({s}, {q(pat)}))"


def code_prefix(x: str) -> str:
    return strip(f"split_part(coalesce({strip(x)}, ''), '/', 1)")


def gated_double(s: str) -> str:
    return f"case when regexp_matches({s}, {q(NUMBER_GATE)}) then try_cast({s} as double) end"


def parse_eu(x: str) -> str:
    s = f"replace(replace(replace(replace({strip(x)}, chr(160), ' '), ' ', ''), '''', ''), ',', '.')"
    return gated_double(s)


def parse_mixed(x: str) -> str:
    s = strip(f"replace(replace({x}, chr(160), ''), ' ', '')")
    conv = (
        f"case when length({s}) - length(replace({s}, ',', '')) = 1 and strpos({s}, '.') = 0 "
        f"then replace({s}, ',', '.') else replace({s}, ',', '') end"
    )
    return gated_double(conv)


def parse_legacy(x: str) -> str:
    s = f"replace(replace({strip(x)}, ' ', ''), ',', '.')"
    return gated_double(s)


def sub_opt(a: str, b: str) -> str:
    return f"case when {a} is not null or {b} is not null then coalesce({a}, 0) - coalesce({b}, 0) end"


def div_opt(n: str, d: str) -> str:
    return f"({n}) / nullif({d}, 0)"


def year_fraction(s: str, e: str) -> str:
    return f"case when {s} is not null and {e} is not null then cast(greatest(date_diff('day', {s}, {e}), 0) as double) / 365.25 end"


def format_money(v: str) -> str:
    scaled = f"(case when abs({v}) >= 1e4 then {v} / 1000000.0 else {v} end)"
    body = f"replace(format('{{:,.1f}}', abs({scaled})), ',', ' ')"
    return f"case when {v} is null then 'N/A' else concat(case when {scaled} < 0 then '- ' else '' end, {body}) end"
