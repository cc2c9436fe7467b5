"""Text rules as native Column expressions (STR-*, GRD-1, FLT-1 helpers).

Everything here is a Catalyst expression, so it stays inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.split()`` / ``str.strip()`` treat
# as blanks (tab, LF, VT, FF, CR, the four separators 0x1C-0x1F, space, NEL,
# no-break space and the Unicode space separators).  Written as one explicit
# class so Java regex and RE2 (the SQL oracle) read it the same way.
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NBSP = "\u00a0"
# The same characters as a plain string, for the regex-free functions
# (``btrim`` / ``translate`` are cheaper than regex replacement per row).
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Sentinel texts that do not count as a trade code (FLT-1).
INVALID_CODE_PATTERN = r"(?i)^(nan|none|null|na|n/?a|#n/?a|-|—)$"
BLANK_OR_INVALID_CODE_PATTERN = r"(?i)^(nan|none|null|na|n/?a|#n/?a|-|—)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the
    body uses it (a Column used n times is n copies of its expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove blanks (WS_CHARS) at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Python ``" ".join(s.split())``: every blank becomes a space, runs of
    spaces become one, ends are trimmed.  The regex only runs on strings
    that actually hold a double space."""
    t = F.translate(_c(c), WS_CHARS, " " * len(WS_CHARS))
    t = F.when(F.instr(t, "  ") > 0, F.regexp_replace(t, "  +", " ")).otherwise(t)
    return F.trim(t)


def clean_label(c) -> Column:
    """STR-1: trim, collapse whitespace, blank -> null."""
    return F.nullif(collapse_ws(c), F.lit(""))


def norm_label(c) -> Column:
    """GRD-1: trim, lower, collapse whitespace (blank stays '')."""
    return F.lower(collapse_ws(c))


def clean_str(c) -> Column:
    """STR-6: null-safe clean: null -> '', else stripped."""
    return F.coalesce(strip_ws(c), F.lit(""))


def code_prefix(c) -> Column:
    """STR-4: text before the first '/', stripped; null -> ''."""
    return strip_ws(F.substring_index(clean_str(c), "/", 1))


def code_text(c) -> Column:
    """Code as stored in the report: NBSP-insensitive, stripped text."""
    return strip_ws(F.replace(_c(c), F.lit(NBSP), F.lit(" ")))


def valid_code(c) -> Column:
    """FLT-1: not null, not blank after NBSP->space + strip, not a sentinel.

    The cleaned text is referenced once (blank is an alternative of the
    sentinel pattern), so a pushed-down filter evaluates it once per row.
    """
    return F.coalesce(~code_text(c).rlike(BLANK_OR_INVALID_CODE_PATTERN), F.lit(False))


def legacy_code_present(c) -> Column:
    """FLT-2: legacy filter, code not blank after trim (null is dropped, S6)."""
    return _c(c).isNotNull() & (strip_ws(c) != F.lit(""))


def header_norm(c) -> Column:
    """STR-3: header normaliser used for sensitivity sheets.

    Brackets and slashes become blanks, '%' gets a blank before it, then
    GRD-1 (lower, collapse).
    """
    s = F.regexp_replace(_c(c), r"[()/]", " ")
    s = F.regexp_replace(s, "%", " %")
    return norm_label(s)


def format_money(c) -> Column:
    """STR-7: amount text for the MtM summary.

    |v| >= 1e4 is shown in millions; one decimal, blank thousands separator,
    '- ' sign taken from the scaled value; null -> 'N/A'.
    """
    v = _c(c)
    scaled = F.when(F.abs(v) >= F.lit(1e4), v / F.lit(1_000_000.0)).otherwise(v)
    body = F.replace(F.format_number(F.abs(scaled), 1), F.lit(","), F.lit(" "))
    return F.when(v.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.when(scaled < 0, F.lit("- ")).otherwise(F.lit("")), body)
    )
