"""Number parsing and null-aware arithmetic (NUM-*), as Column expressions.

Three text dialects exist in the inputs (S11) and are kept apart:

* ``eu``     (NUM-1): strip, NBSP -> blank, drop blanks and apostrophes,
  decimal comma -> point.
* ``mixed``  (NUM-2): drop NBSP and blanks; exactly one comma and no point
  means decimal comma, otherwise commas are thousands separators.
* ``legacy`` (NUM-3): strip, drop blanks, comma -> point.

A gate regex admits only plain decimal / exponent notation before
``try_cast``: Spark would otherwise accept ``1d``, ``1F``, ``inf`` or ``nan``
(Python's ``float`` also accepts the last two; we return null for them, S12).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NBSP, _c, strip_ws

NUMBER_GATE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# A number without blanks and thousands separators: every dialect reads it alike.
PLAIN_NUMBER = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?\z"


def _gated_double(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_GATE), s.try_cast("double"))


def parse_number(c, dialect: str = "eu") -> Column:
    """NUM-1 / NUM-2 / NUM-3: text -> double, unparseable -> null.

    Numeric input columns are passed through as doubles (the reference's
    ``isinstance(value, (int, float))`` branch), with NaN turned into null (S1).
    Only texts that are no plain number are cleaned first.
    """
    col = _c(c)
    if dialect == "eu":
        s = F.replace(strip_ws(col), F.lit(NBSP), F.lit(" "))
        s = F.translate(s, " '", "")
        s = F.replace(s, F.lit(","), F.lit("."))
    elif dialect == "mixed":
        s = strip_ws(F.translate(col, NBSP + " ", ""))
        n_comma = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
        has_point = F.instr(s, ".") > 0
        s = F.when((n_comma == 1) & ~has_point, F.replace(s, F.lit(","), F.lit("."))).otherwise(
            F.replace(s, F.lit(","), F.lit(""))
        )
    elif dialect == "legacy":
        s = F.translate(strip_ws(col), " ", "")
        s = F.replace(s, F.lit(","), F.lit("."))
    else:
        raise ValueError(f"unknown number dialect: {dialect}")
    plain = F.replace(col, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(col.rlike(PLAIN_NUMBER), plain).otherwise(_gated_double(s))


def sub_optional(a, b) -> Column:
    """NUM-4: a - b, null only if both are null, a missing side counts as 0."""
    a, b = _c(a), _c(b)
    # lit(0) keeps the input type (exact decimals stay decimals)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def div_optional(n, d) -> Column:
    """NUM-5: n / d, null if either is null or d == 0 (never raises)."""
    return F.try_divide(_c(n), _c(d))


def mul(a, b) -> Column:
    """NUM-6: null-propagating product."""
    return _c(a) * _c(b)


def sum_optional(*cols) -> Column:
    """NUM-7: sum of the non-null values, null if all are null."""
    cs = [_c(c) for c in cols]
    total = F.coalesce(cs[0], F.lit(0))
    for c in cs[1:]:
        total = total + F.coalesce(c, F.lit(0))
    return F.when(F.coalesce(*cs).isNotNull(), total)


def total_or_legs(total, leg1, leg2) -> Column:
    """NUM-8: given total, else sum of the non-null legs."""
    return F.coalesce(_c(total), sum_optional(leg1, leg2))


def pct_change(old, new) -> Column:
    """NUM-10: (new - old) / old * 100, null when |old| <= 1e-12."""
    old, new = _c(old), _c(new)
    return F.when(F.abs(old) > F.lit(1e-12), (new - old) / old * F.lit(100.0))


def normalize_book(c) -> Column:
    """STR-5: integral number -> integer text, other number -> number text,
    blank / 'nan' -> null, other text -> stripped text."""
    col = _c(c)
    num = parse_number(col, "eu")
    integral = num.try_cast("decimal(38,0)").try_cast("string")
    as_number = F.when(num == F.floor(num), integral).otherwise(num.cast("string"))
    text = strip_ws(col)
    as_text = F.when((text == "") | (F.lower(text) == "nan"), F.lit(None).cast("string")).otherwise(text)
    return F.when(num.isNotNull(), as_number).otherwise(as_text)
