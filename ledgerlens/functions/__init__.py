"""Scalar rules (NUM-*, DATE-*, STR-*) as native Spark Column expressions."""

from .dates import (
    date_from_name,
    date_tag,
    excel_serial_to_date,
    excel_serial_to_timestamp,
    next_business_day,
    parse_date_lenient,
    parse_date_strict,
    previous_quarter_end,
    year_fraction,
)
from .numbers import (
    div_optional,
    mul,
    normalize_book,
    parse_number,
    pct_change,
    sub_optional,
    sum_optional,
    total_or_legs,
)
from .text import (
    clean_label,
    clean_str,
    code_prefix,
    code_text,
    collapse_ws,
    format_money,
    header_norm,
    legacy_code_present,
    norm_label,
    strip_ws,
    valid_code,
)

__all__ = [n for n in dir() if not n.startswith("_")]
