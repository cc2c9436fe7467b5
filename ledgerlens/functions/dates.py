"""Date rules (DATE-*), as Column expressions.

All parsing goes through ``try_to_date`` / ``try_to_timestamp`` behind shape
gates, so a bad value becomes null instead of failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .date_tokens import date_value
from .text import _c, strip_ws

# Fixed value: Excel's serial-date origin.
EXCEL_EPOCH = "1899-12-30"
# Fixed value: day count of a year in the year fraction.
DAYS_PER_YEAR = 365.25

_DMY_SLASH = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
_YMD_DASH = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_DMY_DASH = r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"


def excel_serial_to_date(c) -> Column:
    """DATE-1: Excel serial number -> date (origin 1899-12-30, fraction dropped)."""
    x = _c(c)
    days = F.floor(x).try_cast("int")
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), days)


def excel_serial_to_timestamp(c) -> Column:
    """DATE-1 (mapping path): serial number -> timestamp keeping the time of day."""
    x = _c(c)
    secs = F.round(x * F.lit(86400.0)).try_cast("long")
    base = F.lit(EXCEL_EPOCH + " 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", secs, base)


def _try_date(s: Column, gate: str, fmt: str) -> Column:
    return F.when(s.rlike(gate), F.try_to_date(s, fmt))


def parse_date_strict(c, serial=None) -> Column:
    """DATE-3: day/month/year, ISO or day-month-year text; a positive serial
    number (given as ``serial``) counts as an Excel date."""
    s = strip_ws(_c(c))
    text = F.coalesce(
        _try_date(s, _DMY_SLASH, "d/M/yyyy"),
        _try_date(s, _YMD_DASH, "yyyy-M-d"),
        _try_date(s, _DMY_DASH, "d-M-yyyy"),
    )
    if serial is None:
        return text
    num = _c(serial)
    return F.coalesce(F.when(num > 0, excel_serial_to_date(num)), text)


def parse_date_lenient(c, serial=None) -> Column:
    """DATE-2: native / serial (> 59) / day-first text, then month-first text.

    Returns a timestamp without time zone (the mapping path keeps the time of
    day).  The reference hands text to a free-form parser; here texts are read by
    their tokens (``date_tokens``), which also tells why a text is no date.
    """
    ts = date_value(c)
    if serial is None:
        return ts
    num = _c(serial)
    return F.coalesce(F.when(num > 59, excel_serial_to_timestamp(num)), ts)


def year_fraction(start, end) -> Column:
    """DATE-4: days / 365.25, negative -> 0, null if either date is null."""
    s, e = _c(start), _c(end)
    return F.when(
        s.isNotNull() & e.isNotNull(),
        F.greatest(F.datediff(e, s), F.lit(0)) / F.lit(DAYS_PER_YEAR),
    )


def next_business_day(c) -> Column:
    """DATE-5: next Monday-Friday day (no holiday calendar)."""
    d = _c(c)
    wd = F.weekday(d)  # Monday = 0
    step = F.when(wd == 4, 3).when(wd == 5, 2).otherwise(1)
    return F.date_add(d, step)


def date_from_name(c) -> Column:
    """DATE-6: first ``dd-mm-yyyy`` in a file name -> date, invalid -> null."""
    m = F.regexp_extract(_c(c), r"([0-9]{2})-([0-9]{2})-([0-9]{4})", 0)
    return F.when(m != "", F.try_to_date(m, "dd-MM-yyyy"))


def previous_quarter_end(c) -> Column:
    """DATE-7: first day of the month that ends the previous quarter."""
    return F.add_months(F.trunc(_c(c), "quarter"), -1)


# The date tags used in file and folder names (DATE-8).
DATE_TAGS = {
    "file_tag": "MMddyyyy",
    "year": "yyyy",
    "month_folder": "MM-yyyy",
    "iso": "yyyy-MM-dd",
    "display": "dd/MM/yyyy",
    "attachment": "dd-MM-yyyy",
}


def date_tag(c, kind: str) -> Column:
    """DATE-8: format a date as one of the tags above."""
    return F.date_format(_c(c), DATE_TAGS[kind])
