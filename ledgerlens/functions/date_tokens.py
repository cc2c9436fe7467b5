"""DATE-2: free-form date texts read by tokens instead of a list of formats.

The time of day is cut out first; what is left falls into numbers and words.
Words are month names (weekday names and ordinal endings drop out); numbers are
told apart by range and place: four digits or more than 31 is the year, a year
in front makes year, month, day, otherwise the day comes first and month first
is tried where that is no date.  A text that cannot be read says why.

Each step is bound before the next one uses it (``let``): the text is cut, split
and read once, however often the rules below look at its parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, let, strip_ws

# English month and weekday names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_TIME = r"(?:^|[ t])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)?(?: *(am|pm))?(?: *(?:z|utc))?$"
_ALLOWED = r"^[0-9a-z /.,-]*$"
_DAY_FIRST = r"^[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}\z"
_YEAR_FIRST = r"^[0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2}\z"
_TWO_NUMBERS = r"^[0-9]+[/.,-][0-9]+\z"
_MONTH_WORDS = {w: i for i, name in enumerate(MONTHS, 1) for w in (name, name[:3], "sept" if i == 9 else name)}


def _month(word: Column) -> Column:
    """1..12 of a month name, its first three letters or ``sept``; else null."""
    names = F.create_map(*[F.lit(x) for pair in _MONTH_WORDS.items() for x in pair])
    return F.try_element_at(names, word)


def _year(digits: Column) -> Column:
    """A year of four digits; two digits are 2000 to 2099."""
    n = digits.try_cast("int")
    return F.when(F.length(digits) == 4, n).when((F.length(digits) <= 2) & (n >= 0), n + 2000)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers; null where one is null or there is no such day."""
    at = F.date_add(F.make_date(year, month, F.lit(1)), day - 1)
    ranges = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(ranges, F.when(F.month(at) == month, at))


def _cut_time(s: Column) -> Column:
    """The text without its time of day, and the parts of the time."""
    timed = F.contains(s, F.lit(":"))
    part = lambda i: F.when(timed, F.regexp_extract(s, _TIME, i)).otherwise("")
    return F.struct(
        s.alias("s"), F.when(timed, F.regexp_replace(s, _TIME, "")).otherwise(s).alias("rest"),
        *[part(i).alias(n) for i, n in enumerate(("hour", "minute", "second", "half"), 1)],
    )


def _cut_words(rest: Column) -> Column:
    """The text without ordinal endings and weekday names, eight digits split up."""
    plain = F.regexp_replace(rest, r"(?<=[0-9])(?:st|nd|rd|th)\b", "")
    plain = F.regexp_replace(plain, r"\b(?:" + "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS) + r")\b[.,]?", "")
    rest = F.when(rest.rlike("[a-z]"), plain).otherwise(rest)
    return let(rest, lambda r: F.when(
        r.rlike(r"^ *[0-9]{8} *$"), F.regexp_replace(r, r"([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3")).otherwise(r))


def _parts(rest: Column) -> Column:
    """Numbers and words of the text: their counts, the month word and three numbers."""
    def split(tokens: Column) -> Column:
        return F.struct(F.filter(tokens, lambda t: t < "a").alias("numbers"), F.filter(tokens, lambda t: t >= "a").alias("words"))

    def counted(x: Column) -> Column:
        numbers, words = x["numbers"], x["words"]
        return F.struct(
            F.size(numbers).alias("n"), F.size(words).alias("w"), _month(F.get(words, F.lit(0))).alias("named"),
            *[F.get(numbers, F.lit(i)).alias(k) for i, k in enumerate("abd")],
        )

    return let(let(F.regexp_extract_all(rest, F.lit("([0-9]+|[a-z]+)"), 1), split), counted)


def _day(p: Column) -> Column:
    """The date that the numbers and the month word of a text mean."""
    n, w, named, a, b, d = [p[k] for k in ("n", "w", "named", "a", "b", "d")]
    first_is_year = (F.length(a) >= 3) | (a.try_cast("int") > 31)
    num = lambda x: F.when(F.length(x) <= 2, x.try_cast("int"))
    one = F.lit(1)
    return (
        F.when((w == 1) & (n == 2), F.when(first_is_year, _date(_year(a), named, num(b))).otherwise(_date(_year(b), named, num(a))))
        .when((w == 1) & (n == 1), F.when(F.length(a) == 4, _date(_year(a), named, one)))
        .when((w == 0) & (n == 3) & first_is_year, _date(_year(a), num(b), num(d)))
        .when((w == 0) & (n == 3), F.coalesce(_date(_year(d), num(b), num(a)), _date(_year(d), num(a), num(b))))
        .when((w == 0) & (n == 2), F.when(first_is_year, _date(_year(a), num(b), one)).when(F.length(b) == 4, _date(_year(b), num(a), one)))
    )


def _at_time(day: Column, t: Column) -> Column:
    """A date at the time of day of ``_cut_time``; null where there is no such time."""
    h, half = t["hour"].try_cast("int"), t["half"]
    h = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
    minute, second = t["minute"].try_cast("int"), F.when(t["second"] == "", 0).otherwise(t["second"].try_cast("int"))
    clock = F.when((h < 24) & (minute < 60) & (second < 60), F.timestamp_add("SECOND", h * 3600 + minute * 60 + second, day.cast("timestamp_ntz")))
    return F.when(t["hour"] == "", day.cast("timestamp_ntz")).otherwise(clock)


def read_date(c) -> Column:
    """struct(value timestamp_ntz, reason): the date and time of a text, or a null
    value and the reason; both are null for a null text."""
    def words(t: Column) -> Column:
        return F.struct(t.alias("t"), _cut_words(t["rest"]).alias("rest"))

    def parts(x: Column) -> Column:
        return F.struct(x["t"].alias("t"), x["rest"].alias("rest"), _parts(x["rest"]).alias("p"))

    def dated(x: Column) -> Column:
        return F.struct(x["t"].alias("t"), x["rest"].alias("rest"), x["p"].alias("p"), _day(x["p"]).alias("day"))

    def valued(x: Column) -> Column:
        return F.struct(x["t"]["s"].alias("s"), x["rest"].alias("rest"), x["p"].alias("p"), _at_time(x["day"], x["t"]).alias("value"))

    def judged(x: Column) -> Column:
        n, w = x["p"]["n"], x["p"]["w"]
        reason = (
            F.when(x["s"] == "", "blank")
            .when(~x["rest"].rlike(_ALLOWED), "unknown character")
            .when((w > 1) | ((w == 1) & x["p"]["named"].isNull()), "unknown word")
            .when((n + w) < 2, "too few parts")
            .when((n + w) > 3, "too many parts")
            .when(x["value"].isNull(), "no such date")
        )
        return F.struct(x["s"].alias("s"), x["value"].alias("value"), reason.alias("reason"))

    def told(r: Column) -> Column:
        return F.when(r["s"].isNotNull(), F.struct(F.when(r["reason"].isNull(), r["value"]).alias("value"), r["reason"].alias("reason")))

    out = F.lower(strip_ws(_c(c)))
    for step in (_cut_time, words, parts, dated, valued, judged, told):
        out = let(out, step)
    return out


def date_value(c) -> Column:
    """The value of ``read_date``: numbers of a fixed width are cut out where they
    stand and two numbers (as plain amounts have) at their separator, any other text
    is read by its tokens."""
    s = _c(c)
    at = lambda i, n: F.substring(s, i, n).try_cast("int")
    a, b, year = at(1, 2), at(4, 2), at(7, 4)
    day_first = F.coalesce(_date(year, b, a), _date(year, a, b))
    dotted = F.translate(s, "/,-", "...")
    two = {"n": F.lit(2), "w": F.lit(0), "named": F.lit(None).cast("int"), "d": F.lit(None).cast("string"),
           "a": F.substring_index(dotted, ".", 1), "b": F.substring_index(dotted, ".", -1)}
    return (
        F.when(s.rlike(_DAY_FIRST), day_first.cast("timestamp_ntz"))
        .when(s.rlike(_YEAR_FIRST), _date(at(1, 4), at(6, 2), at(9, 2)).cast("timestamp_ntz"))
        .when(s.rlike(_TWO_NUMBERS), _day(two).cast("timestamp_ntz"))
        .otherwise(read_date(s)["value"])
    )
