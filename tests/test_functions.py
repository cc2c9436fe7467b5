"""Scalar rules: literal cases of FIXTURES.md section B (B1-B5, B11, B12)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows
from ledgerlens.functions import (
    clean_label, code_prefix, date_from_name, excel_serial_to_date, format_money, next_business_day,
    normalize_book, parse_date_lenient, parse_date_strict, parse_number, pct_change, previous_quarter_end,
    sub_optional, div_optional, sum_optional, valid_code, year_fraction,
)

NB = " "

B1 = [
    ("1 234,56", 1234.56, 1234.56), (f"1{NB}234", 1234.0, 1234.0), ("1,234.56", None, 1234.56),
    ("1.234,56", None, 1.23456), ("1,234,567", None, 1234567.0), ("1'234.5", 1234.5, None), ("-0,98", -0.98, -0.98),
    ("12%", None, None), ("", None, None), ("abc", None, None), ("1e3", 1000.0, 1000.0), (".5", 0.5, 0.5),
    ("5.", 5.0, 5.0), ("nan", None, None), ("inf", None, None), ("1d", None, None), (None, None, None),
]


def test_b1_number_dialects(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in B1], "t string")
    got = rows(df.select("t", parse_number("t", "eu"), parse_number("t", "mixed")))
    assert got == [(t, eu, mixed) for t, eu, mixed in B1]


def test_legacy_dialect(spark):
    df = spark.createDataFrame([("1 234,5",), (" 7 ",), ("1'2",)], "t string")
    assert [r[0] for r in rows(df.select(parse_number("t", "legacy")))] == [1234.5, 7.0, None]


def test_b2_optional_arithmetic(spark):
    df = spark.createDataFrame([(None, None), (None, 3.0), (5.0, None), (1.0, 0.0), (None, 2.0)], "a double, b double")
    got = rows(df.select(sub_optional("a", "b"), div_optional("a", "b"), sum_optional("a", "b")))
    assert got == [(None, None, None), (-3.0, None, 3.0), (5.0, None, 5.0), (1.0, None, 1.0), (-2.0, None, 2.0)]


def test_b3_dates(spark):
    df = spark.createDataFrame([("19/09/2025",), ("2025-09-19",), ("19-09-2025",), ("09/19/2025",)], "t string")
    assert [r[0] for r in rows(df.select(parse_date_strict("t")))] == [dt.date(2025, 9, 19)] * 3 + [None]
    assert [r[0] for r in rows(df.select(parse_date_lenient("t")))] == [dt.datetime(2025, 9, 19)] * 4
    s = spark.createDataFrame([(45919.7,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in rows(s.select(excel_serial_to_date("x")))][0] == dt.date(2025, 9, 19)
    assert [r[0] for r in rows(s.select(parse_date_strict(F.lit(None).cast("string"), "x")))] == [dt.date(2025, 9, 19), None, None]
    d = spark.createDataFrame([(dt.date(2025, 9, 18 + i),) for i in range(4)], "d date")
    assert [r[0] for r in rows(d.select(next_business_day("d")))] == [
        dt.date(2025, 9, 19), dt.date(2025, 9, 22), dt.date(2025, 9, 22), dt.date(2025, 9, 22)]
    q = spark.createDataFrame([(dt.date(2025, 2, 14),), (dt.date(2025, 6, 30),)], "d date")
    assert [(r[0].year, r[0].month) for r in rows(q.select(previous_quarter_end("d")))] == [(2024, 12), (2025, 3)]
    y = spark.createDataFrame([(dt.date(2025, 1, 2), dt.date(2025, 1, 1)), (dt.date(2025, 1, 1), None)], "s date, e date")
    assert [r[0] for r in rows(y.select(year_fraction("s", "e")))] == [0.0, None]
    n = spark.createDataFrame([("IFT - 19-09-2025.xlsm",), ("IFT - 31-02-2025.xlsm",), ("IFT.xlsm",)], "n string")
    assert [r[0] for r in rows(n.select(date_from_name("n")))] == [dt.date(2025, 9, 19), None, None]


def test_b4_codes(spark):
    valid = ["SWAP_1", " SWAP_2 ", "0012", "NANCY"]
    invalid = [None, "", " ", NB, "NaN", "None", "null", "N/A", "na", "#N/A", "#NA", "-", "—"]
    df = spark.createDataFrame([(v,) for v in valid + invalid], "c string")
    assert [r[0] for r in rows(df.select(valid_code("c")))] == [True] * len(valid) + [False] * len(invalid)
    p = spark.createDataFrame([("A/B/C",), ("/B",), (None,)], "c string")
    assert [r[0] for r in rows(p.select(code_prefix("c")))] == ["A", "", ""]


def test_b5_books(spark):
    df = spark.createDataFrame([("601",), ("601.0",), ("601,5",), (" 602 ",), ("nan",), ("",), ("X1",)], "b string")
    assert [r[0] for r in rows(df.select(normalize_book("b")))] == ["601", "601", "601.5", "602", None, None, "X1"]


def test_clean_label_unicode_blanks(spark):
    df = spark.createDataFrame([(f"  foo{NB}\t bar  ",), ("   ",), (None,)], "s string")
    assert [r[0] for r in rows(df.select(clean_label("s")))] == ["foo bar", None, None]


def test_b11_money_text(spark):
    vals = [None, 12345678.0, -2500000.0, 9999.0, 10000.0, 1234567890.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in rows(df.select(format_money("v")))] == ["N/A", "12.3", "- 2.5", "9 999.0", "0.0", "1 234.6"]


def test_b12_percent_gap(spark):
    df = spark.createDataFrame([(0.0, 5.0), (-10.0, -5.0)], "o double, n double")
    assert rows(df.select(F.col("n") - F.col("o"), pct_change("o", "n"))) == [(5.0, None), (5.0, -50.0)]


@pytest.mark.parametrize("x", [0.0, 1.5, -12345.678, 1e-7, 98765432.1])
def test_num1_round_trips_formatted_numbers(spark, x):
    text = f"{x:,.4f}".replace(",", " ").replace(".", ",")
    got = rows(spark.createDataFrame([(text,)], "t string").select(parse_number("t", "eu")))[0][0]
    assert got == pytest.approx(round(x, 4))


def test_lenient_dates_in_common_forms(spark):
    import datetime as dt

    day = dt.datetime(2025, 9, 19)
    texts = [("19/09/25", day), ("19-Sep-2025", day), ("19 sep 2025", day), ("2025/09/19", day), ("20250919", day),
             ("19/09/2025 10:30", day.replace(hour=10, minute=30)), ("19.09.25", day), ("no date", None)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", parse_date_lenient("t").alias("v"))
    assert dict(map(tuple, got.collect())) == dict(texts)


def test_date_tokens_and_reasons(spark):
    import datetime as dt

    from ledgerlens.functions.date_tokens import read_date

    day = dt.datetime(2025, 9, 19)
    texts = {
        "September 19, 2025": day, "19th of sept 2025": "unknown word", "Sept 19 2025": day, "2025 Sep 19": day, "Fri 19 Sep 2025": day,
        "friday, 19/9/2025": day, "09-19-2025": day, "9.19.25": day, "20250919 10:30:15": day.replace(hour=10, minute=30, second=15),
        "19/09/2025 12:00 am": day, "19/09/2025 12:00 pm": day.replace(hour=12), "2025-09-19T08:00:00.250Z": day.replace(hour=8),
        "Sep 2025": day.replace(day=1), "9/2025": day.replace(day=1), "2025-09": day.replace(day=1), "19 Sep": "no such date",
        "19/09/2025 25:00": "no such date", "32/13/2025": "no such date", "1 2 3 4": "too many parts", "2025": "too few parts",
        "  ": "blank", "19\u22129\u22122025": "unknown character", "13/13/2025": "no such date", "05/04/2025": dt.datetime(2025, 4, 5),
        "123/04/2025": "no such date", "n.c.": "unknown word", "99999999999999999999": "too few parts",
    }
    r = read_date("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.coalesce(r["reason"], r["value"].cast("string")))
    want = {t: v if isinstance(v, str) else str(v) for t, v in texts.items()}
    assert dict(map(tuple, got.collect())) == want
    assert rows(spark.createDataFrame([(None,)], "t string").select(read_date("t").isNull())) == [(True,)]


def test_date_text_is_read_once(spark):
    """The reader's expression stays small: no step is copied into each of its uses."""
    from ledgerlens.functions.date_tokens import read_date

    plan = spark.createDataFrame([("x",)], "t string").select(read_date("t").alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1 and len(plan) < 50_000


def test_plain_texts_are_not_cleaned_first(spark):
    """Plain numbers and dates take a short way; others give what the long one gives."""
    import datetime as dt

    from ledgerlens.functions import strip_ws
    from ledgerlens.functions.date_tokens import date_value, read_date

    numbers = ["1", "-1.5", "1,5", "+.5", "5,", "1e3", "1,5E-2", "12\n", "12\u0085", "1 ", " 1 ", "1 000,5", "1'000", "1,000.5", "1.2.3", "", "n.c.", "nan", "1d", None]
    eu = [1.0, -1.5, 1.5, 0.5, 5.0, 1e3, 0.015, 12.0, 12.0, 1.0, 1.0, 1000.5, 1000.0, None, None, None, None, None, None, None]
    df = spark.createDataFrame([(x,) for x in numbers], "t string")
    assert [r[0] for r in df.select(parse_number("t", "eu")).collect()] == eu
    mixed = dict(df.select("t", parse_number("t", "mixed")).collect())
    assert [mixed[x] for x in ("1,5", "1,000.5", "5,")] == [1.5, 1000.5, 5.0]

    texts = ["a", " a ", f"{NB}a b\x1f", " \t a　 ", "", "  ", "é", " é ", "\x7f", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(strip_ws("t")).collect()] == ["a", "a", "a b", "a", "", "", "é", "é", "\x7f", None]

    dates = ["19/09/2025", "09-19-2025", "31.02.2025", "32/01/2025", "13/13/2025", "00/01/2025", "01/02/0000", "2025-09-19", "2025/13/01", "0099-01-02",
             "19/09/2025\n", "1/2/2025", "19/09/2025 10:30", "19/09.2025", "", None]
    df = spark.createDataFrame([(x,) for x in dates], "t string")
    both = df.select("t", date_value("t").alias("v"), read_date("t")["value"].alias("w")).collect()
    assert [(r.t, r.v) for r in both] == [(r.t, r.w) for r in both]
    assert both[0].v == dt.datetime(2025, 9, 19) and both[1].v == dt.datetime(2025, 9, 19) and both[7].v == dt.datetime(2025, 9, 19)
    # the short way comes first: a plain text meets no cleaning and no token step
    plan = lambda c: spark.createDataFrame([("x",)], "t string").select(c.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    for c in (parse_number("t"), date_value("t")):
        assert "CASE WHEN" in plan(c).split("AS r")[0][:60]


def test_two_numbers_are_no_text_for_the_token_reader(spark, monkeypatch):
    """Plain amounts in a date column are read where their separator stands, as by tokens."""
    from ledgerlens.functions import date_tokens

    texts = ["18.00", "48.00", "45.11", "45.13", "31.12", "12.2024", "13.2024", "2024-3", "1999/12", "0.0", "7,5", "100.5",
             "10000.5", "1.1", "99999999999.3", "3.99999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_tokens = rows(df.select("t", date_tokens.read_date("t")["value"]))
    assert [t for t, v in by_tokens if v is not None] == ["45.11", "12.2024", "2024-3", "1999/12"]
    never = F.raise_error(F.lit("read by tokens")).cast("timestamp_ntz")
    monkeypatch.setattr(date_tokens, "read_date", lambda c: F.struct(never.alias("value")))
    assert rows(df.select("t", date_tokens.date_value("t"))) == by_tokens
