"""Queries over the scalar rules (NUM-*, DATE-*, STR-7, SNK-7), each applied
to text or dates derived from every row of a driver table, with the DuckDB
oracle next to each one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.date_tokens import read_date
from ..functions import (
    date_tag,
    div_optional,
    format_money,
    mul,
    next_business_day,
    parse_date_lenient,
    parse_date_strict,
    parse_number,
    previous_quarter_end,
    sub_optional,
    sum_optional,
)
from ..functions.text import NBSP
from ..sources import bindings as B
from . import bindings_sql as BS
from . import sqltext as S
from .catalog import register
from .oracle import ORACLE


# ------------------------------------------------------------------ number texts
def _number_texts(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")
    cents = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("long")
    li = li.withColumn("cents", cents)
    e = F.expr("cents div 100").cast("string")
    cc = F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    th = F.expr("cents div 100000").cast("string")
    r3 = F.lpad((F.expr("cents div 100") % 1000).cast("string"), 3, "0")
    big = F.col("cents") >= 100000
    ln = F.col("l_linenumber")
    junk = F.col("l_suppkey") % 6
    text = (
        F.when(ln == 1, F.concat(e, F.lit(","), cc))
        .when(ln == 2, F.concat(e, F.lit("."), cc))
        .when((ln == 3) & big, F.concat(th, F.lit(" "), r3, F.lit(","), cc))
        .when((ln == 4) & big, F.concat(th, F.lit("'"), r3, F.lit("."), cc))
        .when((ln == 5) & big, F.concat(th, F.lit(","), r3, F.lit("."), cc))
        .when((ln == 6) & big, F.concat(th, F.lit("."), r3, F.lit(","), cc))
        .when(ln <= 6, F.concat(F.lit(" "), e, F.lit(" ")))
        .when(junk == 0, F.lit("n/a"))
        .when(junk == 1, F.lit(""))
        .when(junk == 2, F.lit("12%"))
        .when(junk == 3, F.concat(F.lit(NBSP), e, F.lit(NBSP + "," + "5")))
        .when(junk == 4, F.lit("1e3"))
        .otherwise(F.concat(F.lit("-"), e, F.lit(","), cc))
    )
    signed = F.when(F.col("l_tax") > 0.06, F.concat(F.lit("-"), text)).otherwise(text)
    return li.select("l_orderkey", "l_linenumber", signed.alias("text"))


_NUMBER_TEXT_SQL = """select l_orderkey, l_linenumber,
 case when l_tax > 0.06 then concat('-', txt) else txt end as text from (
 select l_orderkey, l_linenumber, l_tax,
  case when l_linenumber = 1 then concat(cast(c // 100 as varchar), ',', lpad(cast(c % 100 as varchar), 2, '0'))
   when l_linenumber = 2 then concat(cast(c // 100 as varchar), '.', lpad(cast(c % 100 as varchar), 2, '0'))
   when l_linenumber = 3 and c >= 100000 then concat(cast(c // 100000 as varchar), ' ', lpad(cast((c // 100) % 1000 as varchar), 3, '0'), ',', lpad(cast(c % 100 as varchar), 2, '0'))
   when l_linenumber = 4 and c >= 100000 then concat(cast(c // 100000 as varchar), '''', lpad(cast((c // 100) % 1000 as varchar), 3, '0'), '.', lpad(cast(c % 100 as varchar), 2, '0'))
   when l_linenumber = 5 and c >= 100000 then concat(cast(c // 100000 as varchar), ',', lpad(cast((c // 100) % 1000 as varchar), 3, '0'), '.', lpad(cast(c % 100 as varchar), 2, '0'))
   when l_linenumber = 6 and c >= 100000 then concat(cast(c // 100000 as varchar), '.', lpad(cast((c // 100) % 1000 as varchar), 3, '0'), ',', lpad(cast(c % 100 as varchar), 2, '0'))
   when l_linenumber <= 6 then concat(' ', cast(c // 100 as varchar), ' ')
   when l_suppkey % 6 = 0 then 'n/a' when l_suppkey % 6 = 1 then '' when l_suppkey % 6 = 2 then '12%'
   when l_suppkey % 6 = 3 then concat(chr(160), cast(c // 100 as varchar), chr(160), ',5')
   when l_suppkey % 6 = 4 then '1e3'
   else concat('-', cast(c // 100 as varchar), ',', lpad(cast(c % 100 as varchar), 2, '0')) end as txt
 from (select *, cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) as c from lineitem) z) y"""


def _number_query(dialect: str):
    def q(spark, sf_dir):
        t = _number_texts(spark, sf_dir)
        return t.select("l_orderkey", "l_linenumber", "text", parse_number("text", dialect).alias("value"))

    return q


for _d, _ids in (("eu", "NUM-1"), ("mixed", "NUM-2"), ("legacy", "NUM-3")):
    _fn = _number_query(_d)
    _fn.__name__ = f"parse_number_{_d}"
    _fn.__doc__ = f"{_ids}: '{_d}' number dialect over generated amount texts."
    register(_fn)

_PARSERS = {"eu": S.parse_eu, "mixed": S.parse_mixed, "legacy": S.parse_legacy}
for _d, _p in _PARSERS.items():
    ORACLE[f"parse_number_{_d}"] = f"with nt as ({_NUMBER_TEXT_SQL}) select l_orderkey, l_linenumber, text, {_p('text')} as value from nt"


# ------------------------------------------------------------------ optional arithmetic
@register
def optional_arithmetic(spark, sf_dir):
    """NUM-4, NUM-5, NUM-6, NUM-7: null-aware arithmetic on feed amounts."""
    m = B.marks_feed(spark, sf_dir)
    a, b = F.col("mtm_diff").cast("double"), F.col("notional").cast("double")
    return m.select(
        "o_orderkey",
        sub_optional(a, b).alias("sub_opt"),
        div_optional(a, b).alias("div_opt"),
        mul(a, b).alias("mul"),
        sum_optional(a, b).alias("sum_opt"),
    )


ORACLE["optional_arithmetic"] = f"""with m as ({BS.M}) select o_orderkey,
 {S.sub_opt('a', 'b')} as sub_opt, {S.div_opt('a', 'b')} as div_opt, a * b as mul,
 case when a is not null or b is not null then coalesce(a, 0) + coalesce(b, 0) end as sum_opt
from (select o_orderkey, cast(mtm_diff as double) as a, cast(notional as double) as b from m) z"""


# ------------------------------------------------------------------ serial dates
@register
def excel_serial_date(spark, sf_dir):
    """DATE-1: Excel serial numbers (from ship dates, with fractions and
    non-positive values) to dates (strict path) and timestamps (mapping path)."""
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_discount", "l_tax")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date"))
    serial = F.when(F.col("l_linenumber") == 7, -F.col("l_tax") * 100).otherwise(days + F.col("l_discount"))
    s = li.select("l_orderkey", "l_linenumber", serial.alias("serial"))
    return s.select(
        "l_orderkey", "l_linenumber", "serial",
        parse_date_strict(F.lit(None).cast("string"), "serial").alias("as_date"),
        parse_date_lenient(F.lit(None).cast("string"), "serial").alias("as_timestamp"),
    )


ORACLE["excel_serial_date"] = """select l_orderkey, l_linenumber, serial,
 case when serial > 0 then date '1899-12-30' + cast(floor(serial) as integer) end as as_date,
 case when serial > 59 then timestamp '1899-12-30 00:00:00' + to_seconds(cast(round(serial * 86400.0) as bigint)) end as as_timestamp
from (select l_orderkey, l_linenumber,
  case when l_linenumber = 7 then -l_tax * 100 else date_diff('day', date '1899-12-30', cast(l_shipdate as date)) + l_discount end as serial
  from lineitem) z"""


# ------------------------------------------------------------------ date texts
def _date_texts(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    d = F.col("l_shipdate").cast("date")
    ln = F.col("l_linenumber")
    text = (
        F.when(ln == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(ln == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(ln == 3, F.date_format(d, "dd-MM-yyyy"))
        .when(ln == 4, F.date_format(d, "M/d/yyyy"))
        .when(ln == 5, F.date_format(d, "d.M.yyyy"))
        .when(ln == 6, F.concat(F.lit(" "), F.date_format(d, "d/M/yyyy"), F.lit(" ")))
        .otherwise(F.concat(F.lit("31/02/"), F.date_format(d, "yyyy")))
    )
    return li.select("l_orderkey", "l_linenumber", text.alias("text"))


_DATE_TEXT_SQL = """select l_orderkey, l_linenumber,
 case l_linenumber when 1 then strftime(l_shipdate, '%d/%m/%Y') when 2 then strftime(l_shipdate, '%Y-%m-%d')
  when 3 then strftime(l_shipdate, '%d-%m-%Y') when 4 then strftime(l_shipdate, '%-m/%-d/%Y')
  when 5 then strftime(l_shipdate, '%-d.%-m.%Y') when 6 then concat(' ', strftime(l_shipdate, '%-d/%-m/%Y'), ' ')
  else concat('31/02/', strftime(l_shipdate, '%Y')) end as text from lineitem"""


def _gate(s: str, pattern: str, fmt: str, kind: str = "date") -> str:
    conv = f"try_strptime({s}, '{fmt}')"
    if kind == "date":
        conv = f"cast({conv} as date)"
    return f"case when regexp_matches({s}, '{pattern}') then {conv} end"


_DMY = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
_YMD = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_DMYD = "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"
_DMYP = r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"


@register
def parse_date_strict_text(spark, sf_dir):
    """DATE-3: strict day-first / ISO / day-month-year parsing of date texts."""
    t = _date_texts(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "text", parse_date_strict("text").alias("value"))


@register
def parse_date_lenient_text(spark, sf_dir):
    """DATE-2: lenient parsing (day-first formats, then month-first)."""
    t = _date_texts(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "text", parse_date_lenient("text").alias("value"))


_ST = S.strip("text")
ORACLE["parse_date_strict_text"] = f"""with dt as ({_DATE_TEXT_SQL}) select l_orderkey, l_linenumber, text,
 coalesce({_gate(_ST, _DMY, '%d/%m/%Y')}, {_gate(_ST, _YMD, '%Y-%m-%d')}, {_gate(_ST, _DMYD, '%d-%m-%Y')}) as value from dt"""

ORACLE["parse_date_lenient_text"] = f"""with dt as ({_DATE_TEXT_SQL}) select l_orderkey, l_linenumber, text,
 coalesce({_gate(_ST, _DMY, '%d/%m/%Y', 'ts')}, {_gate(_ST, _DMYD, '%d-%m-%Y', 'ts')}, {_gate(_ST, _DMYP, '%d.%m.%Y', 'ts')},
  {_gate(_ST, _YMD, '%Y-%m-%d', 'ts')}, {_gate(_ST, _DMY, '%m/%d/%Y', 'ts')}) as value from dt"""


def _date_styles(d, k):
    """A date in twelve spellings, four of them unreadable, by the number of its line."""
    style = k % 12
    return (
        F.when(style == 0, F.date_format(d, "d MMMM yyyy"))
        .when(style == 1, F.concat(F.date_format(d, "EEE"), F.lit(", "), F.date_format(d, "MMM d, yyyy")))
        .when(style == 2, F.concat(F.date_format(d, "dd-MMM-yy"), F.lit(" 14:05")))
        .when(style == 3, F.date_format(d, "yyyyMMdd"))
        .when(style == 4, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:59:01.5Z")))
        .when(style == 5, F.concat(F.date_format(d, "d.M.yy"), F.lit(" 2:30 pm")))
        .when(style == 6, F.concat(F.lit("21st "), F.date_format(d, "MMM, yyyy")))
        .when(style == 7, F.date_format(d, "MMM yyyy"))
        .when(style == 8, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit("?")))
        .when(style == 9, F.concat(F.date_format(d, "dd"), F.lit(" floreal "), F.date_format(d, "yyyy")))
        .when(style == 10, F.concat(F.lit("31/02/"), F.date_format(d, "yyyy")))
        .otherwise(F.date_format(d, "yyyy"))
    )


@register
def date_text_reasons(spark, sf_dir):
    """DATE-2: free-form date texts by tokens; unread ones with the reason."""
    li = B.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    t = li.select("l_orderkey", "l_linenumber", _date_styles(F.col("l_shipdate").cast("date"), k).alias("text"))
    return t.select("l_orderkey", "l_linenumber", "text", read_date("text").alias("_r")).select(
        "l_orderkey", "l_linenumber", "text", "_r.value", "_r.reason")


_MIDNIGHT = "cast(d as timestamp)"
_CENTURY = "cast(case when year(d) < 2000 then d + interval 100 year else d end as timestamp)"  # two digits are 2000 to 2099
ORACLE["date_text_reasons"] = f"""with t as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as d, (l_orderkey + l_linenumber) % 12 as s from lineitem)
select l_orderkey, l_linenumber, case s when 0 then strftime(d, '%-d %B %Y') when 1 then strftime(d, '%a, %b %-d, %Y') when 2 then strftime(d, '%d-%b-%y 14:05')
  when 3 then strftime(d, '%Y%m%d') when 4 then strftime(d, '%Y-%m-%dT23:59:01.5Z') when 5 then strftime(d, '%-d.%-m.%y 2:30 pm') when 6 then strftime(d, '21st %b, %Y')
  when 7 then strftime(d, '%b %Y') when 8 then strftime(d, '%d/%m/%Y?') when 9 then strftime(d, '%d floreal %Y') when 10 then strftime(d, '31/02/%Y') else strftime(d, '%Y') end as text,
 case when s in (0, 1, 3) then {_MIDNIGHT} when s = 2 then {_CENTURY} + interval 845 minute when s = 4 then {_MIDNIGHT} + interval 86341 second
  when s = 5 then {_CENTURY} + interval 870 minute when s = 6 then cast(date_trunc('month', d) as timestamp) + interval 20 day when s = 7 then cast(date_trunc('month', d) as timestamp) end as value,
 case s when 8 then 'unknown character' when 9 then 'unknown word' when 10 then 'no such date' when 11 then 'too few parts' end as reason from t"""


# ------------------------------------------------------------------ calendar
# text before and after the date in the attachment's name
ATTACHMENT = ("Valuation ", " - control.xlsx")


@register
def next_business_day_tags(spark, sf_dir):
    """DATE-5, DATE-7, DATE-8, SNK-7: business-day file tag, previous
    quarter-end folder and the date tags of every order date."""
    o = B.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    d = F.col("o_orderdate").cast("date")
    nbd = next_business_day(d)
    pq = previous_quarter_end(d)
    return o.select(
        "o_orderkey",
        d.alias("ifts_date"),
        nbd.alias("file_day"),
        date_tag(nbd, "file_tag").alias("file_tag"),
        F.year(pq).alias("prev_quarter_year"),
        F.month(pq).alias("prev_quarter_month"),
        date_tag(d, "year").alias("year_folder"),
        date_tag(d, "month_folder").alias("month_folder"),
        date_tag(d, "iso").alias("iso_tag"),
        date_tag(d, "display").alias("display"),
        F.concat(F.lit(ATTACHMENT[0]), date_tag(d, "attachment"), F.lit(ATTACHMENT[1])).alias("attachment"),
    )


ORACLE["next_business_day_tags"] = """select o_orderkey, d as ifts_date, nbd as file_day, strftime(nbd, '%m%d%Y') as file_tag,
 cast(year(pq) as integer) as prev_quarter_year, cast(month(pq) as integer) as prev_quarter_month,
 strftime(d, '%Y') as year_folder, strftime(d, '%m-%Y') as month_folder, strftime(d, '%Y-%m-%d') as iso_tag,
 strftime(d, '%d/%m/%Y') as display, concat('""" + ATTACHMENT[0] + """', strftime(d, '%d-%m-%Y'), '""" + ATTACHMENT[1] + """') as attachment
from (select o_orderkey, d, cast(d + (case isodow(d) when 5 then 3 when 6 then 2 else 1 end) as date) as nbd,
  cast(date_trunc('quarter', d) - interval 1 month as date) as pq
 from (select o_orderkey, cast(o_orderdate as date) as d from orders) x) y"""


# ------------------------------------------------------------------ money text
@register
def money_text(spark, sf_dir):
    """STR-7: amount texts of the MtM summary, over every order total and its
    negation scaled down."""
    o = B.table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    v = F.col("o_totalprice")
    amount = F.when(F.col("o_orderkey") % 3 == 0, -v).when(F.col("o_orderkey") % 3 == 1, v * 100).otherwise(v / 100)
    x = o.select("o_orderkey", amount.alias("amount"))
    return x.select("o_orderkey", "amount", format_money("amount").alias("text"))


ORACLE["money_text"] = f"""select o_orderkey, amount, {S.format_money('amount')} as text from (
 select o_orderkey, case when o_orderkey % 3 = 0 then -o_totalprice when o_orderkey % 3 = 1 then o_totalprice * 100
  else o_totalprice / 100 end as amount from orders) z"""
