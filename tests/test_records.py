"""Records that span lines, across split borders, against Python's csv reader."""

import csv
import io
import os
import random
import tempfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlens.sources import feeds, records


def folder(**texts):
    d = tempfile.mkdtemp(prefix="ll-rec-")
    for name, text in texts.items():
        with open(os.path.join(d, f"{name}.csv"), "w", encoding="utf-8", newline="") as fh:
            fh.write(text)
    return d


@pytest.fixture
def split_bytes(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def generated(seed, n):
    r = random.Random(seed)
    plain = ["a", "", "5\" pipe", "x y", "é", "12"]
    quoted = ['"a;b"', '"two\nlines"', '"say ""hi"""', '"\n\n;"', '""', '"a ""\n"" b;"', '"three\nlines\nhere"']
    lines = ["FREE_TEXT_2;MTM_VALUE;MTM_DIFF;CP"]
    for i in range(n):
        pick = lambda: r.choice(quoted) if r.random() < 0.3 else r.choice(plain)
        lines.append(";".join([f"k{i}", pick(), pick(), pick()]))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("size", [60, 500, 1 << 20])
def test_against_the_csv_reader(spark, split_bytes, size):
    split_bytes(size)
    texts = {f"f{i}": generated(i, 120) for i in range(3)}
    rws, _ = feeds.read_delimited(spark, [os.path.join(folder(**texts), "*.csv")])
    got = sorted(rows(rws.select(F.regexp_extract("source_file", r"(f\d)\.csv", 1), "FREE_TEXT_2", "MTM_VALUE", "MTM_DIFF", "CP")))
    want = []
    null = lambda x: None if x in feeds.NA_TOKENS else x
    for name, text in texts.items():
        body = list(csv.reader(io.StringIO(text), delimiter=";"))[1:]
        want += [(name, k, *map(null, v)) for k, *v in body]
    key = lambda t: tuple(x or "" for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_record_over_several_splits(spark, split_bytes):
    split_bytes(30)
    long = "\n".join(f"line {i} of the field" for i in range(20))
    d = folder(a=f'FREE_TEXT_2;CP\nk0;x\nk1;"{long}"\nk2;y\n')
    rws, _ = feeds.read_delimited(spark, [os.path.join(d, "*.csv")])
    assert sorted(rows(rws, "FREE_TEXT_2", "CP")) == [("k0", "x"), ("k1", long), ("k2", "y")]


def test_a_quote_that_is_never_closed(spark, split_bytes):
    split_bytes(20)
    d = folder(a='FREE_TEXT_2;CP\nk0;"x\nk1;y\nk2;z\n', b='FREE_TEXT_2;CP\nk3;"u\nv"\n')
    lines = records.stored_lines(spark, [os.path.join(d, "*.csv")], ";")
    bad = records.spanning(lines)[1]
    assert [os.path.basename(f) for (f,) in rows(bad, "source_file")] == ["a.csv"]
    rws, _ = feeds.read_delimited(spark, [os.path.join(d, "*.csv")])
    assert sorted(rows(rws, "FREE_TEXT_2", "CP")) == [("k0", '"x'), ("k1", "y"), ("k2", "z"), ("k3", "u\nv")]


def ends_inside(line, inside):
    """Character by character: s field start, u unquoted or after a closing quote, q quoted."""
    state, i = ("q" if inside else "s"), 0
    while i < len(line):
        c = line[i]
        if state == "q":
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                state = "u"
        elif c == ";":
            state = "s"
        else:
            state = "q" if c == '"' and state == "s" else "u"
        i += 1
    return state == "q"


def test_line_states(spark):
    r = random.Random(4)
    lines = ["", '"', '""', '"""', *("".join(r.choice('ab;""') for _ in range(r.randint(1, 12))) for _ in range(2000))]
    got = rows(spark.createDataFrame([(x,) for x in lines], "l string").select("l", *records.line_states(F.col("l"), ";")))
    assert got == [(x, ends_inside(x, False), ends_inside(x, True)) for x in lines]
