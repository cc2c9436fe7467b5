"""Readers on files the tests write to a fresh temporary folder."""

import io
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from helpers import rows
from ledgerlens.operators import reconcile
from ledgerlens.sources import archives, feeds, files, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="ledgerlens-test-")


def test_feed_layouts_bind_by_name_and_na_tokens(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("FREE_TEXT_2;MTM_VALUE;MTM_DIFF;CP\nSWAP_1/x;1 000,5;N/A;CP1\nSWAP_2;2;0,5;\n")
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("MTM_DIFF;FREE_TEXT_2;MTM_VALUE;NOTIONAL;BOOK;FREE_TEXT_1\n1;SWAP_1;3;100;601.0;BDFWD x\nnan;\"A;B\";4;NA;;\n")
    rws, layouts = feeds.read_delimited(spark, [os.path.join(d, "*.csv")], sep=";")
    feed = feeds.feed_from_text(rws)
    got = sorted(rows(feed, "free_text_2", "mtm_value", "mtm_diff", "notional", "book", "cp"), key=str)
    assert got == sorted([("SWAP_1/x", 1000.5, None, None, None, "CP1"), ("SWAP_2", 2.0, 0.5, None, None, None),
                          ("SWAP_1", 3.0, 1.0, 100.0, "601.0", None), ("A;B", 4.0, None, None, None, None)], key=str)
    miss = {os.path.basename(r[0]): r[1] for r in rows(feeds.missing_columns(layouts, feeds.FEED_OPTIONAL, "optional"), "source_file", "missing")}
    assert miss == {"a.csv": ["BOOK", "FREE_TEXT_1", "NOTIONAL"], "b.csv": ["CP"]}


def test_override_table(spark):
    o = dict(rows(feeds.override_table(spark)))
    assert len(o) == 11 and o["SWAP_240"] == -1.83 and o["SWAP_235"] == -3.65


def test_alias_text_file(spark):
    d = _tmp()
    with open(os.path.join(d, "aliases.txt"), "w") as fh:
        fh.write(reconcile.DEFAULT_COUNTERPARTY_ALIASES)
    lines = spark.read.text(d).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    m = dict(rows(reconcile.parse_aliases(lines.coalesce(1))))
    assert m["jpm"] == "JP MORGAN SE" and m["cacib"] == "CREDIT AGRICOLE" and m["societe generale"] == "SOCIETE GENERALE"


def test_archives_and_listing(spark):
    d = _tmp()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("IR_1.xls", b"a")
        zf.writestr("sub/IR_1.xls", b"bb")
        zf.writestr("sub/", b"")
        zf.writestr("x/IR_2.XLSX", b"ccc")
        zf.writestr("notes.txt", b"d")
    with open(os.path.join(d, "IR_01022025_a.zip"), "wb") as fh:
        fh.write(buf.getvalue())
    mem = archives.select_members(archives.read_archives(spark, d))
    assert sorted(rows(mem, "member", "basename", "size")) == [("IR_1.xls", "IR_1.xls", 1), ("sub/IR_1.xls", "IR_1.xls", 2), ("x/IR_2.XLSX", "IR_2.XLSX", 3)]
    legacy = archives.select_members(archives.read_archives(spark, d), archives.LEGACY_SUFFIXES)
    assert sorted(r[0] for r in rows(legacy, "member")) == ["IR_1.xls", "sub/IR_1.xls"]
    members = mem.select(F.lit("dest").alias("dest"), "basename", F.col("member").alias("ord"))
    existing = spark.createDataFrame([("dest", "IR_2.XLSX")], "dest string, file_name string")
    names = sorted(rows(files.collision_names(members, existing), "ord", "target_name"))
    assert names == [("IR_1.xls", "IR_1.xls"), ("sub/IR_1.xls", "IR_1_1.xls"), ("x/IR_2.XLSX", "IR_2_1.XLSX")]
    lst = files.list_files(spark, d)
    assert rows(files.pattern_counts(lst, ["IR_01022025*.zip", "XCY_IR_01022025*.zip"])) == [("IR_01022025*.zip", 1), ("XCY_IR_01022025*.zip", 0)] or \
        sorted(rows(files.pattern_counts(lst, ["IR_01022025*.zip", "XCY_IR_01022025*.zip"]))) == [("IR_01022025*.zip", 1), ("XCY_IR_01022025*.zip", 0)]


def test_run_partitions_dynamic_overwrite(spark):
    import datetime as dt

    d = os.path.join(_tmp(), "runs")
    df = spark.createDataFrame([(1, dt.date(2025, 9, 19), "Fast"), (2, dt.date(2025, 9, 19), "Close"), (3, dt.date(2025, 6, 30), "Close")],
                               "k int, run_date date, run_mode string")
    out = sinks.with_run_partitions(df, "run_date", "run_mode").drop("run_date", "run_mode")
    sinks.write_runs(out, d)
    sinks.write_runs(out.where(F.col("k") == 1).withColumn("k", F.lit(10)), d)  # rerun one partition
    back = sorted(rows(spark.read.parquet(d), "k", "year", "month", "mode"))
    assert back == [(2, 2025, "09-2025", "close"), (3, 2025, "06-2025", "close"), (10, 2025, "09-2025", "fast")]
    assert os.path.isdir(os.path.join(d, "year=2025", "month=09-2025", "mode=fast"))


def test_feed_stream_available_now(spark):
    from ledgerlens.streaming import start_feed_stream

    d, out, ck = _tmp(), os.path.join(_tmp(), "out"), os.path.join(_tmp(), "ck")
    with open(os.path.join(d, "f1.csv"), "w") as fh:
        fh.write("FREE_TEXT_2;MTM_VALUE;MTM_DIFF\nSWAP_1/a;1,5;0,5\n")
    with open(os.path.join(d, "f2.csv"), "w") as fh:
        fh.write("MTM_DIFF;MTM_VALUE;FREE_TEXT_2\n1;2;SWAP_2\n")
    q = start_feed_stream(spark, d, out, ck)
    q.awaitTermination(120)
    got = sorted(rows(spark.read.parquet(out), "free_text_2", "mtm_value", "mtm_diff"))
    assert got == [("SWAP_1/a", 1.5, 0.5), ("SWAP_2", 2.0, 1.0)]


def test_feed_headers_keep_their_places_and_no_file_is_lost(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write("﻿\n FREE_TEXT_2 ;;MTM_VALUE;MTM_DIFF;MTM_DIFF\nSWAP_1/x;junk;10;4;5;beyond;more\nFREE_TEXT_2;;1;2;3\n")
    with open(os.path.join(d, "nokey.csv"), "w") as fh:
        fh.write("OTHER;MTM_VALUE\nx;7\n")
    rws, layouts = feeds.read_delimited(spark, [os.path.join(d, "*.csv")], sep=";")
    got = sorted(rows(rws, "FREE_TEXT_2", "MTM_VALUE", "MTM_DIFF", "extra_fields"), key=str)
    assert got == sorted([("SWAP_1/x", "10", "4", ["beyond", "more"]), ("FREE_TEXT_2", "1", "2", []), (None, "7", None, [])], key=str)
    miss = {os.path.basename(r[0]): r[1] for r in rows(feeds.missing_columns(layouts, feeds.FEED_REQUIRED, "required"), "source_file", "missing")}
    assert miss == {"nokey.csv": ["FREE_TEXT_2", "MTM_DIFF"]}


def test_broken_archive_is_reported(spark):
    d = _tmp()
    with open(os.path.join(d, "bad.zip"), "wb") as fh:
        fh.write(b"not a zip")
    mem = archives.read_archives(spark, d)
    assert [(r[0], r[1]) for r in rows(archives.broken(mem), "archive", "member")] == [("bad.zip", None)]
    assert archives.select_members(mem).count() == 0


def test_collision_names_against_one_after_another(spark):
    import random

    r = random.Random(3)
    cases = [("d0", ["a.xls", "a_1.xls", "a.xls"], ["a.xls", "a_2.xls"])]
    for i in range(1, 12):
        pool = ["a.xls", "a_1.xls", "a_2.xls", "a_1_1.xls", "b", "b_1", "c.x.y"]
        cases.append((f"d{i}", [r.choice(pool) for _ in range(12)], r.sample(pool, 3)))
    members, have, want = [], [], []
    for dest, new, old in cases:
        taken = set(old)
        have += [(dest, o) for o in old]
        for k, n in enumerate(new):
            members.append((dest, n, k))
            stem, dot, ext = n.rpartition(".") if "." in n else (n, "", "")
            j, name = 0, n
            while name in taken:
                j += 1
                name = f"{stem}_{j}{dot}{ext}"
            taken.add(name)
            want.append((dest, k, name))
    got = files.collision_names(
        spark.createDataFrame(members, "dest string, basename string, ord int"),
        spark.createDataFrame(have, "dest string, file_name string"))
    assert sorted(rows(got, "dest", "ord", "target_name")) == sorted(want)


def test_archive_members_travel_in_batches():
    """Small members share a frame; a full one is handed on before the next member."""
    import io
    import zipfile

    import pandas as pd

    from ledgerlens.sources import archives as A

    def packed(members):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zf:
            for name, data in members:
                zf.writestr(name, data)
        return buf.getvalue()

    small = packed([(f"m{i}.xls", b"x") for i in range(300)])
    large = packed([("a.xls", b"x" * A.BATCH_BYTES), ("b.xls", b"y" * A.BATCH_BYTES)])
    content = [small, small, b"broken", large]
    pdf = pd.DataFrame({"path": [f"/d/{i}.zip" for i in range(4)], "content": content})
    frames = list(A._expand([pdf]))
    assert [len(f) for f in frames] == [602, 1]
    assert sum(f["error"].notna().sum() for f in frames) == 1
