"""Delimited records that span lines (SRC-6).

A quoted field may hold line feeds, so a line is a record only if it ends
outside quotes, which depends on everything before it in its file.  No file is
read by one task: a line turns "inside quotes or not" before it into the same
after it, and such functions of two states compose.  Each line is reduced to
where it leads from outside (``opens``) and from inside (``stays``); lines that
change nothing drop out, the others are composed inside their split, the splits
of a file by one row each, and what is left are the places where records that
span lines open and close.  Only the lines between those are brought together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

SPLIT = ("source_file", "split")


def line_states(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line that starts outside, and one that starts inside a quoted
    field, ends inside one.  A quote opens a field only as its first character;
    a doubled quote is text."""
    s = re.escape(sep)
    rest = f'[^{s}]*+'
    field = f'(?:"(?:[^"]|"")*+"{rest}|[^"{s}]{rest}|)'
    open_end = '"(?:[^"]|"")*+$'
    outside = f"^(?:{field}{s})*{open_end}"
    inside = f'^(?:[^"]|"")*+(?:$|"{rest}{s}(?:{field}{s})*{open_end})'
    quoted = line.contains('"')
    return quoted & line.rlike(outside), ~quoted | line.rlike(inside)


def stored_lines(spark: SparkSession, paths, sep: str) -> DataFrame:
    """source_file, split, row, line, opens, stays of every line, written once so
    that all later steps see the same places; lines of a split come in order."""
    opens, stays = line_states(F.col("value"), sep)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"), opens.alias("opens"), stays.alias("stays"),
    )
    return materialize(lines, "feed-lines")


def _running(fixed: Column, flip: Column, w) -> tuple[Column, Column]:
    """Composition along a window: the last state that does not depend on the
    start, with the flips before it, and the flips so far."""
    flips = F.sum(flip).over(w)
    return F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("v"), flips.alias("at"))), ignorenulls=True).over(w), flips


def _after(known: Column, flips: Column, start: Column) -> Column:
    return F.when(known.isNotNull(), (known["v"] + flips - known["at"]) % 2).otherwise((start + flips) % 2)


def boundaries(lines: DataFrame) -> DataFrame:
    """source_file, split, row, opens of the lines where a record that spans lines
    begins (``opens``) or ends, in files of any number of splits."""
    marks = lines.where(F.col("opens") | ~F.col("stays")).select(*SPLIT, "row", "opens", "stays")
    in_split = Window.partitionBy(*SPLIT).orderBy("row")
    upto = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.when(F.col("opens") == F.col("stays"), F.col("opens").cast("int"))
    known, flips = _running(fixed, (F.col("opens") & ~F.col("stays")).cast("int"), upto)
    marks = materialize(marks.withColumn("known", known).withColumn("flips", flips), "quote-marks")

    ends = marks.groupBy(*SPLIT).agg(F.max_by(F.struct("known", "flips"), "row").alias("e"))
    ends = ends.select(
        *SPLIT, F.when(F.col("e.known").isNotNull(), _after(F.col("e.known"), F.col("e.flips"), F.lit(0))).alias("fixed"),
        (F.col("e.flips") % 2).alias("flip"),
    )
    files = Window.partitionBy("source_file").orderBy("split")
    known, flips = _running(
        F.col("fixed"), F.when(F.col("fixed").isNull(), F.col("flip")).otherwise(0),
        files.rowsBetween(Window.unboundedPreceding, Window.currentRow),
    )
    ends = ends.withColumn("known", known).withColumn("flips", flips)
    ends = ends.withColumn("end", _after(F.col("known"), F.col("flips"), F.lit(0)))
    starts = ends.select(*SPLIT, F.lag("end", 1, 0).over(files).alias("start"))  # one row per split

    placed = marks.join(starts, list(SPLIT)).withColumn("after", _after(F.col("known"), F.col("flips"), F.col("start")))
    before = F.coalesce(F.lag("after").over(in_split), F.col("start"))
    placed = placed.withColumn("before", before)
    turns = ((F.col("before") == 0) & F.col("opens")) | ((F.col("before") == 1) & ~F.col("stays"))
    return placed.where(turns).select(*SPLIT, "row", (F.col("before") == 0).alias("opens"))


def spanning(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_file, split, row, record) of the lines of records that span lines,
    ``record`` being the place (split, row) of the first; and (source_file,
    position) of quotes that no later line of their file closes."""
    turns = materialize(boundaries(lines), "quote-turns")
    in_split = Window.partitionBy(*SPLIT).orderBy("row")
    paired = turns.withColumn("close", F.lead("row").over(in_split))
    opened = paired.where("opens").withColumn("record", F.struct("split", "row"))
    near = opened.where(F.col("close").isNotNull()).select(*SPLIT, F.col("row").alias("low"), F.col("close").alias("high"), "record")

    first = turns.groupBy(*SPLIT).agg(F.min("row").alias("first"))
    files = Window.partitionBy("source_file").orderBy("split")
    later = first.select(  # the first turn of the next split that has one: one row per split
        *SPLIT, F.lead("split").over(files).alias("close_split"), F.lead("first").over(files).alias("close_row")
    )
    far = opened.where(F.col("close").isNull()).drop("close").join(later, list(SPLIT))
    closed = far.where(F.col("close_split").isNotNull())
    ranges = lines.groupBy(*SPLIT).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    spans = closed.select("source_file", "record", "close_split", "close_row").join(ranges, "source_file").where(
        (F.col("split") >= F.col("record.split")) & (F.col("split") <= F.col("close_split"))
    )
    wide = spans.select(
        *SPLIT,
        F.when(F.col("split") == F.col("record.split"), F.col("record.row")).otherwise(F.col("first_row")).alias("low"),
        F.when(F.col("split") == F.col("close_split"), F.col("close_row")).otherwise(F.col("last_row")).alias("high"),
        "record",
    )
    inside = near.unionByName(wide).select(*SPLIT, F.explode(F.sequence("low", "high")).alias("row"), "record")
    unclosed = far.where(F.col("close_split").isNull()).select("source_file", F.col("record").alias("position"))
    return inside, unclosed


def records(lines: DataFrame) -> DataFrame:
    """line, source_file, position of every record: lines of one record joined by
    line feeds, all others as they are.  A quote that is never closed stays a
    line of its own, as do the lines after it."""
    inside = materialize(spanning(lines)[0], "spanning-lines")
    keys = [*SPLIT, "row"]
    single = lines.join(inside, keys, "left_anti").select("line", "source_file", F.struct("split", "row").alias("position"))
    parts = F.array_sort(F.collect_list(F.struct("split", "row", "line")))
    joined = (
        lines.join(inside, keys).groupBy("source_file", "record").agg(parts.alias("parts"))
        .select(F.array_join("parts.line", "\n").alias("line"), "source_file", F.col("record").alias("position"))
    )
    return single.unionByName(joined)
