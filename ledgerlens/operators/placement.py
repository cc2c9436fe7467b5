"""Sequential row numbering without a single-partition window (SRT-5, SNK-2).

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Here the rows are range-partitioned on the order key, numbered inside each
partition by their position, and shifted by the running count of the
partitions before them (a table with one row per partition and group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POS_BITS = 33  # monotonically_increasing_id: partition id above bit 33


def sequential_index(
    df: DataFrame,
    order_cols: list[str],
    group_cols: list[str] | None = None,
    name: str = "seq",
    start: int = 1,
    num_partitions: int | None = None,
    checkpoint: bool = False,
    slices: list[Column] | None = None,
    restart: bool = True,
) -> DataFrame:
    """Add ``name`` = start + rank of the row within ``group_cols`` by ``order_cols``;
    with ``restart=False`` numbers go on from group to group.

    ``order_cols`` must give a total order inside each group.  The
    range-partitioned rows with their position ids are written once as a
    table under the checkpoint folder: the counting pass and the numbering
    pass then read the same stored ids (two independent executions of the
    exchange are not guaranteed to place rows identically), and a lost
    executor cannot change them.  ``checkpoint=True`` also writes the
    numbered result, for callers that reuse it many times.

    ``slices``, where given, are conditions that cut the groups along the first
    order column, from its least values up (one holds for every row).  The rows
    of one slice are shuffled, sorted and written before those of the next, so
    the disk holds the table and the shuffle of one slice.
    """
    group_cols = list(group_cols or [])
    keys = group_cols + list(order_cols)
    # without an explicit count AQE may coalesce the range partitions; the
    # ids are taken after that and stored, so both passes agree
    def ranged_rows(x: DataFrame, i: int) -> DataFrame:
        return (
            (x.repartitionByRange(num_partitions, *keys) if num_partitions else x.repartitionByRange(*keys))
            .sortWithinPartitions(*keys)
            .withColumns({"_slice": F.lit(i), "_mid": F.monotonically_increasing_id()})
        )

    from ..session import materialize, materialize_compact

    cut = [df.where(s) for s in slices] if slices else [df]
    ranged = materialize_compact([ranged_rows(x, i) for i, x in enumerate(cut)], "ranged")
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    pos = F.col("_mid") - F.shiftleft(pid, _POS_BITS)
    ranged = ranged.withColumns({"_pid": pid, "_pos": pos})
    part = ["_slice", "_pid", *group_cols]
    grouped = ranged.where(" and ".join(f"`{c}` is not null" for c in group_cols) or "true")  # others meet no offset
    counts = grouped.groupBy(*part).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_slice", "_pid") if restart else Window.orderBy(*group_cols, "_slice", "_pid")
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # one row per (slice, partition, group): bounded by partitions x groups; stored, so
    # that Spark knows its size and the rows meet it where they are read
    offsets = materialize(offsets.select(*part, "_offset", "_first"), "offsets")
    out = ranged.join(offsets, part, "inner")
    seq = F.col("_offset") + (F.col("_pos") - F.col("_first")) + F.lit(start)
    out = out.withColumn(name, seq).drop("_slice", "_mid", "_pid", "_pos", "_offset", "_first", "_cnt")
    if checkpoint:
        return materialize(out, name)
    return out


def with_read_position(stored: DataFrame) -> DataFrame:
    """A table read from files, with the file and the split of every row."""
    return stored.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")
    )


def numbered_as_read(kept: DataFrame, name: str = "seq", start: int = 1) -> DataFrame:
    """SRT-5: add ``name`` = ``start`` + number of kept rows before this one, in
    the order in which the files hold them (files by path, splits by place).

    ``kept`` comes from one ``with_read_position`` table by filters, projections
    and joins with tables small enough to be broadcast, so rows stay in their
    splits.  Kept rows are counted per split; their prefix sums (one row per
    split) are the offsets, and within a split the running id of the task
    counts.  Nothing is sorted, shuffled or written but the offsets.  A row
    that does not find its split's offset, or lies beyond its count (a scan
    that was not cut alike twice), is an error.
    """
    from ..session import materialize

    ids = kept.withColumn("_mid", F.monotonically_increasing_id())
    counts = ids.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    at = F.col("_mid") - F.col("_first")
    number = F.when((at >= 0) & (at < F.col("_n")), F.col("_before") + at + F.lit(start)).otherwise(
        F.raise_error(F.lit("a row was read in another split than when rows were counted"))
    )
    return ids.join(offsets, ["_file", "_split"], "left").withColumn(name, number).drop(
        "_file", "_split", "_mid", "_n", "_first", "_before"
    )


def top_k_per_group(df: DataFrame, group_cols: list[str], order_col: str, k: int, salt_buckets: int | None = None) -> DataFrame:
    """Exact first ``k`` rows per group by ``order_col`` (ascending), with a
    ``rank`` column (1..k) and the group size ``n_group``.

    A group holding a third of the rows is never sorted in one task: rows
    are first split by a hash salt, each (group, salt) keeps its own first k,
    and only those ``salt_buckets * k`` candidates per group are ranked.
    """
    if salt_buckets is None:
        # as many salts as shuffle partitions (at least 64): a hot group's
        # share per task shrinks as the cluster and its partition count grow
        salt_buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.abs(F.xxhash64(F.col(order_col))) % salt_buckets
    s = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(order_col)
    cand = s.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_group"))
    w2 = Window.partitionBy(*group_cols).orderBy(order_col)
    top = cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt")
    return top.join(sizes, list(group_cols), "inner")
