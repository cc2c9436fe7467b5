"""N-gram Jaccard join: grouped prefix join over sets of word shingles.

1. Shingle hashes are counted over all documents into a table of fixed size;
   it orders shingles from rare to frequent (hash breaks ties).  Any order
   gives the same links; this one keeps common passages out of prefixes.
2. Documents with one set are one class; classes with the same size and the
   same prefix in that order are one group.  Two sets of sizes n and m reach the
   threshold only if they share a shingle among the first n - o + 1 of one and
   m - o + 1 of the other, o being the overlap they need.  So a shingle at place
   i of a set of size n speaks only for partners up to a size that falls with i,
   and a pair of groups passes if each size is within the other's.
3. Within each prefix shingle, groups are first paired with one hub only, the
   group where it speaks for the largest partners; then, for shingles whose
   members are still in different components, with each other.  Pairs that pass
   are expanded to classes.
4. The classes in such pairs are read again and verified on whole sets.

No step lists the pairs of a group of copies: copies are one class, and near
copies are joined through the smallest of them before any other pair is made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.batches import by_bytes
from ledgerlens.llm.components import components
from ledgerlens.session import materialize

WORDS, LEVEL_BITS, RANGES = 5, 22, 64
FAN_IN = 64  # count tables added in one group
MOST = (1 << 31) - 1  # counts beyond are equally frequent
CACHED_WORDS = 200_000
BROADCAST_IDS = 1_000_000
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)


class _WordHashes(dict):
    """Remembers the hash of each word it was asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of 64-bit shingle hashes of texts, sorted; one for each task."""

    def __init__(self) -> None:
        self.known = _WordHashes()

    def hashes(self, text: bytes | None) -> np.ndarray:
        # bytes.lower() changes A-Z only and bytes.split() splits at blank and \t..\r
        words = text.lower().split() if text else []
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if len(h) == 0:
            return h
        if len(h) < WORDS:
            x = (h * _ODD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))
        else:
            n = len(h) - WORDS + 1
            x = h[:n] * _ODD[0]
            for k in range(1, WORDS):
                x += h[k : k + n] * _ODD[k]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x.sort()
        return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _count_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, counts = Shingler(), np.zeros(1 << LEVEL_BITS, np.int32)
    for batch in by_bytes(batches, 0):
        for text in _texts(batch, 0):
            found = shingler.hashes(text) >> np.uint64(64 - LEVEL_BITS)
            np.add.at(counts, found.astype(np.int64), 1)
    parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, RANGES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])


def _add_counts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << LEVEL_BITS) // RANGES, np.int64)
    for c in frame["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.int32)
    first, total = frame.iloc[0], np.minimum(total, MOST).astype(np.int32)
    return pd.DataFrame({"part": [first["part"]], "task": [first["task"]], "counts": [zlib.compress(total.tobytes(), 1)]})


def bucket_counts(documents: DataFrame) -> np.ndarray:
    """In how many documents the shingles of each hash bucket occur.

    Counts cover all documents.  The table has 2^22 numbers whatever the input;
    tasks send their counts compressed, in 64 ranges, and at most ``FAN_IN`` of
    them are added in one group, level by level.
    """
    schema = "part int, task long, counts binary"
    counted = documents.select("text").mapInArrow(_count_levels, "part int, counts binary")
    rows = materialize(counted.select("part", F.spark_partition_id().cast("long").alias("task"), "counts"), "counts")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        added = rows.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("part", "task").applyInPandas(_add_counts, schema)
        rows = materialize(added, "counts")
    total = np.zeros(1 << LEVEL_BITS, np.int32)
    for r in rows.collect():
        width = len(total) // RANGES
        total[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    return total


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts in eighths of powers of two, one byte each."""
    parts = np.split(counts, RANGES)  # logarithms of a part at a time
    return np.concatenate([np.floor(8 * np.log2(np.maximum(1, p))).astype(np.uint8) for p in parts])


def prefix_length(n: int, percent: int) -> int:
    """Sets of n and m >= percent/100 n share at least ceil(percent/100 n)."""
    return n - (percent * n + 99) // 100 + 1


def describe(documents: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """doc_id, key, n, class, gid, prefix of each row (key: hash of the text, class:
    digest of the set, gid: digest of the prefix)."""
    shared = documents.sparkSession.sparkContext.broadcast(levels(counts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, order = Shingler(), shared.value
        for batch in by_bytes(batches, 1):
            n, classes, gids, prefixes = [], [], [], []
            for text in _texts(batch, 1):
                found = shingler.hashes(text)
                n.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()))
                bucket = (found >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
                by = np.argsort(order[bucket], kind="stable")[: prefix_length(len(found), percent) if len(found) else 0]
                prefix = found[by]
                prefixes.append(prefix.view(np.int64))
                gids.append(xxhash.xxh3_64_intdigest(prefix.tobytes()) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(classes, pa.binary()),
                    pa.array(gids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "class", "gid", "prefix"],
            )

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return ids.mapInArrow(rows, "doc_id long, key long, n long, class binary, gid long, prefix array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in by_bytes(batches, 0):
        found = [shingler.hashes(t) for t in _texts(batch, 0)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()),
                pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
            ],
            names=["class", "hashes"],
        )


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids: by broadcast where they are few, else by a shuffle."""
    ids = materialize(ids, "wanted")
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), "text")
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "__id", "left_semi").select("text")


def verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold, as (u, v).

    One document of each class in question is read again; a set moves once for
    each pair it is in.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ids = wanted.join(classes, "class").select(F.coalesce("rep", F.lit(-(1 << 63))).alias("__id")).distinct()
    sets = (
        texts_of(documents, ids).mapInArrow(_sets, "class binary, hashes array<long>")
        .join(wanted, "class", "left_semi")
        .groupBy("class").agg(F.first("hashes").alias("hashes"))
    )
    sets = materialize(sets, "sets")
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(enough).select(F.col("a").alias("u"), F.col("b").alias("v"))


def speaks_for(n: Column, place: Column, percent: int) -> Column:
    """Largest partner for which place ``place`` (from 0) of a set of size ``n``
    lies in the prefix: overlap (n + m) * percent / (100 + percent) <= n - place."""
    return F.floor((n - place) * (100 + percent) / F.lit(percent)).cast("int") - n


def passes(x: str, y: str) -> Column:
    """Each side's shingle speaks for a partner of the other's size."""
    return (F.col(f"{x}.n") <= F.col(f"{y}.reach")) & (F.col(f"{y}.n") <= F.col(f"{x}.reach"))


def link(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, key, n_shingles, component_id and root of each row.

    Two documents are linked when their sets of 5-word shingles (fewer words:
    the whole sequence) have 100 * intersection >= ``percent`` * union;
    component_id is the smallest id reachable by links, its own included.  Null,
    empty and blank texts have no shingles and no links.  Repeated rows and
    copies get the same component; a null id takes the smallest id it is linked
    with, else stays null.  Ids may be null or used twice, so component_id does
    not tell components apart; ``root`` does: the smallest class of the component,
    null where there are no shingles.  Other columns are not read; an empty table
    gives no rows.
    """
    described = materialize(describe(documents, bucket_counts(documents), percent), "shingled")
    some = described.where(F.col("n") > 0)
    classes = materialize(
        some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("gid").alias("gid")),
        "classes",
    )
    heads = classes.groupBy("gid", "n").agg(F.min("class").alias("head"), F.max("class").alias("last"))
    # one exchange by shingle serves the aggregate and the join
    postings = (
        some.select(F.posexplode("prefix").alias("place", "token"), "gid", F.col("n").cast("int").alias("n"))
        .select("token", "gid", "n", speaks_for(F.col("n"), F.col("place"), percent).alias("reach"))
        .repartition("token")
    )
    # numbers only, so that groups are kept in a hash table; one order picks both halves of the hub
    widest = F.shiftleft(F.col("reach").cast("long"), 31) + F.pmod(F.xxhash64("gid", "n"), F.lit(1 << 31))
    several = (F.col("low_gid") < F.col("high_gid")) | (F.col("low_n") < F.col("high_n"))
    ends = postings.groupBy("token").agg(
        F.max_by("gid", widest).alias("hub_gid"), F.max_by("n", widest).alias("hub_n"),
        F.min("gid").alias("low_gid"), F.max("gid").alias("high_gid"), F.min("n").alias("low_n"), F.max("n").alias("high_n"),
        F.max("reach").alias("hub_reach"),
    ).where(several)
    hubs = ends.select("token", "hub_gid", "hub_n", "hub_reach")
    shared = materialize(postings.join(hubs, "token").distinct(), "postings")

    def head(side: str) -> DataFrame:
        return heads.select(F.col("gid").alias(f"{side}_gid"), F.col("n").alias(f"{side}_n"), F.col("head").alias(side))

    stars = (
        shared.where((F.col("gid") != F.col("hub_gid")) | (F.col("n") != F.col("hub_n")))
        .where((F.col("n") <= F.col("hub_reach")) & (F.col("hub_n") <= F.col("reach")))
        .select(F.col("gid").alias("a_gid"), F.col("n").alias("a_n"), F.col("hub_gid").alias("b_gid"), F.col("hub_n").alias("b_n"))
        .distinct()
        .join(head("a"), ["a_gid", "a_n"]).join(head("b"), ["b_gid", "b_n"])
        .select("a", "b")
    )
    inside = (
        classes.join(heads.where(F.col("head") != F.col("last")), ["gid", "n"])
        .where(F.col("class") != F.col("head"))
        .select(F.col("class").alias("a"), F.col("head").alias("b"))
    )
    first_pairs = materialize(
        stars.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"
    )
    first_links = materialize(verified(documents, classes, first_pairs, percent), "links")
    near = components(first_links)

    # what the stars left apart: members of one shingle or group in different components
    rooted = materialize(
        classes.join(near.withColumnRenamed("node", "class"), "class", "left").select(
            "class", "gid", "n", F.coalesce("root", "class").alias("root")
        ),
        "rooted",
    )
    group_roots = rooted.groupBy("gid", "n").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    torn = (
        shared.join(group_roots, ["gid", "n"])
        .groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("token")
    )
    open_rows = materialize(
        shared.join(torn, "token").join(rooted, ["gid", "n"]).select("token", "class", "n", "reach", "root")
        .unionByName(
            rooted.join(group_roots.where(F.col("low") != F.col("high")).select("gid", "n"), ["gid", "n"])
            .select(F.col("gid").alias("token"), "class", "n", F.col("n").alias("reach"), "root")
        ),
        "open",
    )
    x, y = open_rows.alias("x"), open_rows.alias("y")
    rest = (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.root") != F.col("y.root")))
        .where(passes("x", "y"))
        .select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        .distinct()
        .join(first_pairs, ["a", "b"], "left_anti")
    )
    rest_pairs = materialize(rest, "pairs")
    links = first_links.unionByName(verified(documents, classes, rest_pairs, percent))
    whole = components(links)
    by_class = classes.join(whole.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "rep", F.coalesce("root", "class").alias("root")
    )
    least = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = by_class.join(least, "root").select("class", "component_id", "root")
    return described.join(ids, "class", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root"
    )


def keep_first(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component, whole rows.

    Of rows that repeat that id inside the component one stays; rows of other
    components stay whatever their ids.  A row without shingles stays, once for
    each id and text.  A null id counts as the smallest.
    """
    lowest = F.lit(-(1 << 63))
    linked = link(documents, percent).select(
        "root",
        F.when(F.col("n_shingles") == 0, F.struct("key", "doc_id")).alias("alone"),
        F.struct(F.coalesce("doc_id", lowest).alias("__id"), F.col("key").alias("__key")).alias("row"),
    )
    first = linked.groupBy("root", "alone").agg(F.min("row").alias("row")).select("row.*").distinct()
    rows = documents.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), lowest)).withColumn(
        "__key", F.xxhash64("text")
    )
    same = Window.partitionBy("__id", "__key").orderBy("__id")
    one = rows.withColumn("__row", F.row_number().over(same)).where(F.col("__row") == 1)
    return one.join(first, ["__id", "__key"], "left_semi").select(*documents.columns)
