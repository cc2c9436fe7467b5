"""Near-duplicate documents by b-bit MinHash.

1. Every set of word shingles gets the minima of many seeded hash functions.
   Rows of whole minima are hashed to band keys; then only the low ``bits`` of
   each minimum are retained and packed as bit planes (bit j of all minima side
   by side), so two signatures are compared by a few XORs and bit counts.
2. Copies of a set are one class.  Classes that share a band key are candidates,
   at first each with one hub of the bucket only.
3. The share of agreeing low bits, corrected for chance collisions
   (C = 2^-bits), estimates the similarity: J = (agreeing - C) / (1 - C).
   Candidates whose estimate lies below what a true link reaches go.
4. The rest is confirmed on whole sets: no false link.
5. Buckets whose members are still in different components are compared in full,
   in blocks, the most similar pairs first: each of the ``rungs`` lets pass the
   pairs whose estimate lies between it and the one before, and their links join
   components before the next, so few pairs of one family are ever written.
   Estimates cannot tell pairs just below the threshold from links, so there an
   exact test follows: two sets that must share o of n and m shingles share
   ``DEEP`` of the n - o + DEEP and m - o + DEEP rarest (of all, where o is less).
   A pair is let through in the first band it shares.

A link is missed only if it shares no band or its estimate falls below the
bound; ``layout`` chooses rows a band and ``least_matches`` the bound so that
either has a chance of at most ``MISS`` at the threshold, less above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import by_bytes
from ledgerlens.llm.components import components
from ledgerlens.session import materialize

MISS = 1e-9
LOWEST = -(1 << 63)
CACHED_WORDS = 200_000
#: Shingles that the rarest of both sets must share; more let fewer pairs through.
DEEP = 32
#: Shingles are counted in 2^COUNT_BITS buckets of their hash to tell rare from frequent.
COUNT_BITS = 20
#: Rungs above the lowest, in standard deviations of the matches of a pair at the threshold.
RUNGS = (1.5, 0.5, -0.5, -1.5)
#: Shingles and hash functions handled at once: a few MB whatever the batch.
TILE, FUNCTIONS = 8192, 16


class Layout(NamedTuple):
    bands: int
    rows: int


def layout(percent: int, minima: int) -> Layout:
    """The most rows a band that miss a pair at the threshold with chance ``MISS`` or less."""
    j = percent / 100
    fits = [r for r in range(1, minima + 1) if minima % r == 0 and (1 - j**r) ** (minima // r) <= MISS]
    rows = max(fits, default=1)
    return Layout(minima // rows, rows)


def least_matches(percent: int, minima: int, bits: int) -> int:
    """Pairs at the threshold agree in fewer of the ``minima`` with chance ``MISS`` or less."""
    agree = percent / 100 + (1 - percent / 100) * 2.0**-bits
    below = 0.0
    for m in range(minima + 1):
        ways = math.lgamma(minima + 1) - math.lgamma(m + 1) - math.lgamma(minima - m + 1)
        below += math.exp(ways + m * math.log(agree) + (minima - m) * math.log1p(-agree))
        if below > MISS:
            return m
    return minima


def rungs(percent: int, minima: int, bits: int) -> list[int]:
    """Falling bounds of the matches of a pair; the last is ``least_matches``."""
    agree = percent / 100 + (1 - percent / 100) * 2.0**-bits
    spread = math.sqrt(minima * agree * (1 - agree))
    least = least_matches(percent, minima, bits)
    above = {round(minima * agree + z * spread) for z in RUNGS}
    return [*sorted((m for m in above if least < m <= minima), reverse=True), least]


def estimate(matches: Column | float, minima: int, bits: int) -> Column | float:
    """Collision-corrected similarity of ``matches`` agreeing values."""
    chance = 2.0**-bits
    return (matches / minima - chance) / (1 - chance)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Sets:
    """Sorted sets of 64-bit hashes of word shingles; one object for each task."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known = _WordHashes()
        self.factors = np.random.default_rng(words).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: bytes | None) -> np.ndarray:
        # bytes.lower() changes A-Z only and bytes.split() splits at blank and \t..\r
        found = text.lower().split() if text else []
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        if not len(h):
            return h
        size = min(self.words, len(h))
        n = len(h) - size + 1
        x = np.full(n, size, np.uint64)
        for k in range(size):
            x += h[k : k + n] * self.factors[k]
        return np.unique(_mixed(x))


def minima(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """uint32 [n, sets]: the least value of each of ``n`` seeded hash functions over
    each set; empty sets have the largest value throughout."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.full((n, len(sets)), 0xFFFFFFFF, np.uint32)
    tile: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not tile:
            return
        x = np.concatenate([s for _, s in tile])
        starts = np.cumsum([0, *(len(s) for _, s in tile)])[:-1]
        owners = np.array([i for i, _ in tile])  # one set once: ``part`` below starts a new tile for each long set
        for a in range(0, n, FUNCTIONS):
            values = x[None, :] * odd[a : a + FUNCTIONS, None]
            values += plus[a : a + FUNCTIONS, None]
            values >>= np.uint64(32)
            least = np.minimum.reduceat(values, starts, axis=1).astype(np.uint32)
            out[a : a + FUNCTIONS, owners] = np.minimum(out[a : a + FUNCTIONS, owners], least)
        tile.clear()

    held = 0
    for i, s in enumerate(sets):
        for at in range(0, len(s), TILE):
            part = s[at : at + TILE]
            if held + len(part) > TILE:
                flush()
                held = 0
            tile.append((i, part))
            held += len(part)
    flush()
    return out


def band_keys(least: np.ndarray, shape: Layout) -> np.ndarray:
    """int64 [sets, bands]: one key of each band's rows and number."""
    n = least.shape[1]
    keys = np.empty((n, shape.bands), np.int64)
    for b in range(shape.bands):
        key = np.full(n, b + 1, np.uint64)
        for row in least[b * shape.rows : (b + 1) * shape.rows]:
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
        keys[:, b] = key.view(np.int64)
    return keys


def planes(least: np.ndarray, bits: int) -> np.ndarray:
    """int64 [sets, bits * minima / 64]: bit j of all minima, for each retained j."""
    packed = [np.packbits((least >> np.uint32(j)) & np.uint32(1) == 1, axis=0, bitorder="little") for j in range(bits)]
    return np.ascontiguousarray(np.concatenate(packed).T).view("<i8")


def matches(x: Column, y: Column, n: int, bits: int) -> Column:
    """In how many of ``n`` retained values two signatures agree, by bit counts."""
    words = n // 64
    agreeing = F.lit(n)
    for w in range(words):
        differ = x[w].bitwiseXOR(y[w])
        for j in range(1, bits):
            differ = differ.bitwiseOR(x[j * words + w].bitwiseXOR(y[j * words + w]))
        agreeing = agreeing - F.bit_count(differ)
    return agreeing


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, width, dtype=np.int32), pa.array(values.ravel()))


def signatures(documents: DataFrame, words: int, n: int, shape: Layout, bits: int, seed: int) -> DataFrame:
    """doc_id, n, class (digest of the set), c (its first 8 bytes), planes, keys of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in by_bytes(batches, 1):
            found = [sets.of(t) for t in _texts(batch, 1)]
            digests = [_digest(f) for f in found]
            least = minima(found, n, seed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array(digests, pa.binary()),
                    pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                    _lists(planes(least, bits)), _lists(band_keys(least, shape)),
                ],
                names=["doc_id", "n", "class", "c", "planes", "keys"],
            )

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(rows, "doc_id long, n int, class binary, c long, planes array<long>, keys array<long>")


def whole_sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class, hashes of the wanted classes: the texts of one id of each are read again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in by_bytes(batches, 0):
            found = [sets.of(t) for t in _texts(batch, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(f) for f in found], pa.binary()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
                names=["class", "hashes"],
            )

    ids = materialize(
        wanted.join(classes, "class").select(F.coalesce("rep", F.lit(LOWEST)).alias("id")).distinct(), "wanted"
    )
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), "text")
    found = texts.join(ids, "id", "left_semi").select("text").mapInArrow(rows, "class binary, hashes array<long>")
    return found.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("hashes").alias("hashes"))


def reaching(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold, as (u, v)."""
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(enough).select(F.col("a").alias("u"), F.col("b").alias("v"))


def confirmed(documents: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """``reaching`` of pairs whose sets are read for them."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "wanted")
    return reaching(pairs, materialize(whole_sets(documents, classes, wanted, words), "sets"), percent)


def similar(x: str, y: str, percent: int, n: int, bits: int, matching: tuple[int, int] | None = None) -> Column:
    """Sizes and the corrected estimate allow a link between rows ``x`` and ``y``;
    ``matching``: from the first number of matches, below the second."""
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    least, below = matching or (least_matches(percent, n, bits), n + 1)
    found = matches(F.col(f"{x}.planes"), F.col(f"{y}.planes"), n, bits)
    middle, reach = (least + below - 1) / 2, (below - 1 - least) / 2  # one comparison: the count is a long expression
    return sizes & (F.abs(found - F.lit(middle)) <= reach)


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def hub_pairs(buckets: DataFrame, signed: DataFrame, percent: int, n: int, bits: int) -> DataFrame:
    """Candidate pairs (a, b): each member c of a bucket with the bucket's hub.

    c is 64 bits of a class: where two classes share it, both are candidates.
    """
    x, y = signed.alias("x"), signed.alias("y")
    return (
        buckets.where("c <> hub").select("c", "hub").distinct().alias("p")
        .join(x, F.col("p.c") == F.col("x.c"))
        .join(y, F.col("p.hub") == F.col("y.c"))
        .where(similar("x", "y", percent, n, bits))
        .select(*ordered("x.class", "y.class"))
        .distinct()
    )


def counted(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle of each hash bucket; 2^COUNT_BITS numbers
    whatever the input, summed in Spark."""
    bucket = F.shiftrightunsigned("h", 64 - COUNT_BITS).cast("int")
    rows = sets.select(F.explode("hashes").alias("h")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    found = rows.toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def rarest(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """class, rare: the shingles of each set from the rarest on (hash breaks ties), as
    many as ``across`` needs for its smallest partner.  Any one order would do, and
    32 bits of a shingle: where two agree by chance, a pair more is confirmed."""
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            lists = batch.column(1)
            rare = []
            for at in range(batch.num_rows):
                h = lists[at].values.to_numpy().view(np.uint64)
                order = np.lexsort((h, often[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                first = h[order[: len(h) - (percent * len(h) + 99) // 100 + DEEP]]
                rare.append(first.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rare, pa.list_(pa.int32()))], names=["class", "rare"])

    return sets.mapInArrow(rows, "class binary, rare array<int>")


def across(
    members: DataFrame, facts: DataFrame, percent: int, n: int, bits: int, block_rows: int, matching: tuple[int, int] | None = None
) -> DataFrame:
    """Candidate pairs (a, b) of c in one bucket whose members lie in different components.

    The members of a bucket are dealt into blocks of about ``block_rows``, and
    each pair of blocks is a cell of its own, so a bucket that holds most classes
    is spread over many tasks.  Both sides of the join are one table, shuffled
    once.  It lets only pairs pass whose estimate and rarest shingles allow a
    link, in the first band they share.  ``facts``: one row for each c, with the keys
    of torn buckets; buckets mended since hold no pair of different components.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("other", other)
    cells = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "c", "root")
    cells = cells.join(facts, "c")
    x, y = cells.alias("x"), cells.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "p", "q")]
    once = F.when(F.col("x.p") == F.col("x.q"), F.col("x.c") < F.col("y.c")).otherwise(F.col("x.own") < F.col("y.own"))
    here = F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == F.col("x.key")
    share = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent)).cast("int")
    deep = F.least(F.lit(DEEP), share)
    first = lambda side: F.slice(f"{side}.rare", F.lit(1), F.col(f"{side}.n") - share + deep)
    common = F.size(F.array_intersect(first("x"), first("y")))
    near = similar("x", "y", percent, n, bits, matching) & here & (common + F.col("x.alike") >= deep)
    met = x.join(y, [*same, F.col("x.root") != F.col("y.root"), once, near])
    return met.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def merged(apart: DataFrame, links: DataFrame) -> DataFrame:
    """class, c, root after the links between classes (u, v) have joined components."""
    of = lambda end, name: apart.select(F.col("class").alias(end), F.col("root").alias(name))
    edges = links.join(of("u", "x"), "u").join(of("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return materialize(
        apart.join(moved, "root", "left").select("class", "c", F.coalesce("new", "root").alias("root")), "rooted"
    )


def torn(buckets: DataFrame, apart: DataFrame) -> DataFrame:
    """key, band, c, root (64 bits of it) of the members of buckets that lie in more
    than one component."""
    rows = buckets.select("key", "band", "c").join(apart.select("c", F.xxhash64("root").alias("root")), "c")
    keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return materialize(rows.join(keys.select("key"), "key").select("key", "band", "c", "root"), "torn")


def link(
    documents: DataFrame,
    words: int = 5,
    percent: int = 80,
    functions: int = 128,
    bits: int = 4,
    seed: int = 1,
    block_rows: int = 1024,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Two documents are linked when their sets of ``words``-word shingles (fewer
    words: the whole sequence) have 100 * intersection >= ``percent`` * union;
    component_id is the smallest id reachable by links, its own included, and
    kept says that it is the row's own id.  Null, empty and blank texts have no
    shingles and no links.  Repeated rows get the same component and are kept
    alike.  A null id takes the smallest id it is linked with, else component_id
    stays null and the row is kept.  Ids used twice are told apart by their texts.
    An empty table gives no rows; other columns are not read.

    ``functions`` is a multiple of 64.
    """
    shape = layout(percent, functions)
    described = materialize(signatures(documents, words, functions, shape, bits, seed), "signatures")
    classes = materialize(
        described.where(F.col("n") > 0).groupBy("class").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("c").alias("c"),
            F.first("planes").alias("planes"), F.first("keys").alias("keys"),
        ),
        "classes",
    )
    signed = classes.select("class", "c", "n", "planes")
    postings = classes.select(F.posexplode("keys").alias("band", "key"), "c")
    ends = postings.groupBy("key").agg(F.min("c").alias("hub"), F.max("c").alias("end")).where("hub < end")
    buckets = materialize(postings.join(ends.select("key", "hub"), "key"), "buckets")

    tested = materialize(hub_pairs(buckets, signed, percent, functions, bits), "pairs")
    apart = merged(classes.select("class", "c", F.col("class").alias("root")), confirmed(documents, classes, tested, words, percent))
    members = torn(buckets, apart)
    inside = members.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("band", "key"))).alias("torn"))  # a row a band
    named = classes.select("class", "c", "n", "planes")
    sets = materialize(whole_sets(documents, classes, inside.join(named, "c").select("class"), words), "sets")
    rare = rarest(sets, counted(sets), percent).join(named, "class")
    alike = (F.size("rare") - F.size(F.array_distinct("rare"))).alias("alike")  # equal by chance, counted once below
    facts = rare.join(inside, "c").select("c", "n", "planes", "rare", alike, F.col("torn.key").alias("keys"))
    facts = materialize(facts, "facts")
    of = lambda end: named.select(F.col("c").alias(end), F.col("class").alias(f"{end}_class"))
    below = functions + 1
    for least in rungs(percent, functions, bits):
        close = across(members, facts, percent, functions, bits, block_rows, (least, below))
        close = close.join(of("a"), "a").join(of("b"), "b").select(*ordered("a_class", "b_class"))
        asked = materialize(close.join(tested, ["a", "b"], "left_anti").distinct(), "pairs")
        links = materialize(reaching(asked, sets, percent), "links")
        below = least
        if not links.isEmpty():
            apart = merged(apart, links)
            members = torn(members, apart)

    reps = classes.select("class", "rep").join(apart, "class")
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = apart.select("class", "root").join(least, "root").select("class", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return described.join(ids, "class", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
