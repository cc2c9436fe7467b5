"""Centroid clustering with Ptolemaic pivots.

Lloyd's rounds over integer vectors.  A few pivots are fixed before the first
round and every vector stores its distances to them once.  For pivots p, s the
inequality of Ptolemy gives, for a vector x and a centroid c,

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

so a round reads the cached distances, computes those of the few centroids and
bounds all pairs without their components.  Bounds are lowered by more than
their rounding error.  The centroid with the least bound is measured exactly;
of the others only those whose bound does not exceed that distance survive and
are measured too, in whole numbers.  Pivots and bounds change the work, never
the result.

Vectors never move: a round is a scan whose tasks send one row for each cluster,
dimension and limb; the driver holds pivots and centroids only.  Sums are exact
whatever their size: they travel in limbs of 48 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize

LIMB = 48
#: Rounding errors of bounds and distances stay far below this share.
SLACK = 1e-11
LONG = (1 << 63) - 1


def kept_vectors(rows: DataFrame, dims: int, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x), as doubles that hold integers, of the vectors
    with exactly ``dims`` components, none null or non-finite (scaled or not)."""
    wide = F.transform(F.col(vector), lambda e: e.cast("double") * F.lit(float(scale)))
    fits = (F.size(vector) == dims) & F.forall(
        wide, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))
    )
    floored = F.transform(  # floor() returns a long, too narrow for large doubles, which are whole already
        wide, lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e)
    )
    return rows.where(F.coalesce(fits, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), floored.alias("vector")
    )


def seed_key(seed: int):
    """Lowercase hex sha256 of ``seed:vec_id``; a null id has no digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def small(dims: int) -> float:
    """Below this size of all components, 64-bit integers hold every squared distance."""
    return float(1 << 30) / max(1, dims) ** 0.5


def whole(x: np.ndarray) -> np.ndarray:
    """Integers of whole doubles: 64-bit where squared distances fit, else Python's."""
    if not x.size or np.abs(x).max() < small(x.shape[1]):
        return x.astype(np.int64)
    return np.array([[int(e) for e in row] for row in x], dtype=object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` from the integers ``c``."""
    if x.dtype == object or any(abs(e) >= small(len(c)) for e in c):
        x, c = x.astype(object), c.astype(object)
    else:
        c = c.astype(np.int64)
    d = x - c
    return (d * d).sum(axis=1)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each the farthest from those before it."""
    chosen = [0]
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.nan_to_num(np.square(sample - sample[0]).sum(axis=1), posinf=np.finfo(float).max)
        while len(chosen) < n and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            far = np.nan_to_num(np.square(sample - sample[chosen[-1]]).sum(axis=1), posinf=np.finfo(float).max)
            gap = np.minimum(gap, far)
    return sample[chosen]


class Pivots(NamedTuple):
    """Fixed pivots and the pairs whose distance divides a bound."""

    points: np.ndarray  # float64 [pivots, dims], whole numbers

    def distances(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.sqrt(np.stack([np.square(x - p).sum(axis=1) for p in self.points], axis=1))

    def of_centroids(self, centroids: np.ndarray) -> np.ndarray:
        """As ``distances``; differences from integers beyond 2^53 are taken exactly first."""
        exact = [[int(e) for e in p] for p in self.points]
        out = np.zeros((len(centroids), len(exact)))
        for i, c in enumerate(centroids):
            for j, p in enumerate(exact):
                total = sum((int(a) - b) ** 2 for a, b in zip(c, p, strict=True))
                try:
                    out[i, j] = float(total) ** 0.5
                except OverflowError:
                    out[i, j] = np.inf
        return out

    def bounds(self, to_vectors: np.ndarray, to_centroids: np.ndarray) -> np.ndarray:
        """[vectors, centroids]: no more than the true distance; 0 where nothing is known."""
        best = np.zeros((len(to_vectors), len(to_centroids)))
        between = self.distances(self.points)
        with np.errstate(over="ignore", invalid="ignore"):
            for p in range(len(self.points)):
                for s in range(p):
                    if between[p, s] > 0:
                        one = np.outer(to_vectors[:, p], to_centroids[:, s])
                        other = np.outer(to_vectors[:, s], to_centroids[:, p])
                        low = (np.abs(one - other) - SLACK * (one + other)) / between[p, s] * (1 - SLACK)
                        np.maximum(best, np.where(np.isfinite(low), low, 0), out=best)
        return best


class Nearest(NamedTuple):
    cluster: np.ndarray
    distance: np.ndarray  # exact squares
    measured: int  # exact distances computed


def nearest(x: np.ndarray, low: np.ndarray, centroids: np.ndarray) -> Nearest:
    """The nearest centroid of each row (ties: the smaller number) by bounds first."""
    n, ints = len(x), whole(x)
    guess = low.argmin(axis=1) if n else np.zeros(0, int)
    best = np.zeros(n, dtype=object if ints.dtype == object else np.int64)
    cluster, measured = guess.copy(), n
    for k in range(len(centroids)):
        rows = np.flatnonzero(guess == k)
        if len(rows):
            found = squared(ints[rows], centroids[k])
            best = best.astype(object) if found.dtype == object else best
            best[rows] = found
    for k in range(len(centroids)):
        near = np.array([_root(b) for b in best]) if best.dtype == object else np.sqrt(best)
        rows = np.flatnonzero((guess != k) & (low[:, k] <= near * (1 + SLACK)))
        if not len(rows):
            continue
        measured += len(rows)
        found = squared(ints[rows], centroids[k])
        best = best.astype(object) if found.dtype == object else best
        closer = (found < best[rows]) | ((found == best[rows]) & (k < cluster[rows]))
        closer = closer.astype(bool)
        cluster[rows[closer]] = k
        best[rows[closer]] = found[closer]
    return Nearest(cluster, best, measured)


def _root(square: int) -> float:
    try:
        return float(square) ** 0.5
    except OverflowError:
        return np.inf


def _rows(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(float)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) with value = sum of limb * 2^(48 * place); all but the top are not negative."""
    place = 0
    while not -(1 << 62) <= value < 1 << 62:
        value, low = value >> LIMB, value & ((1 << LIMB) - 1)
        yield place, low
        place += 1
    yield place, value


def assigned(batch: pa.RecordBatch, pivots: Pivots, centroids: np.ndarray) -> tuple[np.ndarray, Nearest]:
    x = _rows(batch, 1, centroids.shape[1])
    low = pivots.bounds(_rows(batch, 2, len(pivots.points)), pivots.of_centroids(centroids))
    return x, nearest(x, low, centroids)


def moved(vectors: DataFrame, pivots: Pivots, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of means, empty clusters as they were."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, now = shared.value
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            x, found = assigned(batch, points, now)
            ints = whole(x)
            for c in np.unique(found.cluster):
                rows = ints[found.cluster == c]
                total[c, :dims] += rows.sum(axis=0).astype(object)
                total[c, dims] += len(rows)
        flat = [(c, d, place, limb) for (c, d), v in np.ndenumerate(total) if v for place, limb in _limbs(int(v))]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["cluster", "dim", "place", "limb"]
        )

    rows = (
        vectors.mapInArrow(sums, "cluster int, dim int, place int, limb long")
        .groupBy("cluster", "dim", "place").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb"))
        .collect()  # k x (dims + 1) rows for each limb, whatever the input
    )
    total = np.zeros((k, dims + 1), dtype=object)
    for r in rows:
        total[r["cluster"], r["dim"]] += int(r["limb"]) << (LIMB * r["place"])
    out = centroids.copy()
    for c in range(k):
        if total[c, dims]:
            out[c] = [int(v) // int(total[c, dims]) for v in total[c, :dims]]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(e)) for e in centroid).encode()).hexdigest()


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(
    rows: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    seed: int = 3,
    pivots: int = 5,
    sample_rows: int = 1024,
    vector: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite.
    Centroids start as the ``k`` kept rows with the smallest sha256 of
    "seed:vec_id" (equal ids: the smaller vector first; fewer rows, fewer
    clusters), then move ``rounds`` times.  Repeated rows count each; null ids
    take part.  A distance or sum that a long cannot hold (components beyond
    about 2^28) is null, its cluster still right.  Pivots come from
    ``sample_rows`` rows by a hash of the id.  No kept vector: no rows.  Other
    columns are not read.
    """
    spark = rows.sparkSession
    kept = kept_vectors(rows, dims, vector, scale)
    starts = kept.orderBy(seed_key(seed), "vector").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    now = np.array([[int(e) for e in r["vector"]] for r in starts], dtype=object)
    sample = kept.orderBy(F.xxhash64("vec_id"), "vector").limit(sample_rows).collect()
    points = Pivots(spread(np.array([r["vector"] for r in sample], dtype=float), pivots))
    fixed = spark.sparkContext.broadcast(points)

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = fixed.value.distances(_rows(batch, 1, dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(far), pa.list_(pa.float64()))],
                names=["vec_id", "vector", "far"],
            )

    vectors = materialize(
        kept.mapInArrow(cached, "vec_id long, vector array<double>, far array<double>"), "pivot-distances"
    )
    for _ in range(rounds):
        now = moved(vectors, points, now)
    last = spark.sparkContext.broadcast((points, now))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = assigned(batch, *last.value)
            distance = [int(d) if d <= LONG else None for d in found.distance]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.cluster.astype(np.int32)), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    placed = materialize(vectors.mapInArrow(final, "vec_id long, cluster int, distance long"), "clusters")
    counted = placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"),
        F.count("*").alias("n"), F.count("distance").alias("known"),
    ).collect()  # at most k rows
    held = lambda v: v if v is not None and v <= LONG else None
    inertias = {r["cluster"]: int(r["sum"]) if r["n"] == r["known"] else None for r in counted}
    whole_sum = None if None in inertias.values() else sum(inertias.values())
    facts = [(c, held(v), held(whole_sum), centroid_digest(now[c])) for c, v in inertias.items()]
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(by_cluster), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])
