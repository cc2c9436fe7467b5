"""Clusters against a plain loop in whole numbers; bounds against true distances."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import centroids

LONG = (1 << 63) - 1


def plain(rows, k=8, rounds=10, dims=64, seed=3):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(1024.0 * x) for x in v):
            w = [1024.0 * x for x in v]
            kept.append((vec_id, [math.floor(x) for x in w]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(now))
    for _ in range(rounds):
        groups = [[] for _ in now]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        now = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, now, strict=True)]
    placed = [(i, *near(v)) for i, v in kept]
    fit = lambda n: n if n is not None and n <= LONG else None
    inertia = lambda ds: None if any(d > LONG for d in ds) else fit(sum(ds))
    of = {c: inertia([d for _, d, x in placed if x == c]) for c in {x for _, _, x in placed}}
    total = None if any(d > LONG for _, d, _ in placed) else fit(sum(d for _, d, _ in placed))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, c, fit(d), of[c], total, digest[c]) for i, d, c in placed)


def got(table, **options):
    return Counter(tuple(r) for r in centroids.cluster(table, **options).collect())


def test_awkward_vectors(spark):
    r = random.Random(1)
    vec = lambda spread=1.0: [r.gauss(0, spread) for _ in range(4)]
    rows = [(i, vec()) for i in range(60)] + [(5, vec()), (5, vec()), (None, vec()), (None, vec())]
    rows += [(70, None), (71, []), (72, [1.0, 2.0, 3.0]), (73, [1.0, None, 2.0, 3.0]), (74, [1.0, math.nan, 2.0, 3.0])]
    rows += [(75, [math.inf, 0.0, 0.0, 0.0]), (76, [1e308, 0.0, 0.0, 0.0]), (77, [0.0] * 5), (78, [0.0] * 4), (78, [0.0] * 4)]
    table = spark.createDataFrame([(*x, "s", 1) for x in rows], "vec_id long, embedding array<double>, cluster string, distance long").repartition(3)
    for options in ({"k": 5, "rounds": 6}, {"k": 100, "rounds": 1}, {"k": 1, "rounds": 2}, {"k": 3, "rounds": 0}):
        assert got(table, dims=4, **options) == plain(rows, dims=4, **options)


def test_values_beyond_64_bits(spark):
    r = random.Random(2)
    for size in (1e8, 1e16, 1e30, 1e200):
        rows = [(i, [r.choice((-1, 1)) * r.random() * size for _ in range(3)]) for i in range(40)] + [(41, [0.5, 1.0, -0.25])]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
        assert got(table, k=4, rounds=3, dims=3) == plain(rows, k=4, rounds=3, dims=3)


def test_ties_and_copies(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)] + [(i, [0.5, 0.5]) for i in range(30, 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(table, k=6, rounds=4, dims=2) == plain(rows, k=6, rounds=4, dims=2)


def test_nothing_kept(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroids.cluster(spark.createDataFrame(rows, schema)).collect() == []


@pytest.mark.parametrize("pivots", [1, 2, 8])
def test_bounds_never_exceed_distances(pivots):
    r = np.random.default_rng(pivots)
    for size in (3, 2000, 1e7, 1e12, 1e160):
        x = np.floor(r.normal(size=(300, 8)) * size)
        points = centroids.Pivots(centroids.spread(x[:100], pivots))
        c = np.array([[int(e) for e in row] for row in np.vstack([x[:5], np.floor(r.normal(size=(5, 8)) * size)])], dtype=object)
        low = points.bounds(points.distances(x), points.of_centroids(c))
        for i in range(len(x)):
            for j in range(len(c)):
                true = sum((int(a) - b) ** 2 for a, b in zip(x[i], c[j], strict=True))
                assert int(low[i, j]) ** 2 <= true


def test_bounds_spare_distances():
    r = np.random.default_rng(7)
    middle = r.normal(size=(8, 64)) * 1000
    x = np.floor(np.repeat(middle, 200, axis=0) + r.normal(size=(1600, 64)) * 20)
    c = np.array([[int(e) for e in row] for row in middle], dtype=object)
    points = centroids.Pivots(centroids.spread(x[::7], 5))
    found = centroids.nearest(x, points.bounds(points.distances(x), points.of_centroids(c)), c)
    assert found.measured < 2 * len(x)  # of 8 * len(x)
    assert (found.cluster == np.repeat(np.arange(8), 200)).all()


def test_limbs():
    for v in (0, 1, -1, 1 << 61, -(1 << 61), 1 << 62, -(1 << 62) - 1, 3**200, -(3**200)):
        assert sum(limb << (centroids.LIMB * place) for place, limb in centroids._limbs(v)) == v
        assert all(abs(limb) < 1 << 63 for _, limb in centroids._limbs(v))
