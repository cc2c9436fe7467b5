"""Exact top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, k):
    vectors = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for qi, q in {(i, tuple(v)) for i, v in vectors if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in vectors if i != qi)
        out |= {(qi, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def check(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exact = [(r["vec_id"], r["embedding"]) for r in table.collect()]  # as floats
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 10 == 0, **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(exact, options.get("k", 10))


def vectors(seed, n, dims, clusters):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)], i % 3, "s") for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"k": 3, "fanout": 3, "page_rows": 16, "block_rows": 4, "sample_rows": 12}])
def test_exact(spark, options):
    check(spark, vectors(1, 400, 6, 8), **options)


def test_awkward_rows(spark):
    same = [(1000 + i, [0.5, -0.25], 0, "s") for i in range(60)]
    bad = [
        (2000, None, 0, "s"), (2010, [float("nan"), 1.0], 0, "s"), (2020, [None, 1.0], 0, "s"),
        (2030, [float("inf"), 1.0], 0, "s"), (2040, [], 0, "s"), (2050, [2.0], None, None), (None, [1.0, 1.0], 0, "s"),
        (0, [0.0, 0.0], 0, "s"), (10, [-3.0, 2.0], 0, "s"), (11, [-3.0, 2.0], 0, "s"),
    ]
    check(spark, same + bad, page_rows=7, fanout=3)


def test_few_and_no_rows(spark):
    check(spark, [(10, [1.0, 2.0], 0, "s"), (20, [0.5, 1.0], 0, "s"), (21, [0.5, 1.0], 0, "s")])
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.col("vec_id") % 10 == 0).count() == 0


def test_too_large_components_are_an_error(spark):
    rows = spark.createDataFrame([(10, [1e30, 1.0], 0, "s"), (11, [1.0, 1.0], 0, "s")], SCHEMA)
    with pytest.raises(ValueError, match="2\\^53"):
        topk.top_k(rows, F.col("vec_id") % 10 == 0)


def grown(spark, n):
    """A tree over n vectors of length 1 in tight groups of about 25, and the share of
    (query, vector) pairs in the leaves that the bounded queries visit."""
    r = random.Random(3)
    unit = lambda v: [x / math.hypot(*v) for x in v]
    centres = [unit([r.gauss(0, 1) for _ in range(6)]) for _ in range(n // 25)]
    rows = [(i, unit([x + r.gauss(0, 0.02) for x in r.choice(centres)]), 0, "s") for i in range(n)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = topk.integer_vectors(table)
    tree = topk.build(found, fanout=8, page_rows=32, sample_rows=128)
    queries = found.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    start = topk.bounded(tree, topk.start_of(tree, queries), 3, 16)
    visits = topk.descend(tree, topk.in_blocks(tree, start, 16), 3, False)
    met = visits.join(tree.pages, "node").agg(F.sum(F.length("query_ids") / 8 * F.col("n"))).first()[0]
    return tree, met / (queries.count() * n)


def test_the_share_of_vectors_met_falls_as_the_table_grows(spark):
    (small, few), (large, many) = grown(spark, 400), grown(spark, 3200)
    assert len(large.inner) > len(small.inner) >= 1
    assert many < 0.8 * few < 0.08  # 0.059 and 0.080


def test_nodes_cover_what_lies_below_them(spark):
    import numpy as np

    tree = grown(spark, 800)[0]
    stored = {}
    for level in tree.inner:
        for r in level.collect():
            slots, counts = (np.frombuffer(r[c], "<i8") for c in ("slots", "counts"))
            ups, radii = (np.frombuffer(r[c], "<f8") for c in ("ups", "radii"))
            centres = np.frombuffer(r["centres"], "<f8").reshape(len(slots), -1)
            own = stored[r["node"]][0] if r["node"] else tree.root
            assert np.allclose(ups, np.linalg.norm(centres - own, axis=1))
            stored |= {int(s): (c, rad, int(n)) for s, c, rad, n in zip(slots, centres, radii, counts, strict=True)}
    pages = tree.pages.collect()
    held = {}
    for r in pages:
        assert r["n"] <= 3 * 32
        held[r["node"]] = held.get(r["node"], 0) + r["n"]
        centre, radius, n = stored[r["node"]]
        x = topk.lift(np.frombuffer(r["data"], "<i8").reshape(r["n"], -1).astype(float), tree.largest)
        gaps = np.linalg.norm(x - centre, axis=1)
        assert np.allclose(gaps, np.frombuffer(r["parents"], "<f8"), atol=1e-3) and gaps.max() <= radius + 1e-3
    assert sum(held.values()) == 800 and all(stored[node][2] == n for node, n in held.items())


def test_parent_distances_spare_computations():
    import numpy as np

    computed = []
    plain_distances = topk.distances
    topk.distances = lambda a, b: computed.append(len(b)) or plain_distances(a, b)
    try:
        q, centres = np.array([[50.0, 0.0]]), np.array([[0.0, 0.0, 100.0], [100.0, 0.0, 0.0]])
        root = np.array([100.0, 0.0, 0.0])
        at = np.linalg.norm(np.append(q[0], 0.0) - root)
        near, ceiling = topk.ceilings(
            10000.0, q, np.array([at]), np.array([4900.0]), centres, np.linalg.norm(centres - root, axis=1), np.array([1.0, 1.0])
        )
    finally:
        topk.distances = plain_distances
    assert computed == [1] and near[0, 0] == 0.0
    assert ceiling[0, 1] > 4900 and ceiling[0, 0] == -np.inf
