"""Jaccard join and components against brute force on whole sets."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import jaccard
from ledgerlens.llm.components import components


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = sorted((self.find(x), self.find(y)))
        self.up[b] = a


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain(docs, percent=80):
    """Counter of (doc_id, size, component) by comparing all pairs."""
    rows = [(i, r["doc_id"], shingles(r["text"])) for i, r in enumerate(docs.collect())]
    forest = Forest()
    for i, _, a in rows:
        for j, _, b in rows:
            if i < j and a and b:
                if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                    both = len(a & b)
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        forest.join(i, j)
    least = {}
    for i, d, _ in rows:
        root = forest.find(i)
        least[root] = min((x for x in (d, least.get(root)) if x is not None), default=None)
    return Counter((d, len(s), least[forest.find(i)]) for i, d, s in rows)


def got(docs, percent=80):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs, percent).collect())


def near_copies(seed):
    """Clusters of chained near copies around the threshold, with common lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    common, rows = " ".join(word() for _ in range(30)), []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(base) + (f" {common}" if r.random() < 0.5 else ""))
            base = [w if r.random() > 0.02 else word() for w in base]
    rows += [rows[0]] * 5 + [rows[1].upper()]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_awkward_and_corpus(awkward, corpus, none_at_all):
    assert got(awkward) == plain(awkward)
    assert got(corpus) == plain(corpus)
    assert jaccard.link(none_at_all).count() == 0


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 80), (3, 50)])
def test_chains_of_near_copies(spark, seed, percent):
    docs = spark.createDataFrame(near_copies(seed), "doc_id long, text string").repartition(4)
    want = plain(docs, percent)
    assert len({c for _, _, c in want}) < len(want)
    assert got(docs, percent) == want


def test_any_order_of_shingles_gives_the_same_links(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(4), "doc_id long, text string").repartition(4)
    want = plain(docs)
    for order in (np.zeros(1 << jaccard.LEVEL_BITS, np.uint8), np.arange(1 << jaccard.LEVEL_BITS, dtype=np.int64).astype(np.uint8)):
        monkeypatch.setattr(jaccard, "levels", lambda _, order=order: order)
        assert got(docs) == want


def test_keep_first_tells_components_apart_by_more_than_the_id(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(30))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c").upper()), (None, "two words"),  # unlinked but for c
        (7, text("d")), (7, text("e")),  # one id, two texts
        (8, text("b") + " more"), (9, text("e") + " more"), (9, text("f")),  # copies of rows above, and 9 used again
        (None, ""), (None, None), (7, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_first(docs).collect())
    one_c = [t for d, t in kept if d is None and t and t.lower() == text("c")]
    assert len(one_c) == 1
    assert kept == Counter(
        [(None, text("a")), (None, text("b")), (None, one_c[0]), (None, "two words")]
        + [(7, text("d")), (7, text("e")), (9, text("f")), (None, ""), (None, None), (7, "")]
    )


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 340)]
    forest = Forest()
    for u, v in edges:
        forest.join(u, v)
    linked = {x for u, v in edges if u != v for x in (u, v)}
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((x["node"], x["root"]) for x in rows) == sorted((x, forest.find(x)) for x in linked)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
