"""Mixing: water-filled targets, flow over overlapping sources, selection."""

import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=3) | st.none(), st.integers(0, 1000), max_size=8))
def test_targets(sizes):
    got = mixing.share_targets(sizes, (3, 1, 2), 1.5, 2)
    assert set(got) == set(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
    names = sorted(sizes, key=mixing.source_order)
    rate = {s: got[s] / (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    assert all(got[s] <= 2 * sizes[s] * (1 + 1e-9) for s in sizes)
    free = [s for s in names if got[s] < 2 * sizes[s] * (1 - 1e-9)]
    for s in free:  # all free sources grow alike, and no full one could have more
        assert rate[s] == pytest.approx(rate[free[0]])
    assert all(rate[s] <= rate[free[0]] * (1 + 1e-9) for s in names if free)


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(st.sampled_from([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(0, 50)),
    st.fixed_dictionaries({s: st.integers(0, 80) for s in "abc"}),
)
def test_flow_is_maximal_and_cheapest(capacity, quotas):
    def largest(epochs):  # max flow of a bipartite graph = least cut over sets of sources
        best = None
        for mask in range(8):
            inside = {s for i, s in enumerate("abc") if mask >> i & 1}
            cut = sum(quotas[s] for s in inside) + sum(epochs * n for p, n in capacity.items() if set(p) - inside)
            best = cut if best is None else min(best, cut)
        return best

    flow = mixing.route(capacity, quotas, 3)
    given_by = {p: sum(f.values()) for p, f in flow.items()}
    for s in "abc":
        assert sum(f.get(s, 0) for f in flow.values()) <= quotas[s]
    assert all(v >= 0 for f in flow.values() for v in f.values())
    for r in (1, 2, 3):  # the part within the first r epochs is a maximum flow for them
        assert sum(min(n, r * capacity[p]) for p, n in given_by.items()) == largest(r)


def words(text):
    return len(WORD.findall(text or ""))


def check(rows, sizes_of_source, exact=True):
    taken = defaultdict(int)
    want = mixing.share_targets(sizes_of_source, (3, 1, 2), 1.5, 2)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == want[r["source"]] and r["source_size"] == sizes_of_source[r["source"]]
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5 + 1e-6


def test_mix(awkward, corpus, none_at_all):
    for docs in (awkward, corpus):
        sizes = defaultdict(int)
        for r in docs.collect():
            sizes[r["source"]] += words(r["text"])
        for bits in (2, 16):
            mixed = mixing.mix(docs, F.array("source"), (3, 1, 2), bucket_bits=bits, keep=("doc_id", "source"))
            rows = mixed.collect()
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted(
                (r["doc_id"] is None, r["doc_id"] or 0, words(r["text"])) for r in docs.collect()
            )
            check(rows, sizes)
            again = mixing.mix(docs.repartition(5), F.array("source"), (3, 1, 2), bucket_bits=bits, keep=("doc_id", "source"))
            assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert mixing.mix(none_at_all, F.array("source"), (3, 1, 2)).count() == 0


def test_mix_overlapping_sources(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 7), ["a"] if i % 3 else ["a", "b"] if i % 2 else ["b", None]) for i in range(300)],
        "doc_id long, text string, sources array<string>",
    )
    rows = mixing.mix(docs, F.col("sources"), (1, 1, 1), share=1.0, most=3).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) > 0
