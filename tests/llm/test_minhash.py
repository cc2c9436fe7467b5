"""Near duplicates against brute force on whole sets; signatures against their definition."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import minhash


def shingles(text, words):
    found = (text or "").encode().lower().split()
    size = min(words, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if found else frozenset()


def plain(docs, words=3, percent=85):
    """Counter of (doc_id, size, component, kept) by comparing all pairs."""
    rows = [(r["doc_id"], shingles(r["text"], words)) for r in docs.collect()]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (d, least.get(find(i))) if x is not None), default=None)
    return Counter((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(rows))


def got(docs, **options):
    return Counter(tuple(r) for r in minhash.link(docs, **options).collect())


def near_copies(seed, changed=0.02):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    common, rows = " ".join(word() for _ in range(30)), []
    for _ in range(12):
        base = [word() for _ in range(r.randint(2, 60))]
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(base) + (f" {common}" if r.random() < 0.5 else ""))
            base = [w if r.random() > changed else word() for w in base]
    rows += [rows[0]] * 5 + [rows[1].upper()]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_awkward_and_corpus(awkward, corpus, none_at_all):
    for docs in (awkward, corpus):
        assert got(docs, words=3, percent=85) == plain(docs)
    assert minhash.link(none_at_all).count() == 0


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 85), (2, 5, 80), (3, 3, 50)])
def test_chains_of_near_copies(spark, seed, words, percent):
    docs = spark.createDataFrame(near_copies(seed), "doc_id long, text string").repartition(4)
    want = plain(docs, words, percent)
    assert len({c for _, _, c, _ in want}) < len(want)
    assert got(docs, words=words, percent=percent) == want


def test_one_template_many_texts(spark):
    """A bucket full of texts of one template: linked by chance only, compared in blocks."""
    r = random.Random(5)
    template = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(150):
        text = list(template)
        for _ in range(r.randint(0, 2)):
            text[r.randrange(24)] = f"x{r.randrange(40)}"
        rows.append((1000 - i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(docs, words=3, percent=85, block_rows=16) == plain(docs)
    assert got(docs, words=3, percent=95, block_rows=1000) == plain(docs, percent=95)


def test_null_and_repeated_ids(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(30))
    rows = [
        (None, text("a"), 1), (None, text("b"), 1), (None, text("c"), 1), (None, text("c").upper(), 1),
        (7, text("d"), 1), (7, text("e"), 1), (8, text("b") + " more", 1), (9, text("e") + " more", 1),
        (9, text("f"), 1), (None, "", 1), (None, None, 1), (7, "", 1), (3, "two words", 1), (2, "TWO  words", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(4)
    want = Counter((d, n, c, d == c) for (d, n, c, _), k in plain(docs).items() for _ in range(k))
    assert got(docs, words=3, percent=85) == want


def test_minima_are_minima():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 0, 5, 20_000, 300, 9000)]
    found = minhash.minima(sets, 64, seed=3)
    rng = np.random.default_rng(3)
    odd = rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, 64, dtype=np.uint64)
    for j, s in enumerate(sets):
        for i in range(64):
            want = int(((s * odd[i] + plus[i]) >> np.uint64(32)).min()) if len(s) else 0xFFFFFFFF
            assert int(found[i, j]) == want


def test_bit_counts_and_estimate(spark):
    r = np.random.default_rng(2)
    for similarity in (0.3, 0.6, 0.85, 1.0):
        both = int(2000 * similarity / (1 + similarity) * 2 / 2)
        pool = np.unique(r.integers(0, 1 << 63, 6000, dtype=np.uint64))
        rest = (2000 - both) if similarity < 1 else 0
        x = np.sort(np.concatenate([pool[:both], pool[both : both + rest]]))
        y = np.sort(np.concatenate([pool[:both], pool[both + rest : both + 2 * rest]]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        for bits in (1, 2, 4):
            least = minhash.minima([x, y], 1024, seed=9)
            kept = least & np.uint32((1 << bits) - 1)
            want = int((kept[:, 0] == kept[:, 1]).sum())
            packed = minhash.planes(least, bits).tolist()
            row = spark.createDataFrame([packed], "x array<long>, y array<long>")
            assert row.select(minhash.matches(row.x, row.y, 1024, bits)).first()[0] == want
            assert abs(minhash.estimate(want, 1024, bits) - true) < 0.12


def test_layout_and_bound_leave_no_link_out():
    for percent in (50, 80, 85, 95):
        shape = minhash.layout(percent, 128)
        assert shape.bands * shape.rows == 128
        assert (1 - (percent / 100) ** shape.rows) ** shape.bands <= minhash.MISS
        least = minhash.least_matches(percent, 128, 4)
        assert 0 < least < 128 * percent / 100
    assert minhash.layout(85, 128) == (32, 4)


def test_a_family_writes_few_candidate_pairs(spark, monkeypatch):
    """Most similar pairs first: their links leave few pairs of components to the lower rungs."""
    r = random.Random(7)
    template = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        text = list(template)
        for _ in range(r.randint(0, 3)):
            text[r.randrange(60)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written, across = [], minhash.across

    def counted(*args):
        pairs = minhash.materialize(across(*args), "pairs")
        written.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "across", counted)
    assert got(docs, words=3, percent=85) == plain(docs)
    assert len(written) == len(minhash.rungs(85, 128, 4)) == 5 and sum(written) < 4 * len(rows)


def test_rungs_fall_to_the_least_matches():
    for percent in (50, 80, 85, 95):
        found = minhash.rungs(percent, 128, 4)
        assert found == sorted(set(found), reverse=True) and found[-1] == minhash.least_matches(percent, 128, 4)
        assert found[0] <= 128


def test_candidates_of_a_rung_are_stored_once(spark, monkeypatch):
    stored = []
    write = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: (stored.append(name), write(df, name))[1])
    docs = spark.createDataFrame(near_copies(3), "doc_id long, text string")
    assert got(docs, words=3, percent=85) == plain(docs)
    assert stored.count("pairs") == 1 + len(minhash.rungs(85, 128, 4))
