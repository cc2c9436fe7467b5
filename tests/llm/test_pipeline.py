"""Each stage of the pipeline against a plain pass over its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import jaccard, mixing
from ledgerlens.session import materialize
from test_jaccard import plain as plain_components
from test_mixing import words
from test_passages import plain as plain_spans
from test_tokens import check_packed


def keyed(df):
    return Counter(tuple(sorted(r.asDict().items(), key=str)) for r in df.collect())


@pytest.mark.parametrize("table", ["awkward", "corpus"])
def test_stages(spark, request, table):
    docs = request.getfixturevalue(table)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, "unused"), "stage")
        if name != "packing":
            assert out.dtypes == docs.dtypes
        seen[name] = (docs, out)
        docs = out
    before, after = seen["language_id"]
    assert not keyed(after) - keyed(before)
    assert after.count() >= 0.95 * before.where(F.col("text").rlike("[a-z]{2}")).count()

    before, after = seen["ngram_jaccard"]
    assert not keyed(after) - keyed(before)
    heads = {(c if c is not None else None) for _, _, c in plain_components(before)}
    assert sorted(map(str, (r["doc_id"] for r in after.collect()))) == sorted(map(str, heads))

    before, after = seen["substring_dedup"]
    spans = plain_spans([(r["doc_id"], r["text"]) for r in before.collect()])
    want = Counter()
    for r in before.collect():
        text = r["text"]
        for a, b in reversed(spans.get((r["doc_id"], text), [])):
            text = text[:a] + text[b:]
        want[(r["doc_id"], text, r["source"], len(text))] += 1
    assert want == Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in after.collect())

    before, after = seen["mixing"]
    sizes, largest, got = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    times = keyed(after)
    assert all(n <= 2 for n in times.values()) and set(times) <= set(keyed(before))
    for r in after.collect():
        got[r["source"]] += words(r["text"])
    for s, target in mixing.share_targets(sizes, (3, 1, 2), 1.5, 2).items():
        assert abs(got[s] - target) <= largest[s] / 2 + 1

    before, after = seen["packing"]
    check_packed(after.collect(), before, 2048, 1)


def test_empty_table(spark, none_at_all):
    docs = none_at_all
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "unused"), "stage")
    assert docs.count() == 0


def test_keep_first_and_repeats_of_awkward_rows(awkward):
    kept = jaccard.keep_first(awkward.unionAll(awkward)).collect()
    ids = Counter((r["doc_id"], r["text"]) for r in kept)
    assert max(ids.values()) == 1
    assert {d for d, _ in ids} >= {1, 2, 3, None, 7, 8, 9, 10, 11, 12, 13, 0}
    assert (5, None) not in ids and not any(d == 5 for d, _ in ids)  # a copy of 4 but for case
    twice = awkward.unionAll(awkward)
    taken = Counter((r["doc_id"], r["text"]) for r in mixing.repeat_documents(twice, F.array("source"), (3, 1, 2)).collect())
    have = Counter((r["doc_id"], r["text"]) for r in twice.collect())
    assert all(n <= 2 * have[k] for k, n in taken.items())


def test_sequences_hold_the_ids_of_every_copy(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, long), (1, long), (1, long + " other"), (None, "short"), (None, "short"), (2, "")], "doc_id long, text string")
    rows = corpus_pipeline.sequences(spark, docs.repartition(3), "unused").collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"], r["text_hash"], r["copy"]].append((r["start"], r["ids"], r["doc_tokens"]))
    assert len(whole) == docs.count() and Counter((d, c) for d, _, c in whole)[1, 1] == 1
    for parts in whole.values():
        ids = []
        for start, piece, _ in sorted(parts):
            assert start == len(ids)
            ids += piece
        assert len(ids) == parts[0][2] and ids[-1] == 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
