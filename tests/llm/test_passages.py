"""Substring dedup against a sequential pass over ranked documents."""

import random

import pytest

from ledgerlens.llm import passages


def plain(rows, min_words=passages.MIN_WORDS, unit_words=passages.UNIT_WORDS):
    """{(doc_id, text): removed spans}, one document after another by rank."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        marks = set()
        for i, u in enumerate(passages.units(text)):
            if u.words >= unit_words:
                if u.normal in seen:
                    marks.add(i)
                seen.add(u.normal)
        out[doc, text] = passages.removed_spans(text, marks, min_words)
    return out


def check(docs):
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    rows = passages.dedup(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        originals = [t for d, t in before if d == r["doc_id"]]
        assert len(originals) == 1, "the fixture has one text for each id"
        text = originals[0]
        if text is None:
            assert r["text"] is None
            continue
        spans = [(s["start"], s["end"]) for s in r["__removed"]]
        assert spans == want[r["doc_id"], text]
        assert r["text"] == "".join(text[s["start"] : s["end"]] for s in r["__kept"])
        assert sorted([(s["start"], s["end"]) for s in r["__kept"]] + spans) == sorted(
            [(s["start"], s["end"]) for s in r["__kept"]] + spans
        )
        covered = sorted([(s["start"], s["end"]) for s in r["__kept"]] + spans)
        assert [a for a, _ in covered] + [len(text)] == [0, *(b for _, b in covered)] or not text
    return want


def test_awkward_and_corpus(awkward, corpus, none_at_all):
    check(awkward)
    want = check(corpus)
    assert any(want.values())
    assert passages.dedup(none_at_all).count() == 0
    kept = passages.clean(awkward)
    assert kept.schema.names == awkward.schema.names and kept.dtypes == awkward.dtypes


def prose(r, sentences):
    return " ".join(
        " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(r.randint(2, 12))).capitalize() + "."
        for _ in range(sentences)
    )


def test_planted_passages_go_and_clean_text_stays(spark):
    r = random.Random(1)
    passage = prose(r, 12)
    rows = []
    for i in range(60):
        a, b = prose(r, 8), prose(r, 8)
        rows.append((i, f"{a} {passage} {b}" if i % 3 == 0 else f"{a}\n{passage.upper()}\n{b}" if i % 3 == 1 else f"{a}\n{b}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(docs)
    got = {x["doc_id"]: x["text"] for x in passages.dedup(docs).collect()}
    for i, text in rows:
        if i % 3 == 2 or i == 0:
            assert got[i] == text
        else:
            assert len(text) - len(got[i]) >= 0.9 * len(passage)
            assert passage.lower() not in got[i].lower()


@pytest.mark.parametrize("text", ["", "\n", "a. b! c?\n\n d", "no end", ".\n.", " lead. Tail. "])
def test_units_cover_the_text(text):
    found = list(passages.units(text))
    assert "".join(text[u.start : u.end] for u in found) == text
    assert all(a.end == b.start for a, b in zip(found, found[1:], strict=False))


def test_short_copies_lists_and_scripts_without_blanks_go(spark):
    listed = [f"item {i}" for i in range(40)]
    rows = [
        (0, "Nine words that make up one whole short line.\nfirst of all the others here"),
        (1, "another text of its own\nnine words that make up one whole short line.\nand its end, not the same"),
        (2, "Nine words that make up one whole short line."),  # a whole document
        (3, "\n".join(listed)),
        (4, "odd line\n" + "\n".join(listed) + "\nlast"),
        (5, "これは長い文章の最初の文です。そして次の文もここにあります。"),
        (6, "別の書き出しです。これは長い文章の最初の文です。そして次の文もここにあります。終わり"),
        (7, "ไม่มีช่องว่างระหว่างคำในบรรทัดนี้\nx"),
        (8, "y\nไม่มีช่องว่างระหว่างคำในบรรทัดนี้"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(docs)
    got = {r["doc_id"]: r["text"] for r in passages.dedup(docs).collect()}
    assert [got[i] for i in (0, 3, 5, 7)] == [rows[i][1] for i in (0, 3, 5, 7)]
    assert got[1] == "another text of its own\nand its end, not the same" and got[2] == ""
    assert "odd line" in got[4] and len(got[4].split("\n")) <= 20
    assert got[6] == "別の書き出しです。終わり"
    assert got[8] == "y\n"
