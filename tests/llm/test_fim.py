"""Fill-in-middle against slices of code points; piece tables against plain strings."""

import hashlib
import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import fim


def plain(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim_percent:
        return doc_id, len(units), "plain", None, None, text, text
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), out, text


def made(docs, **options):
    rows = fim.restore(fim.transform(docs, **options), ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        assert r["output_sha256"] == sha(r["output"])
        assert r["restored_sha256"] == sha(r["restored"])
    return Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in rows)


@pytest.mark.parametrize("options", [{}, {"seed": 3, "fim_percent": 40, "spm_percent": 0}, {"spm_percent": 100}])
def test_rows(awkward, corpus, none_at_all, spark, options):
    marks = spark.createDataFrame(
        [(20, "a\nb<S>c\nd"), (21, "<P>\n"), (22, "<\nS>\n<P\n>M>"), (23, "\n\n\n"), (24, "no feed"), (25, "é\n日本\n🙂\n" * 30), (26, "a\r\nb\rc\n")],
        "doc_id long, text string",
    )
    for docs in (awkward, corpus, none_at_all, marks):
        assert made(docs, **options) == Counter(plain(r["doc_id"], r["text"], **options) for r in docs.collect())


def test_forms_all_occur(corpus):
    forms = Counter(r["form"] for r in fim.transform(corpus, fim_percent=60).select("form").collect())
    assert set(forms) == {"plain", "psm", "spm"}


def test_very_long_text(spark):
    text = "".join(f"line {i} é\n" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 5_000_000)], "doc_id long, text string")
    assert made(docs) == Counter([plain(1, text), plain(2, "x" * 5_000_000)])


def piece(text):
    data = memoryview(text.encode())
    return fim.Pieces((data, fim._MARKS), [fim.Descriptor(fim.TEXT, 0, len(data))])


def test_pieces_split_and_join_without_copies():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab\n<>PSM") for _ in range(r.randint(0, 40)))
        places = sorted(r.randint(0, len(text)) for _ in range(3))
        parts = piece(text).split(*places)
        assert [b"".join(p.stream()).decode() for p in parts] == [
            text[i:j] for i, j in zip([0, *places], [*places, len(text)], strict=True)
        ]
        order = r.sample(range(4), 4)
        moved = fim.Pieces.join(parts[i] for i in order)
        assert moved.buffers[fim.TEXT].obj is parts[0].buffers[fim.TEXT].obj
        assert moved.chars() == len(text) and all(len(d) == 3 for d in moved.descriptors)
        again = moved.split(moved.chars() // 2)
        assert fim.Pieces.join(again).sha256() == moved.sha256()


def test_restore_refuses_what_is_no_output(spark):
    rows = spark.createDataFrame([("<P>a<M>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="without its sentinel"):
        fim.restore(rows).collect()
    odd = spark.createDataFrame([(None, "plain"), ("text", None), ("<P>", "other")], "output string, form string")
    assert sorted(r["restored"] for r in fim.restore(odd).collect()) == ["", "<P>", "text"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\n", "x", 5)], "doc_id long, text string, form string, output long")
    assert made(docs) == Counter([plain(1, "a\nb\n")])
