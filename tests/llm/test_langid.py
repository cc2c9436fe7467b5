"""Language identification: held-out accuracy and awkward texts."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.95 * len(tested)


def test_awkward_rows(awkward, none_at_all, spark):
    rows = langid.identify(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    for doc in (1, 2, 3, 12):
        assert (by[doc]["lang_pred"], by[doc]["score"]) == ("und", 0.0)
    assert by[4]["lang_pred"] in {"en", "de", "fr", "es"} and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(none_at_all).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(unlabelled).collect()] == ["und"]


def test_prediction_reads_only_the_text(awkward):
    model = langid.train(awkward)
    moved = awkward.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'yy' as source")
    a = sorted((r["lang_pred"], r["score"]) for r in langid.predict(awkward, model).collect())
    assert a == sorted((r["lang_pred"], r["score"]) for r in langid.predict(moved, model).collect())


def test_unseen_words_back_off():
    import pyarrow as pa

    rows = [
        (kind, token, lang, n)
        for kind, token, *by in ((0, "known", 90, 10), (1, "z", 5, 5), (2, "q$", 2, 8), (3, "abc", 90, 10), (4, "^abc", 10, 90))
        for lang, n in zip("ab", by, strict=True)
    ]
    counts = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("kind", "token", "lang", "n"))})
    # every kind holds one token, so each language needs others to be uncertain
    other = pa.table({"kind": list(range(5)) * 2, "token": ["\0"] * 10, "lang": ["a"] * 5 + ["b"] * 5, "n": [100] * 10})
    scorer = langid.Scorer(langid.model_of(["a", "b"], pa.concat_tables([counts, other])))
    assert scorer.score("known")[0] == "a"
    assert scorer.score("abcd")[0] == "b"  # longest n-gram first
    assert scorer.score("xabc")[0] == "a"
    assert scorer.score("qq")[0] == "b"
    assert scorer.score("qqq zzz known known")[0] == "a"


def plain(rows, languages):
    """lang_pred and score of each (doc_id, text, lang), counted and scored by the letter."""
    letters = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    cut = lambda w, n: [("^" * (n > 1) + w + "$" * (n > 1))[i : i + n] for i in range(len(w) + 2 * (n > 1) - n + 1)]
    counts = [{lang: Counter() for lang in languages} for _ in range(5)]
    for doc, text, lang in rows:
        if lang is not None and text is not None and (doc is None or zlib.crc32(str(doc).encode()) % 4 != 2):
            for w in letters(text):
                counts[0][lang][w] += 1
                for n in range(1, 5):
                    counts[n][lang].update(cut(w, n))
    tokens = [set().union(*by.values()) for by in counts]

    def log_frequency(kind, token, lang):
        return math.log((counts[kind][lang][token] + 0.5) / (sum(counts[kind][lang].values()) + 0.5 * max(1, len(tokens[kind]))))

    def of_word(w, lang):
        if w in tokens[0]:
            return log_frequency(0, w, lang)
        for n in range(4, 0, -1):
            known = [g for g in cut(w, n) if g in tokens[n]]
            if known:
                return sum(log_frequency(n, g, lang) for g in known) / len(known)
        return 0.0

    for doc, text, _ in rows:
        words = letters(text or "")
        if not any(map(str.isalpha, words)) and not any(map(str.isalpha, text or "")):
            yield doc, "und", 0.0
            continue
        mean = [sum(of_word(w, lang) for w in words) / max(1, len(words)) for lang in languages]
        odds = [math.exp(m - max(mean)) for m in mean]
        yield doc, languages[odds.index(max(odds))], max(odds) / sum(odds)


def test_equals_a_plain_pass(spark):
    r = random.Random(4)
    stems = {"en": "the house of water", "de": "das haus über wasser", "fr": "été maison rouge eau", "Ελ": "το σπίτι νερό"}
    rows = [
        (i, " ".join(r.choice(stems[lang].split()) + r.choice(["", "s", "er", "q9", "-x"]) for _ in range(r.randrange(1, 30))), lang)
        for i in range(60)
        for lang in [r.choice(list(stems))]
    ]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 _ 3", None), (103, "жщю ҂", None), (None, "eau du puits", "fr"), (104, "once only", "rare")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table).collect()}
    languages = sorted({*stems, "rare"})
    for doc, lang, score in plain(rows, languages):
        assert got[doc] == (lang, pytest.approx(score)), doc


def test_every_label_and_every_word_is_learned(spark):
    rows = [(4 * i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} only", f"l{i:03}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert model.langs == sorted(r[2] for r in learned)
    assert set(model.index[0]) == {"only"} | {r[1].split()[0] for r in learned}


def test_keep_identified_returns_whole_rows(awkward):
    kept = langid.keep_identified(awkward)
    assert kept.schema == awkward.schema
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, None, 7, 8, 9, 10, 11, 13, 0}


def test_keep_identified_does_not_depend_on_the_number_of_labels(spark):
    rows = [(i, "the words of the text and the lines", lang) for i, lang in enumerate(["en", "EN", "en-GB", "en-US"] * 5)]
    docs = spark.createDataFrame([*rows, (100, "ξψχ жщю", "en"), (101, "12 34", "en")], "doc_id long, text string, lang string")
    learned = langid.train(docs.where("doc_id < 100"))
    assert len(learned.langs) == 4
    scorer = langid.Scorer(learned)
    assert scorer.score(rows[0][1])[1] < 0.3 and scorer.decides(rows[0][1])
    assert not scorer.decides("ξψχ жщю") and not scorer.decides("12 34")
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} >= set(range(20))
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert langid.keep_identified(unlabelled).count() == 22


def test_tokens_are_told_apart_where_hashes_agree(monkeypatch):
    tokens = ["été", "", "water", "wat", "er", "日本"]
    for same in (False, True):
        if same:
            monkeypatch.setattr(langid.xxhash, "xxh3_64_intdigest", lambda raw: len(raw) % 2)
        found = langid.Tokens(tokens)
        assert sorted(found) == sorted(tokens) and len(found) == len(tokens)
        named = list(found)
        assert [named[i] for i in found.find(tokens)] == tokens
        assert found.find(["none", "no", "ete"]).tolist() == [-1, -1, -1]
    assert langid.Tokens([]).find(["a"]).tolist() == [-1] and langid.Tokens(["a"]).find([]).tolist() == []


def test_a_worker_holds_little_for_a_model_and_its_words():
    import pickle
    import tracemalloc

    import pyarrow as pa

    n = 50_000
    counts = pa.table({"lang": ["a"] * n, "kind": [0] * n, "token": [f"known{i}" for i in range(n)], "n": [1] * n})
    packed = pickle.dumps(langid.model_of(["a"], counts))
    tracemalloc.start()
    scorer = langid.Scorer(pickle.loads(packed))
    assert tracemalloc.get_traced_memory()[0] < 80 * n
    for i in range(300):
        scorer.score(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(1000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < langid.CACHED_BYTES + 80 * n
