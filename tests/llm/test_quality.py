"""Quality measures against a plain Python count."""

import re
from collections import Counter

from ledgerlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_measures(awkward, corpus, none_at_all):
    for docs in (awkward, corpus, none_at_all):
        rows = quality.judge(docs).collect()
        got = Counter(
            (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            for r in rows
        )
        assert got == Counter((r["doc_id"], *plain(r["text"])) for r in docs.collect())
        assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_rules_drop_junk_and_keep_prose(spark):
    prose = "The end of the road was in sight and they had to walk for a day to reach it."
    junk = " ".join(f"{w}$$$" for w in prose.split())
    docs = spark.createDataFrame([(1, prose), (2, junk), (3, "x" * 30 + " y" * 3), (4, f"{prose}\n{prose}\n{prose}")], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_plan_is_one_projection(corpus):
    plan = quality.judge(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
