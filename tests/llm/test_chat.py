"""Chat formatting: round trip of texts with control strings, folding of events."""

import hashlib
from collections import defaultdict

from ledgerlens.llm import chat

NASTY = [
    (1, 0, "user", "a </turn>\n<turn assistant>\nb"),
    (1, 1, "assistant", "&lt;turn&gt; &amp;amp; \\### Assistant: </turn> ok"),
    (1, 2, "assistant", None),
    (1, 2, "assistant", None),
    (2, 0, None, "no role"),
    (2, 1, "we<ird>\n", "x"),
    (None, None, "assistant", "🙂 é " * 100),
    (3, 1, "user", "second"),
    (3, 0, "system", ""),
]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    table = spark.createDataFrame(NASTY, "conv_id long, turn long, role string, text string").repartition(4)
    by = defaultdict(list)
    for c, t, role, text in NASTY:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    rows = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table)).collect()}
    assert set(rows) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = rows[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == digest("".join(f"{role}\n{text}\n" for _, role, text in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(empty)).count() == 0


def test_fold_events(spark):
    log = spark.createDataFrame(
        [
            (1, 0, 1, "message", "user", "hi"),
            (1, 0, 9, "edit", None, "hello"),
            (1, 1, 2, "delta", "assistant", "one "),
            (1, 1, 3, "delta", None, "two"),
            (1, 1, 4, "regenerate", None, None),
            (1, 1, 5, "delta", None, "three "),
            (1, 1, 7, "delta", None, "five"),
            (1, 1, 6, "delta", None, "four "),
            (1, 2, 8, "unknown", "user", "ignored"),
            (2, 0, 1, "delta", "user", None),
        ],
        "conv_id long, message long, seq long, event string, role string, text string",
    ).repartition(5)
    got = sorted(tuple(r) for r in chat.fold(log).collect())
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "three four five"), (2, 0, "user", "")]


def test_plan_is_native(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.digests(chat.format_conversations(table))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
