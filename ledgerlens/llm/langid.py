"""Language identification by words first, then shorter and shorter n-grams.

Training counts words and padded character n-grams of a bounded sample of
labelled texts as Spark aggregates; every label is learned, and every word and
n-gram of the sample, those seen once included.  A known word adds its log
frequency in each language; an unseen word adds the mean log frequency of its
longest n-grams that are known to any language.  Texts are scored whole, in
Arrow batches, where they lie: no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import by_bytes
from ledgerlens.llm.tokens import text_of

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
UNDECIDED = "und"
CACHED_BYTES = 32 << 20
#: What a remembered word takes beside its vector: the text, its number and the places in two tables.
WORD_BYTES = 200
LEAST_DOCS = 64
SMOOTHING = 0.5
COUNTED_BYTES = 8 << 20


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, kind, token, n): kind 0 words, else n-gram length."""
    for batch in by_bytes(batches, 1, COUNTED_BYTES):
        words: dict[str, Counter] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text_of(raw).lower()))
        for lang, counts in words.items():
            kinds: list[Counter] = [counts, *(Counter() for _ in range(LONGEST))]
            for word, n in counts.items():
                for k in range(1, LONGEST + 1):
                    for g in grams(word, k):
                        kinds[k][g] += n
            for kind, found in enumerate(kinds):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([kind] * len(found), pa.int32()),
                        pa.array(list(found), pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["lang", "kind", "token", "n"],
                )


class Tokens:
    """Distinct tokens, numbered in the order of their hashes.

    They lie in two arrays and one run of UTF-8 bytes: every worker of an executor
    holds a model of its own, and objects would take ten times as much.
    """

    def __init__(self, tokens: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.text = b"".join([raw[i] for i in order])
        self.starts = np.cumsum([0, *(len(raw[i]) for i in order)])
        self.place = np.empty(len(raw), np.int64)
        self.place[order] = np.arange(len(raw))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "place"}  # the caller's order, not needed any more

    def __len__(self) -> int:
        return len(self.hashes)

    def __iter__(self) -> Iterator[str]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield self.text[a:b].decode("utf-8", "surrogatepass")

    def find(self, tokens: list[str]) -> np.ndarray:
        """The number of each token, -1 where it is not among them."""
        out = np.full(len(tokens), -1)
        if not len(self) or not tokens:
            return out
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        at = np.searchsorted(self.hashes, h)
        while True:  # once more for each token whose hash an earlier one shares
            left = np.flatnonzero((out < 0) & (self.hashes[np.minimum(at, len(self) - 1)] == h) & (at < len(self)))
            if not len(left):
                return out
            first, end = self.starts[at[left]].tolist(), self.starts[at[left] + 1].tolist()
            same = [self.text[a:b] == raw[i] for i, a, b in zip(left.tolist(), first, end, strict=True)]
            out[left[same]] = at[left[same]]
            at[left] += 1


class Model(NamedTuple):
    """Log frequencies by kind (0 words, else n-gram length), sparse in the languages.

    index[kind]: the tokens, each of them an entry; entry e has languages at[kind][starts[kind][e] :
    starts[kind][e + 1]] and there adds as much of more[kind] to base[kind].
    """

    langs: list[str]
    index: list[Tokens]
    starts: list[np.ndarray]
    at: list[np.ndarray]
    more: list[np.ndarray]
    base: np.ndarray  # [kinds, languages]

    def add(self, rows: np.ndarray, kind: int, entries: np.ndarray, owners: np.ndarray, weights: np.ndarray) -> None:
        """Adds to row ``owners[i]`` the part of entry ``entries[i]`` above the base, times its weight."""
        first = self.starts[kind][entries]
        counts = self.starts[kind][entries + 1] - first
        flat = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        np.add.at(rows, (np.repeat(owners, counts), self.at[kind][flat]), self.more[kind][flat] * np.repeat(weights, counts))


def model_of(langs: list[str], counts: pa.Table) -> Model:
    """A model from rows (lang, kind, token, n), each (lang, kind, token) once.

    A token's frequency in a language is ``(n + 0.5) / (total + 0.5 * tokens)``
    over the kind's tokens, all languages together.
    """
    place = {lang: i for i, lang in enumerate(langs)}
    index: list[Tokens] = []
    starts, ats, mores = [], [], []
    base = np.zeros((LONGEST + 1, len(langs)))
    for kind in range(LONGEST + 1):
        rows = counts.filter(pc.equal(counts["kind"], kind))
        tokens = rows["token"].combine_chunks().dictionary_encode()
        known = Tokens(tokens.dictionary.to_pylist())
        entry = known.place[tokens.indices.to_numpy()]
        named = rows["lang"].combine_chunks().dictionary_encode()
        at = np.array([place[x] for x in named.dictionary.to_pylist()], np.int32)[named.indices.to_numpy()]
        n = rows["n"].to_numpy().astype(float)
        order = np.lexsort((at, entry))
        index.append(known)
        starts.append(np.searchsorted(entry[order], np.arange(len(known) + 1)))
        ats.append(at[order])
        mores.append(np.log((n[order] + SMOOTHING) / SMOOTHING))
        total = np.bincount(at, weights=n, minlength=len(langs))
        base[kind] = np.log(SMOOTHING / (total + SMOOTHING * max(1, len(known))))
    return Model(langs, index, starts, ats, mores, base)


COUNTS = pa.schema({"lang": pa.string(), "kind": pa.int32(), "token": pa.string(), "n": pa.int64()})


def train(documents: DataFrame, sample_docs: int = 20_000) -> Model:
    """Fit on a sample of about ``sample_docs`` labelled texts outside the held-out part.

    Every language gets the same share of the sample, at least 64 texts (all, if
    it has fewer), chosen by a hash of id and text; the driver gets one row a
    label and the words and n-grams of the sample.  No labelled text gives an
    empty model.
    """
    spark = documents.sparkSession
    labelled = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    rows = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not rows:
        return model_of([], COUNTS.empty_table())
    scale = 1 << 30
    share = max(sample_docs / len(rows), LEAST_DOCS)
    cutoffs = spark.createDataFrame(
        [(r["lang"], int(scale * min(1.0, share / r["n"]))) for r in rows], "lang string, cutoff long"
    )
    chosen = labelled.join(F.broadcast(cutoffs), "lang").where(  # one row a label
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < F.col("cutoff")
    )
    counts = (
        chosen.select("lang", "text")
        .mapInArrow(_count, "lang string, kind int, token string, n long")
        .groupBy("lang", "kind", "token")
        .agg(F.sum("n").alias("n"))
    )
    return model_of(sorted(r["lang"] for r in rows), counts.toArrow().cast(COUNTS))


class Scorer:
    """Scores texts; remembers the vectors of words it has met (boundedly)."""

    def __init__(self, model: Model):
        self.model = model
        self.most = CACHED_BYTES // (WORD_BYTES + 8 * len(model.langs))
        self.reset()

    def reset(self) -> None:
        self.unknown: set[int] = set()
        self.ids: dict[str, int] = {}
        self.vectors = np.zeros((0, len(self.model.langs)))
        self.used = 0

    def learn(self, words: list[str]) -> None:
        """Give every new word its own vector or that of its longest known n-grams."""
        model, rows = self.model, np.zeros((len(words), len(self.model.langs)))
        left = np.arange(len(words))
        for kind in (0, *range(LONGEST, 0, -1)):
            found = [grams(words[i], kind) if kind else [words[i]] for i in left.tolist()]
            own = np.repeat(left, [len(f) for f in found])
            entries = model.index[kind].find([g for f in found for g in f])
            own, entries = own[entries >= 0], entries[entries >= 0]
            if len(own):
                times = np.bincount(own, minlength=len(words))
                rows[times > 0] += model.base[kind]
                model.add(rows, kind, entries, own, 1 / times[own])
                left = left[times[left] == 0]
            if not len(left):
                break
        self.unknown.update((self.used + left).tolist())
        if self.used + len(words) > len(self.vectors):
            grown = np.zeros((2 * (self.used + len(words)), rows.shape[1]))
            grown[: self.used] = self.vectors[: self.used]
            self.vectors = grown
        self.vectors[self.used : self.used + len(words)] = rows
        for i, word in enumerate(words):
            self.ids[word] = self.used + i
        self.used += len(words)

    def score(self, text: str) -> tuple[str, float]:
        return self._score(text, LETTERS.findall(text.lower()))

    def _score(self, text: str, words: list[str]) -> tuple[str, float]:
        if not self.model.langs or not (any(map(str.isalpha, words)) or any(map(str.isalpha, text))):
            return UNDECIDED, 0.0
        if self.used > self.most:
            self.reset()
        unseen = [w for w in dict.fromkeys(words) if w not in self.ids]
        if unseen:
            self.learn(unseen)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        mean = self.vectors[ids].mean(axis=0) if len(ids) else np.zeros(len(self.model.langs))
        odds = np.exp(mean - mean.max())
        best = int(odds.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


    def decides(self, text: str) -> bool:
        """Whether the text has letters and a word or n-gram that the model knows."""
        words = LETTERS.findall(text.lower())
        if self._score(text, words)[0] == UNDECIDED:
            return False
        return any(self.ids[w] not in self.unknown for w in words)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    ``und`` with score 0 for a null text, a text without letters, or an empty
    model.  The score is the share of the best language when each has the mean
    log frequency of the text's words; ties go to the smaller name.  Repeated
    rows are scored each; columns other than doc_id and text are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in by_bytes(batches, 2):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = [(UNDECIDED, 0.0) if t is None else scorer.score(text_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return rows.mapInArrow(score_batches, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, **bounds: int) -> DataFrame:
    """``predict`` with a model learned from the same table's labelled part."""
    return predict(documents, train(documents, **bounds))


def keep_identified(documents: DataFrame, **bounds: int) -> DataFrame:
    """The documents that have letters and something the model knows, all columns.

    The score is no reason to go: its share falls with the number of labels, and
    several labels of one language split it.  A table without labels says nothing
    about any document, so all of them stay.
    """
    model = train(documents, **bounds)
    if not model.langs:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.schema
    at = schema.names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in by_bytes(batches, at):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([t is not None and scorer.decides(text_of(t)) for t in texts], pa.bool_()))

    return documents.mapInArrow(keep, schema)
