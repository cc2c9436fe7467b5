"""Substring dedup: hashing of lines, cut at sentence ends.

A unit is a sentence inside a line; sentences and lines under ``UNIT_WORDS`` words
that follow each other are units together.  Units are normalised (lower case,
single blanks) and hashed to 128 bits; digests are grouped over all documents with
the earliest ranked occurrence of each, and every later occurrence is a copy and
goes.  The rest of the text and the original offsets of what stays and goes are
kept.  A unit that stays under ``unit_words`` words says nothing alone: it goes
only inside a run of copies.  In scripts without blanks two characters are a word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import by_bytes
from ledgerlens.llm.tokens import text_of

BREAK = re.compile(r"\n\s*|(?<=[.!?])[^\S\n]+")
#: Letters of scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNSPACED_BREAK = re.compile(BREAK.pattern + "|(?<=[。！？｡])[^\\S\\n]*")
UNIT_WORDS, MOST_SHORT_WORDS = 4, 16
#: Every copy of a hashed unit goes; a higher bound keeps shorter runs.
MIN_WORDS = UNIT_WORDS
SPANS = "array<struct<start:long,end:long>>"


class Unit(NamedTuple):
    start: int
    end: int  # with the blanks that follow
    words: int
    normal: str


def sentences(text: str) -> Iterator[Unit]:
    """Sentences of lines with their offsets (code points); they cover the text."""
    unspaced = not text.isascii() and UNSPACED.search(text) is not None
    at = 0

    def unit(end: int, after: int) -> Unit:
        words = text[at:end].lower().split()
        normal = " ".join(words)
        return Unit(at, after, len(words) + (len(UNSPACED.findall(normal)) // 2 if unspaced else 0), normal)

    for m in (UNSPACED_BREAK if unspaced else BREAK).finditer(text):
        if m.end() > at:
            yield unit(m.start(), m.end())
            at = m.end()
    if at < len(text):
        yield unit(len(text), len(text))


def units(text: str) -> Iterator[Unit]:
    """``sentences``, short ones that follow each other put together.

    Such a unit ends where the hash of its last sentence is even, so that two
    copies of a list that begin after different short lines soon agree.
    """
    start, words, normals = 0, 0, []
    for unit in sentences(text):
        if unit.words >= UNIT_WORDS:
            if normals:
                yield Unit(start, unit.start, words, " ".join(filter(None, normals)))
                words, normals = 0, []
            yield unit
            continue
        if not normals:
            start = unit.start
        words += unit.words
        normals.append(unit.normal)
        if words >= UNIT_WORDS and (words >= MOST_SHORT_WORDS or zlib.crc32(unit.normal.encode("utf-8", "surrogatepass")) % 2 == 0):
            yield Unit(start, unit.end, words, " ".join(filter(None, normals)))
            words, normals = 0, []
    if normals:
        yield Unit(start, len(text), words, " ".join(filter(None, normals)))


def _digests(unit_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            docs, keys, at, high, low = [], [], [], [], []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, key, raw in zip(ids, hashes, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for i, unit in enumerate(units(text_of(raw))):
                    if unit.words >= unit_words:
                        digest = xxhash.xxh3_128_intdigest(unit.normal.encode("utf-8", "surrogatepass"))
                        docs.append(doc)
                        keys.append(key)
                        at.append(i)
                        high.append((digest >> 64) - (1 << 63))
                        low.append((digest & ((1 << 64) - 1)) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in ((high, pa.int64()), (low, pa.int64()), (docs, pa.int64()), (keys, pa.int64()), (at, pa.int32()))],
                names=["high", "low", "rank", "key", "unit"],
            )

    return rows


def removed_spans(text: str, copies: set[int], min_words: int) -> list[tuple[int, int]]:
    """Spans of runs of copies with at least ``min_words`` words.

    A run begins and ends with a copy; units too short to be hashed may lie
    inside it.
    """
    found: list[tuple[int, int]] = []
    start = end = None
    words = pending = 0

    def close() -> None:
        if start is not None and words >= min_words:
            found.append((start, end))

    for i, unit in enumerate(units(text)):
        if i in copies:
            if start is None:
                start, words, pending = unit.start, 0, 0
            words += pending + unit.words
            end, pending = unit.end, 0
        elif start is not None and unit.words < UNIT_WORDS:
            pending += unit.words
        else:
            close()
            start = None
    close()
    return found


def _cut(min_words: int, text_at: int, copies_at: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in by_bytes(batches, text_at):
            texts, removed, kept = [], [], []
            copies = batch.column(copies_at).to_pylist()
            for raw, marks in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), copies, strict=True):
                text = text_of(raw)
                gone = removed_spans(text, set(marks), min_words) if marks else []
                stays, at = [], 0
                for start, end in [*gone, (len(text), len(text))]:
                    if start > at:
                        stays.append((at, start))
                    at = end
                texts.append(None if raw is None else "".join(text[a:b] for a, b in stays))
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append([{"start": a, "end": b} for a, b in stays])
            columns = [c for i, c in enumerate(batch.columns) if i != copies_at]
            columns[text_at if text_at < copies_at else text_at - 1] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, kind), pa.array(removed, kind)], names=names
            )

    return rows


def dedup(
    documents: DataFrame,
    min_words: int = MIN_WORDS,
    unit_words: int = UNIT_WORDS,
) -> DataFrame:
    """All columns of ``documents`` with the text that stays, and __kept, __removed.

    ``__kept`` and ``__removed`` are spans (code points) of the original text;
    the new text is its kept spans, one after another.  Occurrences are ranked
    by doc_id (null first), then a hash of the text, then their place; the first
    stays.  Repeated rows (same id and text) are one document and are cut alike.
    A null text stays null; an empty one has no units.  An empty table gives no
    rows.
    """
    keyed = documents.select("doc_id", F.xxhash64("text").alias("key"), "text").where(F.col("text").isNotNull())
    found = keyed.select(F.col("doc_id").cast("long"), "key", "text").mapInArrow(
        _digests(unit_words), "high long, low long, rank long, key long, unit int"
    )
    place = F.struct("rank", "key", "unit")
    # partial aggregates first: a line that most documents share is one row a task
    firsts = (
        found.groupBy("high", "low")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("high", "low", "first")
    )
    copies = (
        found.join(firsts, ["high", "low"]).where(F.struct("rank", "key", "unit") != F.col("first"))
        .groupBy(F.col("rank").alias("__rank"), F.col("key").alias("__key")).agg(F.collect_set("unit").alias("__copies"))
    )
    key = documents.withColumn("__textkey", F.xxhash64("text")).withColumn("__id", F.col("doc_id").cast("long"))
    marked = key.join(
        copies, F.col("__id").eqNullSafe(F.col("__rank")) & (F.col("__textkey") == F.col("__key")), "left"
    ).select(*documents.columns, "__copies")
    names = [*documents.columns, "__kept", "__removed"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields]
    schema = ", ".join([*fields, f"`__kept` {SPANS}", f"`__removed` {SPANS}"])
    at = documents.columns.index("text")
    return marked.mapInArrow(_cut(min_words, at, len(documents.columns), names), schema)


def clean(documents: DataFrame, **options: int) -> DataFrame:
    """``documents`` with cut texts, the same columns; n_chars counts the new text."""
    cut = dedup(documents, **options)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.length("text").cast(kind))
    return cut.select(*documents.columns)
