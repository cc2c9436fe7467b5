"""Packing token sequences: shortest-pack-first over the length histogram.

Each document (its ids and one end id) is cut into full sequences and one rest.
Only the histogram of piece lengths (at most ``capacity`` rows) reaches the
driver.  There lengths are placed longest first, always into the packs that are
shortest so far; equal packs are held as one pattern with a count, so the work
depends on the number of lengths, not of documents.  The patterns become runs
"ranks a..b of length L go to sequences s.. at offset o", and every piece finds
its run by its rank among the pieces of its length.  Ranks come from salted
counts, the salts from the most frequent length, so a length that holds most
rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.batches import by_bytes
from ledgerlens.llm.tables import text_or_empty
from ledgerlens.llm.token_counts import PART_CHARS
from ledgerlens.llm.tokens import encoder, pieces, text_of
from ledgerlens.session import materialize

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
IDS_SCHEMA = ", text_hash long, ids array<int>"
#: Rows of one length that are ranked together.
RANKED_ROWS = 4096


class Run(NamedTuple):
    """Ranks first_rank .. end_rank-1 of ``length``: ``copies`` to a sequence."""

    length: int
    first_rank: int
    end_rank: int
    copies: int
    first_sequence: int
    first_offset: int


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> list[Run]:
    """Runs that place every piece of the histogram; gapless from offset 0."""
    packs: list[tuple] = []  # heap of (used, tie, number of packs, ((length, copies), ...))
    full: list[tuple] = []
    tie = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= capacity:
                used, _, count, slots = heapq.heappop(packs)
                if count > left:
                    tie += 1
                    heapq.heappush(packs, (used, tie, count - left, slots))
                    count = left
            else:
                used, count, slots = 0, left, ()
            left -= count
            more = slots[-1][1] + 1 if slots and slots[-1][0] == length else 1
            slots = (*(slots[:-1] if more > 1 else slots), (length, more))
            tie += 1
            pack = (used + length, tie, count, slots)
            if pack[0] < capacity:
                heapq.heappush(packs, pack)
            else:
                full.append(pack)
    runs, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for _, _, count, slots in full + sorted(packs):
        offset = 0
        for length, copies in slots:
            first = ranks[length]
            ranks[length] = first + count * copies
            runs.append(Run(length, first, ranks[length], copies, sequence, offset))
            offset += length * copies
        sequence += count
    return runs


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut = encoder(path)
        end = np.array([end_id], dtype=np.uint32)
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")] + ["text_hash", "ids"] * with_ids
        for batch in by_bytes(batches, 1):
            docs = batch.column(0).to_pylist()
            hashes = batch.column(2).to_pylist()
            out: list[list] = [[] for _ in names]
            for doc, text_hash, value in zip(docs, hashes, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                parts = [encode(p) for p in pieces(text_of(value), cut, PART_CHARS)]
                ids = np.concatenate([*parts, end]).astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), text_hash, piece.astype(np.int32))
                    for values, v in zip(out, row, strict=False):
                        values.append(v)
            kinds = [pa.int64()] * 5 + [pa.int64(), pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return cut_batches


def cut_documents(
    documents: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False
) -> DataFrame:
    """The pieces of each document: full ones of ``capacity`` ids and the rest."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text") if with_ids else F.lit(0).cast("long"))
    schema = PIECE_SCHEMA + (IDS_SCHEMA if with_ids else "")
    return rows.mapInArrow(_cutter(tokenizer, capacity, end_id, with_ids), schema)


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """``cut`` with ``rank`` 0.. among the pieces of equal length."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    within = salted.withColumn("at", F.row_number().over(order) - 1)
    return within.join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("at"))


def pack(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    salts: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ``copy`` and ``ids`` on request).

    ``copy`` numbers from 0 the rows with one id and text, so that doc_id,
    text_hash (returned with it), copy and start name one piece.  A null or empty text is the end id alone.  Repeated rows are packed each.
    Pieces of one length are interchangeable, so ties only decide which of them
    goes where; the order is by hash and id, the same in every run.  An empty
    table gives no rows.  Other columns are not read.
    """
    spark = documents.sparkSession
    cut = materialize(cut_documents(documents, tokenizer, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        pack_histogram(histogram, capacity),
        "run_length long, first_rank long, end_rank long, copies long, first_sequence long, first_offset long",
    )
    at = F.col("rank") - F.col("first_rank")
    pieces_at = ranked(cut, salts or -(-max(histogram.values(), default=1) // RANKED_ROWS))
    if with_ids:  # copies of a piece have one length and salt: no further exchange
        alike = Window.partitionBy("length", "salt", "doc_id", "text_hash", "start").orderBy("ids_crc32")
        pieces_at = pieces_at.withColumn("copy", (F.row_number().over(alike) - 1).cast("long"))
    placed = pieces_at.join(
        F.broadcast(runs),  # patterns over at most ``capacity`` lengths, whatever the input
        (F.col("length") == F.col("run_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("end_rank")),
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(at, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
        *(["text_hash", "copy", "ids"] if with_ids else []),
    )
