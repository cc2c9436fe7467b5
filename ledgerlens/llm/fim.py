"""Fill-in-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that
never change: the batch's UTF-8 text as Arrow holds it, and one with the
sentinels.  Cutting splits descriptors, an arrangement permutes them and puts
sentinel descriptors between, the inverse permutation restores the document,
and hashes and outputs stream the descriptors: no step rebuilds a text to cut,
move or hash it.  ``restore`` starts from output and form alone: it finds the
sentinels in the output, which becomes descriptors in its turn.

Cuts fall between units (lines by default) and come from a hash of the id, so a
rerun gives the same output.  No shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import by_bytes
from ledgerlens.llm.tables import text_or_empty

PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
TEXT, MARKS = 0, 1
LINE_FEED = 10

#: Order of the parts (0 prefix, 1 middle, 2 suffix) and of the sentinels before
#: them.  Fixed values of the two forms.
ARRANGEMENTS = {"psm": ((0, 2, 1), (PREFIX, SUFFIX, MIDDLE)), "spm": ((2, 0, 1), (SUFFIX, PREFIX, MIDDLE))}


class Descriptor(NamedTuple):
    buffer: int
    start: int
    end: int


class Pieces:
    """A sequence of descriptors over shared, immutable buffers."""

    def __init__(self, buffers: tuple[memoryview, ...], descriptors: Iterable[Descriptor]) -> None:
        self.buffers = buffers
        self.descriptors = [d for d in descriptors]

    def split(self, *places: int) -> list[Pieces]:
        """Parts before, between and after ascending byte places of the sequence."""
        parts: list[list[Descriptor]] = [[] for _ in range(len(places) + 1)]
        at = part = 0
        for d in self.descriptors:
            start = d.start
            while part < len(places) and places[part] < at + d.end - start:
                cut = start + places[part] - at
                if cut > start:
                    parts[part].append(Descriptor(d.buffer, start, cut))
                at, start, part = places[part], cut, part + 1
            parts[part].append(Descriptor(d.buffer, start, d.end))
            at += d.end - start
        return [Pieces(self.buffers, p) for p in parts]

    @staticmethod
    def join(parts: Iterable[Pieces]) -> Pieces:
        parts = list(parts)
        return Pieces(parts[0].buffers, (d for p in parts for d in p.descriptors))

    def stream(self) -> Iterator[memoryview]:
        for d in self.descriptors:
            yield self.buffers[d.buffer][d.start : d.end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def chars(self) -> int:
        """Code points: bytes that do not continue one."""
        return sum(int(np.count_nonzero((np.frombuffer(p, np.uint8) & 0xC0) != 0x80)) for p in self.stream())

    def find(self, what: bytes, start: int = 0) -> int:
        """Byte place of ``what`` in a sequence of one descriptor, or -1."""
        (d,) = self.descriptors
        whole = self.buffers[d.buffer].obj
        found = whole.find(what, d.start + start, d.end)
        return found if found < 0 else found - d.start


_MARKS = memoryview(b"".join(SENTINELS))


def _mark(buffers: tuple[memoryview, ...], sentinel: bytes) -> Pieces:
    at = SENTINELS.index(sentinel) * len(sentinel)
    return Pieces(buffers, [Descriptor(MARKS, at, at + len(sentinel))])


def arrange(parts: list[Pieces], form: str) -> Pieces:
    """Prefix, middle and suffix in the order of ``form``, a sentinel before each."""
    order, marks = ARRANGEMENTS[form]
    return Pieces.join(x for p, m in zip(order, marks, strict=True) for x in (_mark(parts[p].buffers, m), parts[p]))


def undo(output: Pieces, form: str) -> Pieces:
    """The document of an output of one descriptor: parts between its sentinels, put back.

    Every sentinel is found left to right; a text that held one stayed plain.
    """
    if form not in ARRANGEMENTS:
        return output
    order, marks = ARRANGEMENTS[form]
    size, places, at = sum(d.end - d.start for d in output.descriptors), [], 0
    for m in marks:
        at = output.find(m, at)
        if at < 0:
            raise ValueError(f"{form} output without its sentinel {m.decode()}")
        places.append(at)
        at += len(m)
    found = [
        output.split(a + len(m), b)[1] for m, a, b in zip(marks, places, [*places[1:], size], strict=True)
    ]
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return Pieces.join(found[i] for i in inverse)


def line_ends(text: memoryview) -> np.ndarray:
    """End places of the lines, line feed included; the last line may lack one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == LINE_FEED) + 1
    return ends if not len(text) or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def chosen_hash(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def cut(whole: Pieces, ends: np.ndarray, h: tuple[int, int, int, int], fim_percent: int, spm_percent: int) -> tuple[str, list[Pieces]]:
    """The form of a document and its three parts (none where it stays plain)."""
    if not len(ends) or h[2] % 100 >= fim_percent or any(whole.find(s) >= 0 for s in SENTINELS):
        return "plain", []
    n = len(ends) + 1
    places = [0 if u == 0 else int(ends[u - 1]) for u in sorted((h[0] % n, h[1] % n))]
    return "spm" if h[3] % 100 < spm_percent else "psm", whole.split(*places)


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, output string"


def transform(documents: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, output of each row.

    Units are the lines of the whole text.  The first two words of
    sha256("seed:doc_id") place the cuts, the third and fourth choose the form: ``plain`` where the text
    is empty, holds a sentinel or falls outside ``fim_percent``, else ``spm`` for
    ``spm_percent`` of the ids, ``psm`` for the rest; plain rows have null part
    sizes.  A null text is empty; a null id hashes as no digits.  Repeated rows
    are cut alike, each; an empty table gives no rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in by_bytes(batches, 1):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                buffers = (memoryview(text.as_py()), _MARKS)
                whole = Pieces(buffers, [Descriptor(TEXT, 0, len(buffers[TEXT]))])
                ends = line_ends(buffers[TEXT])
                form, parts = cut(whole, ends, chosen_hash(doc_id, seed), fim_percent, spm_percent)
                made = arrange(parts, form) if parts else whole
                sizes = (parts[0].chars(), parts[1].chars()) if parts else (None, None)
                row = (doc_id, len(ends), form, *sizes, made.sha256(), b"".join(made.stream()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return ids.mapInArrow(rows, OUT)


def restore(outputs: DataFrame, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """``keep``, restored_sha256 and (on request) restored of each row, from its
    ``output`` and ``form`` alone.

    A null output is empty; a null or unknown form counts as plain.  An output
    that lacks a sentinel of its form is no output of ``transform`` and is an
    error.
    """
    kept = outputs.select(*keep).schema
    schema = kept.add("restored_sha256", "string")
    if with_text:
        schema = schema.add("restored", "string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            digests, texts = [], []
            for output, form in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                buffer = memoryview(output.as_py())
                made = undo(Pieces((buffer, _MARKS), [Descriptor(TEXT, 0, len(buffer))]), form)
                digests.append(made.sha256())
                if with_text:
                    texts.append(b"".join(made.stream()))
            arrays = [*batch.columns[2:], pa.array(digests, pa.string())]
            if with_text:
                arrays.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    read = outputs.select(F.coalesce("output", F.lit("")).alias("__output"), F.col("form").alias("__form"), *keep)
    return read.mapInArrow(rows, schema)
