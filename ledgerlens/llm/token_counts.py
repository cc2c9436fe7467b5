"""Token counts: batch encoding in Arrow functions that return lengths only.

Inside a task the rows are regrouped into batches of about equal bytes, and a
long text is encoded in parts cut at places no token crosses, so a task holds
the ids of one part at a time and returns two numbers for each document.  No
shuffle: the scan's splits are already balanced by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import BATCH_BYTES, by_bytes
from ledgerlens.llm.tables import text_or_empty
from ledgerlens.llm.tokens import encoder, pieces, text_of

PART_CHARS = 1 << 16


def _counter(path: str, part_chars: int, batch_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut = encoder(path)
        for batch in by_bytes(batches, 1, batch_bytes):
            raw = batch.column(1).cast(pa.binary())
            tokens = [
                sum(len(encode(part)) for part in pieces(text_of(v), cut, part_chars)) for v in raw.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(raw), pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    documents: DataFrame,
    tokenizer: str,
    limit: int = 512,
    part_chars: int = PART_CHARS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``documents``.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted
    each; null ids are kept; other columns are not read.  ``tokenizer`` is a
    file path valid on every executor.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(
        _counter(tokenizer, part_chars, batch_bytes), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
