"""Arrow batches of bounded bytes inside Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes in a text column; one row at least.

    Workers live on between stages, so memory the task has freed is given back
    at its end.
    """
    try:
        for batch in batches:
            sizes = pc.binary_length(batch.column(column)).to_pylist()
            start = held = 0
            for i, n in enumerate(sizes):
                if i > start and held + (n or 0) > most:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n or 0
            if start < batch.num_rows:
                yield batch.slice(start)
    finally:
        pa.default_memory_pool().release_unused()
