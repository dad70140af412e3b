"""Small helpers for operators that read whole texts in Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches, column: int | str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about max_bytes of text each, so that what a task holds does
    not follow the batch size; a longer single text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            total += size
            if total >= max_bytes:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """Texts as str, null as the empty one."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """A column of texts or binaries as one byte string and the bounds between rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return b"", np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if data is not None else b""), bounds - bounds[0]
