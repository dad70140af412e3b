"""What the vector operators share: reading embedding columns inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """id, label (null without label_col), dim, h1, h2 (a 128-bit hash of the vector) and v (binary doubles):
    rows whose vector is not null, of some length other than zero, with finite components only."""
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit(None).cast("string")
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, dim, h1, h2, out = [], [], [], [], []
            for i, v in enumerate(b.column(2)):
                if not v.is_valid or not len(v):
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # one zero
                if v.values.null_count or not np.isfinite(x).all() or not x.any():
                    continue
                raw = x.tobytes()
                d = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
                take.append(i)
                dim.append(len(x))
                h1.append(int(d[0]))
                h2.append(int(d[1]))
                out.append(raw)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dim, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out, pa.binary())], names=["id", "label", "dim", "h1", "h2", "v"])

    return slim.mapInArrow(run, "id long, label string, dim int, h1 long, h2 long, v binary")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows in pairs, in double precision; depends on the two rows alone, not on their place."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
