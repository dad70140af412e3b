"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow_text import slices
from .chunk_tokens import cached_library_codec


def _schema(kind: str) -> str:
    return f"doc_id {kind}, local_start long, n_tokens long, ids array<int>"


def write_token_ids(docs: DataFrame, out: str, tokenizer: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, added: bool = True) -> None:
    """Writes one row per input row in ascending id order over the files' name order: doc_id,
    local_start (ids before it in its file), n_tokens (with the end id) and ids.

    added: strings of the file's added tokens in a text are these tokens (see library_codec).

    The texts are dealt out by ranges of (id, hash of the text) and sorted, so equal ids
    may span files and no id makes a file large; a task encodes its rows as they come and
    its file gets the running sum, so no pass over the ids follows. Each file's stripes hold
    run-length encoded integers and can be read apart; a row index and a Bloom filter on
    doc_id let a reader skip stripes and row groups. Null ids come first; null and empty
    texts hold the end id only; repeated rows all stay; other columns are ignored, whatever
    their names; an empty table gives files without rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    last = array("I", [end_id]).tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec, at = cached_library_codec(tokenizer, pattern, added), 0
        for b in slices(batches, 1):
            ids = [x + last for x in codec.encode_column(b.column(1))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "local_start", "n_tokens", "ids"])
            at += int(ends[-1])

    coded = rows.mapInArrow(run, _schema(slim.schema["doc_id"].dataType.simpleString()))
    # One file a task, whatever the session says: the running sum is the task's.
    coded.write.option("maxRecordsPerFile", 0).option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "1000").option("orc.create.index", "true").orc(out)


def read_token_ids(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    Stripes are read in parallel; a filter on doc_id reaches the reader, which prunes by
    statistics, row index and Bloom filter; columns that aren't asked for aren't read. The
    files' totals are one row a file.
    """
    kind = (id_type or T.LongType()).simpleString()
    rows = spark.read.schema(_schema(kind)).orc(path).withColumn("_file", F.col("_metadata.file_path"))
    totals = rows.groupBy("_file").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    # By the task's number, whose digits may be more than the five that names are padded to.
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if len(rows.inputFiles()) <= 100_000:  # of about 150 bytes each; beyond that Spark decides
        bases = F.broadcast(bases)
    return rows.join(bases, "_file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The columns but ids_col, and ids_crc32: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    names = [c for c in rows.columns if c != ids_col]
    slim = rows.select(*names, ids_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(names))
            at, values = lists.offsets.to_pylist(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), np.uint32)
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, ids_crc32 long")
