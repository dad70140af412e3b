"""Removal of lines that earlier documents hold, over levelled sorted runs of line hashes.

Documents come in batches of rising ids. The runs hold the hash and the first document of each line
seen so far, bucketed and sorted by hash. A batch's distinct hashes are merge-joined with the
runs: what is not in any run is added as a run of its own, and two runs of one level are
merged into one of the next, so there are about as many runs as the number of batches has digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import slices, texts
from .common import Scratch, fresh

_SPACE = b" \t\n\x0b\x0c\r"


def line_hashes(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, whole (a hash of the text), line (from 0), h1, h2: one row for each line whose key has at
    least min_chars code points. The key is the line without ASCII white space at its ends, with A-Z
    lower-cased; h1, h2 are the halves of its 128-bit hash. Rows with a null id give none."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("whole")).where("doc_id is not null")

    def run(batches) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in slices(batches, 1):
            row, line, hashes = [], [], []
            for i, t in enumerate(texts(b, 1)):
                for k, raw in enumerate(t.encode().split(b"\n")):
                    key = raw.strip(_SPACE).lower()
                    if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
                        row.append(i)
                        line.append(k)
                        hashes.append(digest(key))
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            own = [b.column(c).take(pa.array(row, pa.int64())) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(line, pa.int32()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=["doc_id", "whole", "line", "h1", "h2"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, whole long, line int, h1 long, h2 long")


class LineRuns:
    """The lines seen so far, with the first document of each, as levelled runs.

    Each run is a table in the shared folder, in hash buckets, each sorted by hash, so that a
    join with a batch moves the batch only. add() must get batches in order of rising ids.
    close() removes the tables and their files.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.scratch, self.levels, self.paths = Scratch(spark, "line-runs"), {}, {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = self.scratch.path("run")
        rows = rows.repartition(self.buckets, "h1", "h2")
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.delete(self.paths.pop(name))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(n) for n in self.levels.values()]

    def add(self, keys: DataFrame) -> DataFrame:
        """keys: h1, h2, low, high (least and largest doc_id of the batch that holds the line). Adds
        the new ones as a run. Returns h1, h2, owner for those that two documents hold by now."""
        found = keys
        owner = F.col("low")
        for i, run in enumerate(self.tables()):
            found = found.join(run.select("h1", "h2", F.col("owner").alias(f"o{i}")), ["h1", "h2"], "left")
            owner = F.least(F.col(f"o{i}"), owner)
        known = [F.col(c).isNotNull() for c in found.columns if c[0] == "o"]
        seen = F.lit(False)
        for k in known:
            seen = seen | k
        merged = self.scratch.save(found.select("h1", "h2", owner.alias("owner"), seen.alias("seen"), (F.col("low") != F.col("high")).alias("twice")), "merged")
        level, run = 0, self._write(merged.where("not seen").select("h1", "h2", "owner"))
        while level in self.levels:
            other = self.levels.pop(level)
            both = self._write(self.spark.table(other).unionByName(self.spark.table(run)))
            self._drop(other)
            self._drop(run)
            run, level = both, level + 1
        self.levels[level] = run
        return merged.where("seen or twice").select("h1", "h2", "owner")

    def close(self) -> None:
        for n in [*self.paths]:
            self._drop(n)
        self.levels = {}
        self.scratch.clear()


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text's repeated lines gone, n_lines (before) and n_dropped.

    Lines are cut at line feeds. A key (see line_hashes) that at least two documents hold keeps its
    lines only in the document of least id, there all of them; the kept lines stay in order.
    A text left without lines is empty; a null or empty text is one empty line. Rows of equal
    id count as one document, whose lines are those of all its rows: each row loses those of its own
    lines that a smaller id holds. Rows with a null id stay whole. Input columns named n_lines or n_dropped are replaced, any other name may occur. Ids
    that are no numbers come as one batch. An empty table gives none.

    A key meets others as one row a task (least and largest id), so a line that a third of all
    documents hold is no large group; rows of dropped lines go through a join that AQE can
    split. Texts move once, to meet the list of their dropped lines: that list grows with the
    input, so it is merged at every size and never broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    lines = scratch.save(line_hashes(docs, min_chars, id_col, text_col), "lines")
    cuts = []
    if batches > 1 and isinstance(lines.schema["doc_id"].dataType, T.NumericType):
        cuts = sorted(set(lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dropped = None
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            inside = F.lit(True)
            inside = inside & (F.col("doc_id") > low) if low is not None else inside
            inside = inside & (F.col("doc_id") <= high) if high is not None else inside
            batch = lines.where(inside)
            keys = batch.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            repeated = runs.add(keys)
            part = batch.join(repeated, ["h1", "h2"]).where("doc_id > owner").select("doc_id", "whole", "line")
            dropped = part if dropped is None else dropped.unionByName(part)
        drops = scratch.save(dropped.groupBy("doc_id", "whole").agg(F.collect_set("line").alias("lines")), "drops")
    finally:
        runs.close()
    scratch.drop(lines)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    slim = docs.select(*[F.col(f"`{c}`") for c in names])
    doc, whole, drop = fresh(slim, "doc", "whole", "drop")
    listed = drops.select(F.col("doc_id").alias(doc), F.col("whole").alias(whole), F.col("lines").alias(drop)).hint("merge")
    same = F.xxhash64(slim[f"`{text_col}`"].cast("string")) == listed[whole]
    joined = slim.join(listed, (slim[f"`{id_col}`"] == listed[doc]) & same, "left")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cut = F.split(text, "\n", -1)
    # Within the function the cut text is a value: it is split once, not once a line.
    rest = lambda c: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col(drop)), lambda i: F.get(c, i)), "\n")
    new = F.when(F.col(drop).isNull(), F.col(f"`{text_col}`")).otherwise(F.get(F.transform(F.array(cut), rest), F.lit(0)))
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], F.size(cut).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
