"""A corpus pipeline: quality classifier, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns
the rows it keeps; the last returns packed pieces. run() writes each stage's rows as Parquet
in the shared folder and reads them for the next.
"""

from __future__ import annotations

from derivanta.llm import line_dedup, minhash, quality
from derivanta.llm.common import Scratch
from derivanta.llm.queries import pack_documents
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, whatever their ids. Its decision follows from text, source
    and language, so rows equal in these and the id, with the text as 128 bits of hashes, share it."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = F.struct("doc_id", "source", "lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    judged = quality.classify(docs.withColumn("_key", key), model, F.col("source"), F.col("lang"), id_col="_key")
    gone = judged.where("not keep").select(*[F.col(f"doc_id.{c}").alias(f"_{c}") for c in ("doc_id", "source", "lang", "h1", "h2")]).distinct()
    same = (F.xxhash64("text") == F.col("_h1")) & (F.xxhash64(F.lit(1), "text") == F.col("_h2"))
    for c in ("doc_id", "source", "lang"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text. A document that lost lines and
    has nothing but ASCII white space left (as at the ends of a line's key) goes as well."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least id; five words, 0.8."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("packing", packing_stage)]

#: A fitted classifier and a packing plan have no SQL form; tests/llm/test_pipeline_plain.py holds each stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of documents. A stage's rows go once the next one's are written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
