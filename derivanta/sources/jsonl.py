"""JSON Lines tables: explicit schemas, splits by folder, append."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PREDICTION = """example_id string, base_id string, difficulty string, error_type string, ground_truth_final_output string,
wrong_branch_final_output string, chain_length_x int, prefill_error_step int, raw_continuation_text string, mode string,
turn_2_user_sent string, turn_2_level int, response_id string, request_latency_seconds double, model string, provider string,
api_model string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, total_tokens bigint"""

SYSTEM = """name string, seed bigint, symbols array<string>,
base_operations array<struct<name:string,symbol_id:string,table:map<string,string>>>,
derived_operations array<struct<name:string,symbol_id:string,template_id:string,base_ops:array<string>,transform_name:string>>,
transformations array<struct<name:string,mapping:map<string,string>,distributes_over:array<string>>>"""


def read_jsonl(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    """Blank lines are skipped; the schema is never inferred."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (a line that isn't blank) and ordinal: its place, from 0, in the file, or over several files by
    the order of their names.

    A file of several splits is read in parallel. A line's place follows from its file, the split's
    offset and its place in the split; only one count a split meets in a window.
    """
    lines = spark.read.text(path).where("trim(BOTH ' \t\r' FROM value) <> ''")
    own = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = own.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return own.join(shifts, ["file", "block"]).select("value", (F.col("at") + F.col("shift")).alias("ordinal"))


def read_ordered(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    """The rows of read_jsonl with ordinal, their place among the lines; a broken line's fields are null."""
    return read_lines(spark, path).select(F.from_json("value", schema).alias("row"), "ordinal").select("row.*", "ordinal")


def slice_rows(rows: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """Rows of read_ordered from the start-th on, count of them or all: a filter, no sort."""
    if start < 0 or count is not None and count < 1:
        raise ValueError("start must be at least 0 and count at least 1")
    return rows.where((F.col("ordinal") >= start) & (F.lit(True) if count is None else F.col("ordinal") < start + count))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_splits(rows: DataFrame, path: str, splits: list[str]) -> None:
    """A folder {split}.jsonl of JSON lines for each of the splits that has rows; null fields are written too.
    The rows are worked out once: they are written by split, and the folders get their names then."""
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    own = rows.where(F.col("split").isin(*splits)).withColumn("_split", F.col("split"))
    own.write.partitionBy("_split").option("ignoreNullFields", "false").json(staged)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in splits:
        if fs.exists(at(f"{staged}/_split={s}")):
            if fs.exists(at(f"{path}/{s}.jsonl")):
                raise FileExistsError(f"{path}/{s}.jsonl")
            fs.rename(at(f"{staged}/_split={s}"), at(f"{path}/{s}.jsonl"))
    fs.delete(at(staged), True)
