"""Scoring predictions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scoring import score
from ..sources.jsonl import PREDICTION


def score_stream(spark: SparkSession, path: str, time_col: str | None = None, delay: str = "7 days", schema: str = PREDICTION) -> DataFrame:
    """A stream of scored rows over a folder of JSON Lines files; one row of each example_id counts.

    With time_col, a timestamp of the schema, the ids of the last delay are kept as state: a row that
    comes back within that time counts once, and rows later than it are left out. Without it
    an id may come back at any time, so all ids are kept: for bounded logs only.
    """
    rows = spark.readStream.schema(schema).json(path)
    if time_col is None:
        return score(rows.dropDuplicates(["example_id"]))
    return score(rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["example_id"]))
