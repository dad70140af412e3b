"""Scores for SQL: views and functions of a session over a table of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.derivations import STEP
from .functions.scoring import score

#: Functions by name: a share that is 0 of nothing, and tables over the view of scores. Each is one SQL text.
FUNCTIONS = {
    "share": "(n BIGINT, d BIGINT) RETURNS DOUBLE RETURN CASE WHEN d = 0 THEN 0.0D ELSE n / d END",
    "ranked": """(wanted STRING) RETURNS TABLE (model STRING, correct BIGINT, total BIGINT, share DOUBLE, place INT) RETURN
      SELECT model, correct, total, correct / total, CAST(row_number() OVER (ORDER BY correct / total DESC, model) AS INT)
      FROM (SELECT CAST(model AS STRING) AS model, count_if(matches_ground_truth) AS correct, count(*) AS total FROM scores WHERE wanted IS NULL OR difficulty = wanted GROUP BY 1)""",
    "outcomes": """(wanted STRING) RETURNS TABLE (outcome STRING, n BIGINT) RETURN
      SELECT outcome_bucket, count(*) FROM scores WHERE wanted IS NULL OR CAST(model AS STRING) = wanted GROUP BY outcome_bucket""",
}


def register(predictions: DataFrame) -> None:
    """Makes in the session of predictions the views predictions, scores (their score columns as well) and step_lines
    (example_id, step_number, before, after of each line of a derivation), and the functions of FUNCTIONS.

    ranked(difficulty) and outcomes(model) are tables: all rows for null. Views and functions are the session's own
    and go with it; views that have these names are replaced.
    """
    spark = predictions.sparkSession
    predictions.createOrReplaceTempView("predictions")
    score(predictions).createOrReplaceTempView("scores")
    lines = predictions.select("example_id", F.explode(F.split("raw_continuation_text", "\n")).alias("line")).where(F.col("line").rlike(STEP))
    part = lambda k: F.regexp_extract("line", STEP, k)
    lines.select("example_id", part(1).cast("long").alias("step_number"), part(2).alias("before"), part(3).alias("after")).createOrReplaceTempView("step_lines")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
