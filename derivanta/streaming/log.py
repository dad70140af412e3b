"""An append-only log of attempts, over batches and streams alike: the last success of each example."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "example_id string, attempt long, raw_continuation_text string, attempts long"


def latest(attempts: DataFrame) -> DataFrame:
    """example_id, attempt, raw_continuation_text and attempts: of each example's attempts (example_id, attempt,
    raw_continuation_text) the last success, that of the highest number with a text, ties to the
    greater text, and how many attempts there were. Examples without a success have nulls.

    Attempts may come in any order. On a stream, in update mode, an example's row comes again whenever it has
    new attempts, and the last one is what a batch over all of them gives; a query that is started
    again goes on from its checkpoint. The state is one row an example.
    """
    rows = attempts.where("example_id is not null")
    won = F.max(F.when(F.col("raw_continuation_text").isNotNull(), F.struct("attempt", "raw_continuation_text"))).alias("won")
    return rows.groupBy("example_id").agg(won, F.count("*").alias("attempts")).select("example_id", F.col("won.attempt").alias("attempt"), F.col("won.raw_continuation_text").alias("raw_continuation_text"), "attempts")
