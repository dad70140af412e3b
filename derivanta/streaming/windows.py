"""Figures of scored predictions by event time, over batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _figures():
    return [F.count("*").alias("total"), F.count_if("matches_ground_truth").alias("correct"), F.count_if("detected_loose").alias("doubted")]


def tumbling(scored: DataFrame, time_col: str, width: str, *keys: str, delay: str | None = None, slide: str | None = None) -> DataFrame:
    """keys, start, end, total, correct and doubted of each window of time that has rows.

    On a stream, delay says how late a row may come: a window closes, and in append mode comes out,
    once the latest time seen is past its end by so much; rows for closed windows are left out. Rows
    without a time are in no window.
    """
    rows = scored if delay is None else scored.withWatermark(time_col, delay)
    found = rows.groupBy(F.window(time_col, width, slide), *keys).agg(*_figures())
    return found.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "correct", "doubted")


def sessions(scored: DataFrame, time_col: str, gap: str, *keys: str, delay: str | None = None) -> DataFrame:
    """keys, start, end (gap after the last row), total, correct and doubted of each session: rows of the same keys
    without a gap of that length between them. Late rows may join sessions that are still open, and tie two
    into one; delay is as for tumbling. A stream needs a key."""
    rows = scored if delay is None else scored.withWatermark(time_col, delay)
    found = rows.groupBy(F.session_window(time_col, gap), *keys).agg(*_figures())
    return found.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "total", "correct", "doubted")
