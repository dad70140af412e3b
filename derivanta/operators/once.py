"""Costly work on values that many rows share, done once for each distinct value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.scratch import Scratch


def once_each(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """rows with the columns that work adds to keys (keys of a type that can be grouped, nulls included).

    work gets the distinct keys, dealt to all cores, and returns them, each once, with further columns. Its
    result is written, so that Spark knows its size: a small one is broadcast and rows stay where they are,
    a large one meets them by a shuffle. rows is read twice.
    """
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = scratch.save(work(rows.select(*keys).distinct().repartition(n, *keys)), "once")
    named = {k: f"_once_{k}" for k in keys}
    made = made.withColumnsRenamed(named)
    on = [rows[k].eqNullSafe(made[named[k]]) for k in keys]
    return rows.join(made, on).drop(*named.values())
