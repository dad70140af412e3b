"""Consecutive numbers in order, without bringing a group's rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch


def numbered(rows: DataFrame, group: str | None, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with place (from 0, in order within the group or in all, nulls first) and n (rows of the group).

    Range partitions of (group, order) are written with their local numbers; only one count for each
    group and partition meets in a window, so a group may span any number of partitions. rows
    should be a written table of slim rows, as Spark reads it twice, the first time for a sample
    of its keys. group holds no nulls. Ties come in any order, but in the same one whenever
    the result is read.
    """
    by = [group] if group else []
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    local = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    local = scratch.save(local, "numbered").withColumn("_part", F.shiftright("_at", 33))
    parts = local.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*by)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return local.join(parts, [*by, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n")
