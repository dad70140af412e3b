"""Draws that follow from a seed and a name: no state is carried from one to the next.

A draw is the first 32 bits of the MD5 digest of "seed:name:number", so that any engine can make it, in any
order and in any task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: Column, *names) -> Column:
    return F.substring(F.md5(F.concat_ws(":", seed.cast("string"), *[(n if isinstance(n, Column) else F.lit(n)).cast("string") for n in names])), 1, 8)


def draw(seed: Column, below: Column | int, *names) -> Column:
    """A number from 0 up to below."""
    n = F.lit(below) if isinstance(below, int) else below
    return F.pmod(F.conv(_digest(seed, *names), 16, 10).cast("bigint"), n.cast("bigint")).cast("int")


def shuffled(seed: Column, n: Column | int, *names) -> Column:
    """The numbers from 0 up to n in a drawn order."""
    end = F.lit(n) if isinstance(n, int) else n
    every = F.transform(F.sequence(F.lit(0), end - 1), lambda i: F.struct(_digest(seed, *names, i).alias("by"), i.cast("int").alias("i")))
    return F.when(end > 0, F.transform(F.array_sort(every), lambda x: x["i"])).otherwise(F.array().cast("array<int>"))


def picked(items: list[str], place: Column) -> Column:
    """Of fixed values, the one at a place."""
    return F.get(F.array(*[F.lit(x) for x in items]), place)
