"""Cyclic groups as operation tables (op, lhs, rhs, result), and their automorphisms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_table(labels: DataFrame) -> DataFrame:
    """(op, symbol, label) -> the table of each op: labels 0 to n - 1 add modulo n.

    The join is on op, so a group of n symbols makes n * n rows, which is its table. Rows with a
    null op or label are left out; labels of one op must be distinct.
    """
    side = lambda s, n: labels.select("op", F.col("symbol").alias(s), F.col("label").alias(n))
    order = labels.where("label is not null").groupBy("op").agg(F.count("*").alias("n"))
    pairs = side("lhs", "i").join(side("rhs", "j"), "op").join(order, "op").withColumn("label", F.pmod(F.col("i") + F.col("j"), "n"))
    return pairs.join(side("result", "label"), ["op", "label"]).select("op", "lhs", "rhs", "result")


def automorphisms(table: DataFrame) -> DataFrame:
    """(op, k, src, dst): of each cyclic group the maps x -> k * x, k >= 2 and prime to the order.

    The labels are recovered from the table alone: a generator is a symbol whose powers, which a fold
    over the group's table lists, meet all symbols; any generator gives the same maps, and the
    least is taken. A table that is no cyclic group has no generator and no rows.
    """
    kind = dict(table.dtypes)["result"]
    key = lambda x, y: F.struct(x.alias("lhs"), y.alias("rhs"))
    group = table.groupBy("op").agg(
        F.map_from_entries(F.collect_set(F.struct(key(F.col("lhs"), F.col("rhs")), "result"))).alias("of"),
        F.collect_set("lhs").alias("symbols"),
    )
    step = lambda g: lambda acc, _: F.concat(acc, F.array(F.try_element_at("of", key(F.element_at(acc, -1), g))))
    # g, g + g, ...: the last of n terms is the unit, so that term i has label i + 1 modulo n.
    powers = lambda g: F.aggregate(F.sequence(F.lit(2), F.size("symbols")), F.array(g).cast(f"array<{kind}>"), step(g))
    whole = lambda p: (F.size(F.array_distinct(F.filter(p, lambda v: v.isNotNull()))) == F.size("symbols"))
    tried = F.transform(F.array_sort("symbols"), lambda g: F.when(F.size("symbols") > 1, powers(g)))
    group = group.withColumn("powers", F.get(F.filter(tried, lambda p: whole(p)), F.lit(0))).where("powers is not null")
    group = group.withColumn("n", F.size("powers")).where("n > 2").withColumn("k", F.explode(F.expr("sequence(2, n - 1)")))
    # k is prime to n if k * 1, ..., k * n differ modulo n.
    group = group.where("size(array_distinct(transform(sequence(1, n), i -> i * k % n))) = n")
    out = group.select("op", "k", "n", "powers", F.posexplode("powers").alias("i", "src"))
    return out.select("op", "k", "src", F.get("powers", F.pmod((F.col("i") + 1) * F.col("k") - 1, F.col("n")).cast("int")).alias("dst"))
