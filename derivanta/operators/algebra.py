"""Finite algebras as tables: op_table (op, lhs, rhs, result) and transform (name, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_entries(symbols: DataFrame, table: DataFrame) -> DataFrame:
    """(op, lhs, rhs) without a result among the symbols. The pairs of an operator are made within its row,
    from the list of symbols; they are as many as its complete table has."""
    s = symbols.select("symbol").distinct()
    every = s.agg(F.collect_list("symbol").alias("all")).scalar()
    pairs = table.select("op").distinct().withColumn("all", every).select("op", F.explode("all").alias("lhs"), "all").select("op", "lhs", F.explode("all").alias("rhs"))
    good = table.join(s, table.result == s.symbol, "left_semi")
    return pairs.join(good, ["op", "lhs", "rhs"], "left_anti")


def permutations(symbols: DataFrame, most: int = 8) -> DataFrame:
    """items and mapping: an array of images, by the order of the symbols, for each permutation but the identity.
    There are as many as the factorial of their number, which may be most at most; more fail the job."""
    n = F.size("items")
    many = F.raise_error(F.concat(n.cast("string"), F.lit(" symbols have too many permutations"))).cast("int")
    items = symbols.agg(F.array_sort(F.collect_set("symbol")).alias("items")).where(F.when(n > most, many).otherwise(n) >= 0)
    out = items.withColumn("mapping", F.slice("items", 1, 0))
    for _ in range(most):
        # A whole permutation stays as it is.
        following = F.when(F.size("mapping") < n, F.transform(F.array_except("items", "mapping"), lambda x: F.concat("mapping", F.array(x)))).otherwise(F.array("mapping"))
        out = out.select("items", F.explode(following).alias("mapping"))
    return out.where("mapping <> items")


def valid_transformations(symbols: DataFrame, table: DataFrame) -> DataFrame:
    """(op, mapping) of the permutations but the identity that distribute over each operator. The operators' tables are
    one value, which the permutations read: no join."""
    entry = F.struct(F.struct("lhs", "rhs").alias("k"), F.col("result").alias("v"))
    ops = table.groupBy("op").agg(F.map_from_entries(F.collect_list(entry)).alias("of")).agg(F.collect_list(F.struct("op", "of"))).scalar()
    both = permutations(symbols).withColumn("all", ops).select("items", "mapping", F.explode("all").alias("o")).select("items", "mapping", "o.*")
    at = lambda x: F.get("mapping", (F.array_position("items", x) - 1).cast("int"))
    fits = F.forall(F.map_entries("of"), lambda e: at(e["value"]) == F.try_element_at("of", F.struct(at(e["key"]["lhs"]).alias("lhs"), at(e["key"]["rhs"]).alias("rhs"))))
    return both.where(fits).select("op", "mapping")


def permutation_order(places: Column) -> Column:
    """Of an array of places from 0, how often the permutation must be repeated to give each place back: the
    least common multiple of its cycles' lengths."""
    n = F.size(places)
    walk = lambda i: F.aggregate(F.sequence(F.lit(1), n), F.struct(F.get(places, i).alias("at"), F.lit(1).alias("k"), (F.get(places, i) == i).alias("back")), lambda acc, _: F.when(acc["back"], acc).otherwise(F.struct(F.get(places, acc["at"]).alias("at"), (acc["k"] + 1).alias("k"), (F.get(places, acc["at"]) == i).alias("back"))))["k"]
    lengths = F.transform(F.sequence(F.lit(0), n - 1), walk)
    multiple = lambda acc, k: acc * F.get(F.filter(F.sequence(F.lit(1), k), lambda m: acc * m % k == 0), F.lit(0))
    return F.aggregate(lengths, F.lit(1), multiple)


def derived_table(table: DataFrame, name: str, template: str, base: str) -> DataFrame:
    """The table of a derived operator: compose_left (x o y) o x, or double_left (x o x) o y."""
    t = table.where(F.col("op") == base)
    first = t.select(F.col("lhs").alias("x"), F.col("rhs").alias("y"), F.col("result").alias("v"))
    second = t.select(F.col("lhs").alias("v"), F.col("rhs").alias("w"), F.col("result"))
    if template == "compose_left":
        return first.join(second.withColumnRenamed("w", "x"), ["v", "x"]).select(F.lit(name).alias("op"), F.col("x").alias("lhs"), F.col("y").alias("rhs"), "result")
    if template == "double_left":
        return first.where("x = y").join(second, "v").select(F.lit(name).alias("op"), F.col("x").alias("lhs"), F.col("w").alias("rhs"), "result")
    raise ValueError(f"unknown template {template}")


def distribution_counterexamples(table: DataFrame, transform: DataFrame) -> DataFrame:
    """(name, op, lhs, rhs) where t(lhs o rhs) differs from t(lhs) o t(rhs)."""
    t = lambda src, dst: transform.select("name", F.col("src").alias(src), F.col("dst").alias(dst))
    one = table.join(t("result", "outer"), "result").join(t("lhs", "tl"), ["name", "lhs"]).join(t("rhs", "tr"), ["name", "rhs"])
    other = table.select("op", F.col("lhs").alias("tl"), F.col("rhs").alias("tr"), F.col("result").alias("inner"))
    return one.join(other, ["op", "tl", "tr"]).where("outer <> inner").select("name", "op", "lhs", "rhs")
