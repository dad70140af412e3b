"""Reports over scored continuations, and the small relational operators around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import BUCKETS

#: Why a generated example is passed over, in the order in which the reasons are listed.
REJECTIONS = ["chain_too_short", "insufficient_runway", "no_eligible_in_chain", "no_eligible_in_window", "cascade_convergent", "other_injector_error"]


def rate(n: Column, d: Column) -> Column:
    """n / d with four digits, 0.0 if d is 0: the double n / d rounded by its exact value, so that a
    fraction that ends in a five goes where the double lies, and to even only where that is exact."""
    n, d = n.cast("long"), d.cast("long")
    x = n / d
    low = F.call_function("div", n * 10_000, d)
    twice = 2 * (n * 10_000 - low * d)
    # The double's distance from n / d, times d: in two parts, of which the first is exact.
    high = F.floor(x * (1 << 26)) / (1 << 26)
    over = (high * d - n) + (x - high) * d
    up = (twice > d) | ((twice == d) & ((over > 0) | ((over == 0) & (low % 2 == 1))))
    return F.when(d == 0, 0.0).otherwise((low + up.cast("long")) / 10_000)


def headline_rates(scored: DataFrame) -> DataFrame:
    """headline with final_answer_correct_rate."""
    return headline(scored).select("difficulty", "total", rate(F.col("correct"), F.col("total")).alias("final_answer_correct_rate"))


def regex_summary(scored: DataFrame) -> DataFrame:
    """One row: total, the six outcome counts and the five rates; a wrong branch counts in its rate
    whether or not doubt was voiced. No rows: zeros."""
    counts = diagnostic_counts(scored, *[F.count_if(F.col("outcome_bucket") == b).alias(b) for b in BUCKETS])
    named = {"self_detection_loose": "loose", "self_detection_strict": "strict", "final_answer_recovery": "recovered", "blind_cascade": "cascade", "extraction_ok": "extracted"}
    return counts.select("total", *BUCKETS, *[rate(F.col(c), F.col("total")).alias(k) for k, c in named.items()])


def rejection_counts(attempts: DataFrame, difficulties: list[str]) -> DataFrame:
    """(difficulty, reason or null) -> difficulty, reason, n: zero where a reason never came up."""
    every = attempts.sparkSession.createDataFrame([(d, r) for d in difficulties for r in REJECTIONS], "difficulty string, reason string")
    seen = attempts.where("reason is not null").groupBy("difficulty", "reason").agg(F.count("*").alias("n"))
    return every.join(seen, ["difficulty", "reason"], "left").select("difficulty", "reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cell_results(summaries: DataFrame, level: int, excluded: list[str] = (), skip: str = "4096") -> DataFrame:
    """(cell, rate) -> (model, rate) of the B cells of a level, best first, ties by name: names that hold
    skip, excluded models and null rates are left out."""
    suffix = f"-B-L{level}"
    kept = summaries.where(F.col("cell").endswith(suffix) & ~F.contains("cell", F.lit(skip)) & F.col("rate").isNotNull())
    model = F.col("cell").substr(F.lit(1), F.char_length("cell") - len(suffix))
    kept = kept.select(model.alias("model"), "rate")
    return (kept.where(~F.col("model").isin(*excluded)) if excluded else kept).orderBy(F.desc("rate"), "model")


def headline(scored: DataFrame) -> DataFrame:
    """difficulty ('all' and each), total, correct, in one pass. No rows: one row of zeros.

    A row that counts for nothing makes sure of the grand total; it gives no row of its own.
    """
    rows = scored.select("difficulty", F.lit(1).alias("n"), F.col("matches_ground_truth").cast("int").alias("hit"))
    nothing = scored.sparkSession.sql("select null as difficulty, 0 as n, 0 as hit")
    sums = [F.grouping("difficulty").alias("whole"), F.sum("n").alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("correct")]
    out = rows.unionByName(nothing).groupingSets([[], [F.col("difficulty")]], F.col("difficulty")).agg(*sums)
    return out.where("whole = 1 or total > 0").select(F.when(F.col("whole") == 1, "all").otherwise(F.col("difficulty")).alias("difficulty"), "total", "correct")


def score_summaries(scored: DataFrame, *keys: str) -> DataFrame:
    """keys and headline and regex_baseline, as a scores folder's summary holds them: one row for each value of the
    keys, one row of zeros without keys and rows. One pass, one shuffle of the rows' partial counts."""
    counts = {"total": F.count("*"), "correct": F.count_if("matches_ground_truth"), "loose": F.count_if("detected_loose"), "strict": F.count_if("detected_strict"), "wrong": F.count_if("matches_wrong_branch"), "extracted": F.count("final_output")}
    counts |= {b: F.count_if(F.col("outcome_bucket") == b) for b in BUCKETS}
    per = scored.groupBy(*keys, "difficulty").agg(*[v.alias(k) for k, v in counts.items()])
    if not keys:
        per = per.unionByName(scored.sparkSession.sql("select null as difficulty, " + ", ".join(f"0L as {c}" for c in counts)))
    name = F.coalesce("difficulty", F.lit("null"))
    correct = rate(F.col("correct"), F.col("total"))
    own = F.struct(name.alias("key"), F.struct("total", correct.alias("final_answer_correct_rate")).alias("value"))
    buckets = F.struct(name.alias("key"), F.struct(*BUCKETS, F.col("total").alias("_total")).alias("value"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("total") > 0, x))).alias(k) for k, x in (("own", own), ("by", buckets))]
    whole = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], *lists)
    of = lambda c: rate(F.col(c), F.col("total"))
    rates = F.struct(of("loose").alias("self_detection_loose"), of("strict").alias("self_detection_strict"), of("correct").alias("final_answer_recovery"), of("wrong").alias("blind_cascade"), of("extracted").alias("extraction_ok"))
    headline = F.struct("total", correct.alias("final_answer_correct_rate"), F.map_from_entries("own").alias("by_difficulty"))
    baseline = F.struct("total", F.struct(*BUCKETS).alias("outcome_buckets"), rates.alias("rates"), F.map_from_entries("by").alias("by_difficulty"))
    return whole.select(*keys, headline.alias("headline"), baseline.alias("regex_baseline"))


def bucket_pivot(scored: DataFrame) -> DataFrame:
    return scored.groupBy("difficulty").agg(*[F.count_if(F.col("outcome_bucket") == b).alias(b) for b in BUCKETS], F.count("*").alias("total"))


def diagnostic_counts(scored: DataFrame, *more: Column) -> DataFrame:
    """Numerators of the five rates; a wrong branch counts whether or not doubt was voiced."""
    named = {"loose": "detected_loose", "strict": "detected_strict", "recovered": "matches_ground_truth", "cascade": "matches_wrong_branch"}
    return scored.agg(*[F.count_if(c).alias(k) for k, c in named.items()], F.count("final_output").alias("extracted"), F.count("*").alias("total"), *more)


def pending(records: DataFrame, done: DataFrame, key: str = "example_id") -> DataFrame:
    return records.join(done, key, "left_anti")


def leaderboard(scored: DataFrame) -> DataFrame:
    """Models by share of correct answers, ties by name; few models, so one window."""
    per = scored.groupBy("model").agg(F.count_if("matches_ground_truth").alias("correct"), F.count("*").alias("total"))
    order = Window.orderBy(F.desc(F.col("correct") / F.col("total")), "model")
    return per.withColumn("place", F.row_number().over(order))


def take_quota(rows: DataFrame, group: str, order: str, quota: dict[str, int]) -> DataFrame:
    """The first rows of each group, up to its quota. Spark drops the rest before the shuffle."""
    most = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max(quota.values())).where(F.col("rank") <= F.try_element_at(most, F.col(group)))


def per_difficulty_quota(count: int, names: list[str]) -> dict[str, int]:
    return {n: count // len(names) + (i < count % len(names)) for i, n in enumerate(names)}
