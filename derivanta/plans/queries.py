"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells, conversations, responses
from ..functions import expressions as ex
from ..functions.derivations import STEP, compiled, validate
from ..functions.prompts import system_prompt
from ..functions.scoring import BUCKETS, DOUBT, PREDICTION_FIELDS, missing_fields, score
from ..functions.scoring import score_rows as rows_of_scores
from ..operators import algebra, generation, groups, registry, report
from ..operators.once import once_each
from ..sources import dataset
from ..sources.jsonl import SYSTEM
from ..sources.scratch import Scratch
from . import drawn, folders, logs, shapes

#: Predictions made from events: the same SQL runs in both engines.
PREDICTIONS = """
select event_id as example_id, user_id % 13 as model, event_type,
  case event_id % 4 when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' else 'expert' end as difficulty,
  case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as ground_truth_final_output,
  case event_id % 3 when 0 then 'b' when 1 then 'c' else 'a' end as wrong_branch_final_output,
  2 + user_id % 3 as prefill_error_step, 4 + event_id % 11 as chain_length_x, concat('p', cast(user_id % 4 as varchar(9))) as provider,
  case when event_id % 2 = 0 then 'prefill' else 'single_turn' end as mode,
  concat(
    case event_type when 'error' then concat('Wait, step ', cast(2 + user_id % 3 + case when event_id % 7 = 0 then 1 else 0 end as varchar(9)), ' looks wrong.', chr(10)) when 'click' then concat('Hmm, something feels off.', chr(10)) else '' end,
    case event_id % 5 when 0 then concat('Final Output: ', case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end)
      when 1 then concat('Final Output: ', case event_id % 3 when 0 then 'b' when 1 then 'c' else 'a' end, chr(10))
      when 2 then concat('Final Output: **', case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end, '**')
      when 3 then 'Final Output: q.' else 'no marker' end) as raw_continuation_text
from {events}"""

_BANK = "|".join(DOUBT).replace("'", "''")
_SCORED = f"""with p as ({PREDICTIONS.format(events="events")}), r as (
  select *, trim(regexp_extract_all(raw_continuation_text, '(?i)Final\\s*Output\\s*[:\\-]\\s*(.+?)(?:\\n|$)', 1)[-1]) as raw,
    regexp_matches(raw_continuation_text, '(?i){_BANK}') as detected_loose,
    regexp_extract(raw_continuation_text, '(?i)step (\\d+) looks wrong', 1) as said from p), w as (
  select * exclude (raw, said), nullif(rtrim(case when raw like '**%**' then raw[3:-3] else raw end, '.,'), '') as final_output,
    said <> '' and said = cast(prefill_error_step as varchar) as detected_strict from r), scored as (
  select *, coalesce(final_output = ground_truth_final_output, false) as matches_ground_truth,
    coalesce(final_output = wrong_branch_final_output, false) as matches_wrong_branch,
    case when final_output is null then 'extraction_failed' when detected_loose and final_output = ground_truth_final_output then 'detect_recover'
      when detected_loose then 'detect_only' when final_output = ground_truth_final_output then 'silent_recovery'
      when final_output = wrong_branch_final_output then 'blind_wrong_branch' else 'off_rails' end as outcome_bucket from w)
"""
_ALGEBRA = """with s as (select cast(r_regionkey as bigint) as x from region), op as (
  select 'op0' as op, a.x as lhs, b.x as rhs, (2 * a.x + 4 * b.x + 1) % 5 as result from s a, s b union all
  select 'op1', a.x, b.x, (a.x * b.x + 1) % 5 from s a, s b), t as (
  select 't_ok' as name, x as src, (x + 1) % 5 as dst from s union all select 't_bad', x, 2 * x % 5 from s)
"""
_LEAVES = """with e as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 5 as a, l_partkey % 5 as b, l_suppkey % 5 as c from lineitem), v as (
  select *, (a * b + 1) % 5 as v1 from e), g as (
  select *, (((v1 * c + 1) % 5) * v1 + 1) % 5 as value, (v1 + 1 + l_linenumber % 4) % 5 as w1 from v), f as (
  select *, (((w1 * c + 1) % 5) * w1 + 1) % 5 as corrupted from g)
"""
_NAMES = ["easy", "medium", "hard", "expert"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows for work that costs far more than moving them: dealt to all cores by a key if their scan has fewer
    parts than there are cores, as that of a small file has; a large scan stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return spark.sql(PREDICTIONS, events=events)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(predictions(spark, sf_dir))


def _timed(spark, sf_dir):
    """Scored predictions with the time of their event."""
    when = _t(spark, sf_dir, "events").select(F.col("event_id").alias("example_id"), "ts")
    return scored(spark, sf_dir).join(when, "example_id")


def sql_ranked(spark, sf_dir):
    """One SQL text that scores and ranks, over the views and functions of a session."""
    from .. import sql

    own = spark.newSession()
    sql.register(predictions(own, sf_dir))
    one = "select '{0}' as difficulty, model, correct, total, round(share, 6) as share, cast(place as bigint) as place from ranked('{0}')"
    return own.sql(f"{one.format('easy')} union all {one.format('hard')}")


def outcome_buckets(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("difficulty", "outcome_bucket").agg(F.count("*").alias("n"))


def strict_detection(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("event_type", "detected_loose", "detected_strict").agg(F.count("*").alias("n"))


def score_rows(spark, sf_dir):
    return rows_of_scores(predictions(spark, sf_dir))


def resume_pending(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("example_id", "difficulty")
    return report.pending(rows, rows.where("example_id % 7 = 0").select("example_id"))


def preview_slice(spark, sf_dir):
    return predictions(spark, sf_dir).select("example_id", "difficulty").orderBy("example_id").offset(20).limit(10)


def matrix_cells(spark, sf_dir):
    level = F.col("example_id") % 2
    cell = F.concat(F.lit("model-"), F.col("model").cast("string"), F.lit("-B-L"), level.cast("string"))
    return scored(spark, sf_dir).groupBy(cell.alias("cell")).agg(F.count_if("matches_ground_truth").alias("correct"), F.count("*").alias("total"))


def error_type_counts(spark, sf_dir):
    kind = F.nullif(F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "signup", F.col("event_type")), F.lit(""))
    return _t(spark, sf_dir, "events").groupBy(F.coalesce(kind, F.lit("clean")).alias("error_type")).agg(F.count("*").alias("n"))


def preferred_error_step(spark, sf_dir):
    steps = ex.preferred_steps(F.col("chain_length_x"))
    return predictions(spark, sf_dir).groupBy("chain_length_x").agg(F.count("*").alias("n")).select("chain_length_x", "n", F.concat_ws(",", steps.cast("array<string>")).alias("steps"))


def reject_reasons(spark, sf_dir):
    """Reasons in order: too short, too little runway after the error step; zero where none."""
    p = predictions(spark, sf_dir)
    x = F.col("chain_length_x") - 2
    short, late = x < generation.LEAST_STEPS, x - F.col("prefill_error_step") < F.ceil(x / 2)
    return p.groupBy("difficulty").agg(F.count_if(short).alias("short"), F.count_if(~short & late).alias("insufficient_runway"), F.count_if(~short & ~late).alias("accepted"))


def quota_take(spark, sf_dir):
    quota = report.per_difficulty_quota(103, _NAMES)
    return report.take_quota(predictions(spark, sf_dir).select("example_id", "difficulty"), "difficulty", "example_id", quota)


def seed_arithmetic(spark, sf_dir):
    index = F.array_position(F.array(*[F.lit(n) for n in _NAMES]), F.col("difficulty")) - 1
    return predictions(spark, sf_dir).select("example_id", (F.lit(20260413).cast("long") * 1_000_000 + index * 10_000 + F.col("example_id") * 100).alias("seed"))


#: Responses of five shapes made from events; some counts are missing, strings or fractions.
RESPONSES = [
    "event_id",
    "case event_id % 5 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'mistral' when 3 then 'gemini' else 'openrouter' end as provider",
    """case event_id % 5
  when 0 then concat('{"output_text": "', case when event_id % 2 = 0 then '' else event_type end, '", "output": [{"type": "reasoning", "content": []}, {"type": "message", "content": [{"type": "output_text", "text": "a', user_id, '"}, {"type": "refusal", "text": "no"}, {"type": "output_text", "text": "b"}]}], "usage": {"input_tokens": ', user_id, ', "output_tokens": 7, "total_tokens": ', user_id + 7, ', "output_tokens_details": {"reasoning_tokens": ', event_id % 50, '}}}')
  when 1 then concat('{"content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "', event_type, '"}, {"type": "text", "text": "!"}], "usage": {"input_tokens": ', user_id, case when user_id % 2 = 0 then concat(', "output_tokens": ', event_id % 90) else '' end, '}}')
  when 2 then concat('{"choices": [{"message": {"content": ', case when user_id % 2 = 0 then '"[plain]"' else concat('[{"type": "text", "text": "', event_type, '"}, {"type": "image", "text": "x"}, {"type": "text", "text": "?"}]') end, '}}], "usage": {"prompt_tokens": ', user_id, ', "completion_tokens": "12", "total_tokens": 1.5}}')
  when 3 then concat('{"candidates": [{"content": {"parts": [{"text": "', event_type, '"}, {"data": 1}, {"text": "."}]}}], "usageMetadata": {"promptTokenCount": ', user_id, ', "thoughtsTokenCount": ', event_id % 40, '}}')
  else case event_id % 3 when 0 then concat('{"choices": [], "usage": {"prompt_tokens": ', user_id, ', "completion_tokens": 3, "completion_tokens_details": {"reasoning_tokens": ', event_id % 30, '}}}')
    when 1 then concat('{"usage": {"reasoning_tokens": ', event_id % 20, ', "total_tokens": ', event_id, ', "completion_tokens_details": {"reasoning_tokens": 1}}}') else '{"usage": []}' end end as response""",
]


def usage_shapes(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", *RESPONSES)
    return rows.withColumn("u", responses.usage(F.col("response"), F.col("provider"))).select("event_id", "provider", F.col("u").isNotNull().alias("has_usage"), "u.*")


def response_texts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", *RESPONSES)
    return rows.select("event_id", responses.text(F.col("response"), F.col("provider")).alias("answer"))


#: Streams of event lines: texts, blank and broken lines, a reason to finish in some.
STREAMS = """case event_id % 6 when 0 then ': keep-alive' when 1 then 'data:' when 2 then 'data: {"candidates": [{' else
  concat('data: {"candidates": [{"content": {"parts": [{"text": "', event_type, event_id, '"}, {"text": ";"}]}', case when event_id % 4 = 0 then concat(', "finishReason": "STOP', event_id % 3, '"') else '' end, '}]',
    case when event_id % 5 = 0 then concat(', "responseId": "r', event_id, '"') else '' end, '}') end as line"""


def event_streams(spark, sf_dir):
    folded = responses.fold_events(_t(spark, sf_dir, "events").selectExpr("user_id", "event_id", STREAMS), "user_id", "event_id", "line")
    return folded.select("user_id", "text", "finish_reason", "response_id", "error")


def absent_fields(spark, sf_dir):
    """What a JSON line made of a prediction lacks of the fields that scoring needs."""
    p = predictions(spark, sf_dir).withColumn("example_id", F.when(F.col("example_id") % 3 > 0, F.col("example_id"))).withColumn("mode", F.when(F.col("model") % 2 > 0, F.col("mode")))
    line = F.to_json(F.struct("example_id", "difficulty", "chain_length_x", "mode"))
    return p.groupBy(F.array_join(missing_fields(line, PREDICTION_FIELDS), ",").alias("missing")).agg(F.count("*").alias("n"))


def rejection_counts(spark, sf_dir):
    p, x = predictions(spark, sf_dir), F.col("chain_length_x") - 2
    kinds = ["no_eligible_in_chain", "no_eligible_in_window", "cascade_convergent", "other_injector_error"]
    found = F.get(F.array(*[F.lit(k) for k in kinds]), F.col("model").cast("int") - 3)
    reason = F.when(x < generation.LEAST_STEPS, "chain_too_short").when(x - F.col("prefill_error_step") < F.ceil(x / 2), "insufficient_runway").otherwise(found)
    return report.rejection_counts(p.select("difficulty", reason.alias("reason")), _NAMES)


def cell_results(spark, sf_dir):
    """Cells of models by level, with their rates; one model's name holds 4096, one is left out."""
    cell = F.concat(F.when(F.col("model") == 4, "m-4096").otherwise(F.concat(F.lit("m"), F.col("model").cast("string"))), F.lit("-"), cells.cell(F.lit("prefill"), F.col("example_id") % 2))
    per = scored(spark, sf_dir).groupBy(cell.alias("cell")).agg(report.rate(F.count_if("matches_ground_truth"), F.count("*")).alias("rate"))
    return report.cell_results(per, 0, ["m7"])


def output_dirs(spark, sf_dir):
    p = predictions(spark, sf_dir).select(F.concat(F.lit("org/m"), F.col("model").cast("string")).alias("model"), "mode", (F.col("example_id") % 2).alias("level"), F.when(F.col("model") % 3 == 0, "high").alias("effort"))
    return p.groupBy(cells.output_dir(F.col("model"), F.col("mode"), F.col("effort"), F.col("level")).alias("dir")).agg(F.count("*").alias("n"))


def _models(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("provider"), F.lower("n_name").alias("api_model"), F.lit("low").alias("effort"), F.when(F.col("n_regionkey") < 2, F.array(F.lit("low"), F.lit("high"), F.lit("off"))).otherwise(F.array(F.lit("high"))).alias("efforts"))


def model_order(spark, sf_dir):
    return registry.in_order(_models(spark, sf_dir), ["JAPAN", "CHINA", "PERU"], ["p1", "p2"]).select("key", "provider", "place")


def model_lookup(spark, sf_dir):
    """Customers' nations as models, with an effort that all of them list."""
    wanted = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("key")), "c_nationkey")
    return registry.lookup(wanted, registry.with_effort(_models(spark, sf_dir), "high")).groupBy("api_model", "effort").agg(F.count("*").alias("n"))


def dataset_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "click", F.col("event_type"))
    return dataset.counts(predictions(spark, sf_dir).withColumn("error_type", kind).withColumn("split", F.when(F.col("model") < 9, "test").otherwise("train")))


def valid_transformations(spark, sf_dir):
    """Permutations that distribute over each operator, with the number of times that give each symbol back."""
    s, ops, _ = _system(spark, sf_dir)
    found = algebra.valid_transformations(s, ops).withColumn("order", algebra.permutation_order(F.col("mapping").cast("array<int>")).cast("long"))
    return found.withColumn("mapping", F.array_join("mapping", ","))


def _system(spark, sf_dir):
    s = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("x"))
    pairs = s.select(F.col("x").alias("lhs"), F.expr("explode(sequence(0L, 4L))").alias("rhs"))
    lhs, rhs = F.col("lhs"), F.col("rhs")
    ops = pairs.select(F.explode(F.array(F.struct(F.lit("op0").alias("op"), ((2 * lhs + 4 * rhs + 1) % 5).alias("result")), F.struct(F.lit("op1").alias("op"), ((lhs * rhs + 1) % 5).alias("result")))).alias("o"), "lhs", "rhs").select("o.op", "lhs", "rhs", "o.result")
    x = F.col("x")
    moves = s.select(F.explode(F.array(F.struct(F.lit("t_ok").alias("name"), ((x + 1) % 5).alias("dst")), F.struct(F.lit("t_bad").alias("name"), (2 * x % 5).alias("dst")))).alias("m"), x.alias("src")).select("m.name", "src", "m.dst")
    return s.withColumnRenamed("x", "symbol"), ops, moves


def op_table_complete(spark, sf_dir):
    s, ops, _ = _system(spark, sf_dir)
    broken = ops.where("not (op = 'op1' and lhs = rhs)")
    return algebra.missing_entries(s, broken)


def distribution_counterexamples(spark, sf_dir):
    _, ops, moves = _system(spark, sf_dir)
    return algebra.distribution_counterexamples(ops, moves).groupBy("name", "op").agg(F.count("*").alias("n"))


def derived_table(spark, sf_dir):
    _, ops, _ = _system(spark, sf_dir)
    return algebra.derived_table(ops, "dop0", "compose_left", "op1").unionByName(algebra.derived_table(ops, "dop1", "double_left", "op0"))


def _algebra(spark, sf_dir):
    """The algebra of _system with dop0 = compose_left(op1), as one value: a scalar subquery over its tables."""
    _, ops, _ = _system(spark, sf_dir)
    entries = ops.groupBy("op").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "lhs", "rhs"), F.col("result").cast("string")))).alias("table"))
    op = F.struct(F.col("op").alias("name"), F.when(F.col("op") == "op0", "*").otherwise("#").alias("symbol_id"), "table")
    by_name = lambda x, y: F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)
    base = entries.agg(F.array_sort(F.collect_list(op), by_name).alias("base_operations"))
    made = F.array(F.struct(F.lit("dop0").alias("name"), F.lit("&").alias("symbol_id"), F.lit("compose_left").alias("template_id"), F.array(F.lit("op1")).alias("base_ops"), F.lit(None).cast("string").alias("transform_name")))
    none = F.lit(None).cast("array<struct<name:string,mapping:map<string,string>,distributes_over:array<string>>>")
    system = F.struct(F.array(*[F.lit(str(i)) for i in range(5)]).alias("symbols"), "base_operations", made.alias("derived_operations"), none.alias("transformations"))
    return base.select(ex.compile_system(system).alias("a")).scalar()


def _expressions(spark, sf_dir):
    """(a op1 b) dop0 c in postfix order, with its leaves and its first value."""
    s = lambda c: (F.col(c) % 5).cast("int")
    rows = _spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    e = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s("l_orderkey").alias("a"), s("l_partkey").alias("b"), s("l_suppkey").alias("c"))
    # Functions over arrays take no subquery, but a column that holds its value.
    return e.withColumn("rpn", F.array("a", "b", F.lit(-2), "c", F.lit(-3))).withColumn("system", _algebra(spark, sf_dir)), F.col("system")


def eval_expression(spark, sf_dir):
    e, a = _expressions(spark, sf_dir)
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ex.evaluate(F.col("rpn"), a).cast("long").alias("value"))


def corrupt_outcomes(spark, sf_dir):
    """Corruptions of the first step; those that end at the true value are convergent and rejected."""
    e, a = _expressions(spark, sf_dir)
    v1 = ex.evaluate(F.array("a", "b", F.lit(-2)), a)
    e = e.select("rpn", "c", "system", ((v1 + 1 + F.col("l_linenumber") % 4) % 5).cast("int").alias("w1"))
    e = e.select(ex.evaluate(F.col("rpn"), a).cast("long").alias("value"), ex.evaluate(F.array("w1", "c", F.lit(-3)), a).cast("long").alias("corrupted"))
    return e.groupBy("value", "corrupted").agg(F.count("*").alias("n")).select("value", "corrupted", (F.col("value") == F.col("corrupted")).alias("convergent"), "n")


def chain_length(spark, sf_dir):
    return shapes.chain_length(*_shaped(spark, sf_dir))


def subtree_paths(spark, sf_dir):
    return shapes.subtree_paths(*_shaped(spark, sf_dir))


def _shaped(spark, sf_dir):
    """Expressions of many shapes, and their system."""
    return shapes.shaped(spark, sf_dir), shapes.one_system(_nation_systems(spark, sf_dir))


def _reduced(spark, sf_dir, made):
    """The keys of lineitem with rpn and what made(rows of rpn, system and steps) gives besides, worked out once for each
    distinct expression."""
    e, _ = _expressions(spark, sf_dir)

    def work(distinct):
        steps = distinct.withColumn("system", _algebra(spark, sf_dir)).withColumn("steps", ex.reduce_steps(F.col("rpn"), F.col("system")))
        return made(steps, F.col("system"))

    return once_each(e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rpn"), ["rpn"], work, Scratch(spark, "reduced"))


def reduction_steps(spark, sf_dir):
    def rows(e, a):
        kind = lambda s: F.when(ex.rule_type(s["rule"], a) == "derived_op", "derived").otherwise("base")
        row = lambda s: F.struct(kind(s).alias("rule_type"), s["result"].cast("long").alias("result"), F.array_join(ex.names(s["after"], a), " ").alias("after"))
        return e.select("rpn", F.transform("steps", row).alias("rows"))

    out = _reduced(spark, sf_dir, rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode("rows"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("pos") + 1).cast("long").alias("step_number"), "col.*")


def clean_derivations(spark, sf_dir):
    text = lambda e, a: e.select("rpn", ex.clean_derivation(F.col("rpn"), F.col("steps"), a).alias("derivation"))
    return _reduced(spark, sf_dir, text).drop("rpn")


def injected_prefills(spark, sf_dir):
    """The first step's result replaced by the first of the next symbols that changes the final one; rows
    without such a symbol have nulls."""

    def injected(e, a):
        first = F.get("steps", F.lit(0))["result"]
        wrong = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: ((first + j) % 5).cast("int"))
        e = e.withColumn("wrong", wrong).withColumn("mutated", ex.inject(F.col("steps"), a, F.lit(1), F.col("wrong")))
        last = F.get(F.try_element_at("mutated", F.lit(-1))["after"], F.lit(0))
        text = F.when(F.col("mutated").isNotNull(), ex.prefill(F.col("rpn"), F.col("mutated"), a, F.lit(2)))
        return e.select("rpn", F.get("mutated", F.lit(0))["result"].cast("long").alias("injected"), last.cast("long").alias("wrong_final"), F.size(F.coalesce("mutated", F.array())).cast("long").alias("steps"), text.alias("prefill"))

    return _reduced(spark, sf_dir, injected).drop("rpn")


def eligible_error_steps(spark, sf_dir):
    return shapes.eligible_error_steps(*_shaped(spark, sf_dir))


def _system_json() -> str:
    """The algebra of _ALGEBRA's op1 with a compose_left operator, as a dataset row holds it."""
    table = {f"{x},{y}": str((x * y + 1) % 5) for x in range(5) for y in range(5)}
    return json.dumps({
        "name": "five", "seed": 1, "symbols": list("01234"), "base_operations": [{"name": "op1", "symbol_id": "#", "table": table}],
        "derived_operations": [{"name": "dop0", "symbol_id": "&", "template_id": "compose_left", "base_ops": ["op1"], "transform_name": None}], "transformations": [],
    })


#: Derivations of ((a # b) & c): clean, from a wrong first step on, without the third line, with a broken line, without the last.
STEP_TEXTS = _LEAVES + """, h as (
  select *, case when l_linenumber % 5 = 1 then w1 else v1 end as v, (v1 * c + 1) % 5 as u1, (w1 * c + 1) % 5 as w2 from f), k as (
  select *, case when l_linenumber % 5 = 1 then w2 else u1 end as u, case when l_linenumber % 5 = 1 then corrupted else value end as z from h)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(value as varchar(9)) as ground_truth_final_output, concat(
  'Step 1: ((', a, ' # ', b, ') & ', c, ') = (', v, ' & ', c, ')    [by # table]', chr(10), 'Let me expand.', chr(10),
  case when l_linenumber % 5 = 3 then 'Step 2: (# = 1' else concat('Step 2: (', v, ' & ', c, ') = ((', v, ' # ', c, ') # ', v, ')    [by definition of &]') end, chr(10),
  case when l_linenumber % 5 = 2 then '' else concat('Step 3: ((', v, ' # ', c, ') # ', v, ') = (', u, ' # ', v, ')', chr(10)) end,
  case when l_linenumber % 5 = 4 then '' else concat('Step 4: (', u, ' # ', v, ') = ', z, chr(10)) end, 'Final Output: ', z) as raw_continuation_text from k"""


def step_verdicts(spark, sf_dir):
    ready = spark.range(1).select(compiled(F.from_json(F.lit(_system_json()), SYSTEM))).scalar()
    judged = once_each(_step_texts(spark, sf_dir), ["raw_continuation_text", "ground_truth_final_output"], lambda texts: validate(texts, None, ready=ready), Scratch(spark, "verdicts"))
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "verdict.*")


def _step_texts(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spark.sql(STEP_TEXTS.replace("from lineitem", "from {lineitem}"), lineitem=_spread(rows, "l_orderkey"))


def parse_step_lines(spark, sf_dir):
    """The step lines of each derivation and their parts; other lines drop out."""
    lines = _step_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.split("raw_continuation_text", "\n")).alias("line")).where(F.col("line").rlike(STEP))
    part = lambda k: F.regexp_extract("line", STEP, k)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part(1).cast("long").alias("step_number"), part(2).alias("before"), part(3).alias("after"))


def final_output_rows(spark, sf_dir):
    return scored(spark, sf_dir).select("example_id", "final_output")


def system_json_explode(spark, sf_dir):
    """Table entries of the JSON text of a system, with the region whose key is the left operand."""
    rows = _t(spark, sf_dir, "region").withColumn("s", F.from_json(F.lit(_system_json()), SYSTEM))
    ops = rows.select("r_regionkey", "r_name", F.explode("s.base_operations").alias("o")).select("r_regionkey", "r_name", F.col("o.name").alias("op"), F.explode("o.table"))
    at = F.split("key", ",")
    return ops.select("r_name", "op", at[0].cast("long").alias("lhs"), at[1].cast("long").alias("rhs"), F.col("value").cast("long").alias("result")).where("lhs = r_regionkey")


def _nation_groups(spark, sf_dir):
    """A cyclic group of the nations of each region, and one of all; labels follow the names."""
    nation = _t(spark, sf_dir, "nation").select(F.explode(F.array(F.lit("all"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).alias("op"), F.col("n_name").alias("symbol"))
    return groups.group_table(nation.withColumn("label", F.row_number().over(Window.partitionBy("op").orderBy("symbol")) - 1))


def group_table(spark, sf_dir):
    return _nation_groups(spark, sf_dir)


def group_automorphisms(spark, sf_dir):
    return groups.automorphisms(_nation_groups(spark, sf_dir)).withColumn("k", F.col("k").cast("long"))


def _nation_systems(spark, sf_dir):
    """One system for each nation: x # y = (key * x + y + 1) mod 5, a derived operator, a transform."""
    n = F.col("n_nationkey").cast("long")
    five = F.array(*[F.lit(str(i)) for i in range(5)])
    cell = lambda x, y: F.pmod(n * x.cast("long") + y.cast("long") + 1, F.lit(5)).cast("string")
    table = F.map_from_entries(F.flatten(F.transform(five, lambda x: F.transform(five, lambda y: F.struct(F.concat_ws(",", x, y), cell(x, y))))))
    moves = F.map_from_entries(F.transform(five, lambda x: F.struct(x, F.pmod(x.cast("long") + n, F.lit(5)).cast("string"))))
    template = F.element_at(F.array(*[F.lit(t) for t in ("compose_left", "inv_compose", "double_left")]), (n % 3 + 1).cast("int"))
    system = F.struct(
        F.col("n_name").alias("name"),
        n.alias("seed"),
        five.alias("symbols"),
        F.array(F.struct(F.lit("op0").alias("name"), F.lit("#").alias("symbol_id"), table.alias("table"))).alias("base_operations"),
        F.array(F.struct(F.lit("dop0").alias("name"), F.lit("&").alias("symbol_id"), template.alias("template_id"), F.array(F.lit("op0")).alias("base_ops"), F.lit("t").alias("transform_name"))).alias("derived_operations"),
        F.array(F.struct(F.lit("t").alias("name"), moves.alias("mapping"), F.array(F.lit("op0")).alias("distributes_over"))).alias("transformations"),
    )
    return _t(spark, sf_dir, "nation").select("n_nationkey", system.alias("s"))


def system_prompts(spark, sf_dir):
    return _nation_systems(spark, sf_dir).select("n_nationkey", system_prompt(F.col("s")).alias("prompt"))


def _nation_chains(spark, sf_dir):
    """t(((1 # 2) & 3)) in each nation's system, with its steps."""
    rows = _nation_systems(spark, sf_dir).withColumn("a", ex.compile_system(F.col("s")))
    rpn = ex.tokens(F.array(*[F.lit(t) for t in ("1", "2", "op0", "3", "dop0", "t")]), F.col("a"))
    return rows.withColumn("rpn", rpn).withColumn("steps", ex.reduce_steps(F.col("rpn"), F.col("a")))


def transform_chains(spark, sf_dir):
    """Names and steps, with transforms and each template of a derived operator."""
    rows, a = _nation_chains(spark, sf_dir), F.col("a")
    rule = F.array_join(F.transform("steps", lambda s: F.concat(ex.rule_type(s["rule"], a), F.lit(":"), F.coalesce(s["result"].cast("string"), F.lit("-")))), " ")
    return rows.select("n_nationkey", ex.render(F.col("rpn"), a, signs=False).alias("named"), rule.alias("rules"), ex.clean_derivation(F.col("rpn"), F.col("steps"), a).alias("derivation"), ex.evaluate(F.col("rpn"), a).cast("long").alias("value"))


def single_turn_prompt(spark, sf_dir):
    rows, a = _nation_chains(spark, sf_dir), F.col("a")
    user = conversations.turn_1_user(F.col("s"), ex.render(F.col("rpn"), a))
    prefill = ex.prefill(F.col("rpn"), F.col("steps"), a, F.lit(2))
    second = conversations.turn_2(F.col("n_nationkey") % 2)
    sent = conversations.messages(F.when(F.col("n_nationkey") % 3 == 0, "single_turn").otherwise("prefill"), F.when(F.col("n_nationkey") % 2 == 0, "gemini").otherwise("other"), user, prefill, second)
    return rows.select("n_nationkey", F.array_join(F.transform(sent, lambda m: m["role"]), ",").alias("roles"), F.array_join(F.transform(sent, lambda m: m["content"]), "\n--\n").alias("content"))


def _records_of_chains(spark, sf_dir):
    """Each nation's conversation as a record of a dataset."""
    rows, a = _nation_chains(spark, sf_dir), F.col("a")
    return rows.select("n_nationkey", conversations.turn_1_user(F.col("s"), ex.render(F.col("rpn"), a)).alias("turn_1_user"), ex.prefill(F.col("rpn"), F.col("steps"), a, F.lit(2)).alias("turn_1_assistant_prefill"))


def continuity_breaks(spark, sf_dir):
    """Turns whose role is that of the turn before, a system turn counting as a user's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return rows.withColumn("before", F.lag("role").over(w)).where("before = role").groupBy("conv_id").agg(F.min("turn").alias("first_break"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (outcome_buckets, strict_detection, score_rows, resume_pending, preview_slice, matrix_cells, error_type_counts, preferred_error_step, reject_reasons, quota_take, seed_arithmetic, usage_shapes, response_texts, event_streams, absent_fields, rejection_counts, cell_results, output_dirs, model_order, model_lookup, dataset_counts, valid_transformations, transform_chains, op_table_complete, distribution_counterexamples, derived_table, eval_expression, corrupt_outcomes, chain_length, subtree_paths, reduction_steps, clean_derivations, injected_prefills, eligible_error_steps, step_verdicts, parse_step_lines, final_output_rows, system_json_explode, group_table, group_automorphisms, system_prompts, single_turn_prompt, continuity_breaks)} | {
    "headline": lambda s, d: report.headline(scored(s, d)),
    "bucket_pivot": lambda s, d: report.bucket_pivot(scored(s, d)),
    "diagnostic_rates": lambda s, d: report.diagnostic_counts(scored(s, d)),
    "leaderboard": lambda s, d: report.leaderboard(scored(s, d)),
    "headline_rates": lambda s, d: report.headline_rates(scored(s, d)),
    "regex_summary": lambda s, d: report.regex_summary(scored(s, d)),
    "sql_ranked": sql_ranked,
    "effort_rules": lambda s, d: logs.effort_rules(_t(s, d, "customer")),
    "registry_json": lambda s, d: logs.registry_json(_t(s, d, "customer")),
    "model_choices": lambda s, d: logs.model_choices(_models(s, d)),
    "latency_figures": lambda s, d: logs.latency_figures(predictions(s, d)),
    "score_windows": lambda s, d: logs.score_windows(_timed(s, d)),
    "score_sessions": lambda s, d: logs.score_sessions(_timed(s, d)),
    "attempt_log": lambda s, d: logs.attempt_log(_t(s, d, "events").select("event_id", "user_id", "event_type")),
    "absent_record_fields": lambda s, d: logs.absent_record_fields(predictions(s, d)),
    "dataset_folder": lambda s, d: logs.dataset_folder(predictions(s, d)),
    "streamed_scores": lambda s, d: logs.streamed_scores(predictions(s, d)),
    "drawn_systems": lambda s, d: drawn.drawn_systems(drawn.bases(s, d)),
    "undistributed": lambda s, d: drawn.undistributed(drawn.bases(s, d)),
    "generated_records": lambda s, d: drawn.generated_records(drawn.bases(s, d)),
    "eval_folder": lambda s, d: folders.eval_folder(scored(s, d)),
    "run_summary": lambda s, d: folders.run_summary(predictions(s, d)),
    "run_predictions": lambda s, d: folders.run_predictions(predictions(s, d)),
    "scored_file": lambda s, d: folders.scored_file(predictions(s, d)),
    "file_order": lambda s, d: folders.file_order(predictions(s, d)),
    "numbered_lines": lambda s, d: folders.numbered_lines(_t(s, d, "lineitem")),
    "previews": lambda s, d: folders.previews(_records_of_chains(s, d)),
}

_P = f"with p as ({PREDICTIONS.format(events='events')}) "
_GROUPS = """with m as (select 'all' as op, n_name as symbol from nation union all select 'r' || n_regionkey, n_name from nation), l as (
  select *, row_number() over (partition by op order by symbol) - 1 as label, count(*) over (partition by op) as n from m)
"""
_IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: t(((1 # 2) & 3)) with x # y = (k x + y + 1) mod 5, t(x) = (x + k) mod 5 and & by k mod 3.
_NATION_CHAINS = """with n as (select n_nationkey, n_name, n_nationkey as k, (n_nationkey + 3) % 5 as v from nation), m as (
  select *, case k % 3 when 0 then (k * v + 4) % 5 when 1 then (k * v + 4) % 5 else (k * v + v + 1) % 5 end as i from n), o as (
  select *, case k % 3 when 0 then (k * i + v + 1) % 5 when 1 then (i + k) % 5 else (k * i + 4) % 5 end as j from m), c as (
  select *, (j + k) % 5 as value, 'base_op:' || v || ' derived_op:- base_op:' || i || case k % 3 when 1 then ' transform:' else ' base_op:' end || j || ' transform:' || (j + k) % 5 as rules,
    'Start: t(((1 # 2) & 3))' || chr(10) || chr(10) || 'Step 1: t(((1 # 2) & 3)) = t((' || v || ' & 3))    [by # table]' || chr(10)
    || 'Step 2: t((' || v || ' & 3)) = t(' || case k % 3 when 0 then '((' || v || ' # 3) # ' || v || ')' when 1 then 't((' || v || ' # 3))' else '((' || v || ' # ' || v || ') # 3)' end || ')    [by definition of &]' || chr(10)
    || 'Step 3: t(' || case k % 3 when 0 then '((' || v || ' # 3) # ' || v || ')' when 1 then 't((' || v || ' # 3))' else '((' || v || ' # ' || v || ') # 3)' end || ') = t(' || case k % 3 when 0 then '(' || i || ' # ' || v || ')' when 1 then 't(' || i || ')' else '(' || i || ' # 3)' end || ')    [by # table]' || chr(10)
    || 'Step 4: t(' || case k % 3 when 0 then '(' || i || ' # ' || v || ')' when 1 then 't(' || i || ')' else '(' || i || ' # 3)' end || ') = t(' || j || case k % 3 when 1 then ')    [by t]' else ')    [by # table]' end || chr(10)
    || 'Step 5: t(' || j || ') = ' || (j + k) % 5 || '    [by t]' || chr(10) || chr(10) || 'Final Output: ' || (j + k) % 5 as derivation from o)
"""
ORACLES = {
    "outcome_buckets": _SCORED + "select difficulty, outcome_bucket, count(*) as n from scored group by all",
    "strict_detection": _SCORED + "select event_type, detected_loose, detected_strict, count(*) as n from scored group by all",
    "score_rows": _SCORED + "select example_id, difficulty, chain_length_x, prefill_error_step, ground_truth_final_output, wrong_branch_final_output, final_output, detected_loose, detected_strict, outcome_bucket, matches_ground_truth, matches_wrong_branch, model, provider, mode, raw_continuation_text from scored",
    "headline": _SCORED + "select coalesce(difficulty, 'all') as difficulty, count(*) as total, count(*) filter (matches_ground_truth) as correct from scored group by grouping sets ((), (difficulty))",
    "bucket_pivot": _SCORED + "select difficulty, count(*) filter (outcome_bucket = 'detect_recover') as detect_recover, count(*) filter (outcome_bucket = 'silent_recovery') as silent_recovery, count(*) filter (outcome_bucket = 'detect_only') as detect_only, count(*) filter (outcome_bucket = 'blind_wrong_branch') as blind_wrong_branch, count(*) filter (outcome_bucket = 'off_rails') as off_rails, count(*) filter (outcome_bucket = 'extraction_failed') as extraction_failed, count(*) as total from scored group by difficulty",
    "diagnostic_rates": _SCORED + "select count(*) filter (detected_loose) as loose, count(*) filter (detected_strict) as strict, count(*) filter (matches_ground_truth) as recovered, count(*) filter (matches_wrong_branch) as cascade, count(final_output) as extracted, count(*) as total from scored",
    "leaderboard": _SCORED + "select model, count(*) filter (matches_ground_truth) as correct, count(*) as total, row_number() over (order by count(*) filter (matches_ground_truth) / count(*) desc, model) as place from scored group by model",
    "resume_pending": _P + "select example_id, difficulty from p where not exists (select 1 from p q where q.example_id = p.example_id and q.example_id % 7 = 0)",
    "preview_slice": _P + "select example_id, difficulty from p order by example_id limit 10 offset 20",
    "matrix_cells": _SCORED + "select 'model-' || model || '-B-L' || (example_id % 2) as cell, count(*) filter (matches_ground_truth) as correct, count(*) as total from scored group by 1",
    "error_type_counts": "select case when event_type in ('view', 'signup') or event_type is null then 'clean' else event_type end as error_type, count(*) as n from events group by 1",
    "preferred_error_step": _P + "select chain_length_x, count(*) as n, concat_ws(',', chain_length_x // 2, case when chain_length_x // 2 + 1 < chain_length_x then chain_length_x // 2 + 1 end, case when chain_length_x // 2 > 1 then chain_length_x // 2 - 1 end) as steps from p group by chain_length_x",
    "reject_reasons": _P + "select difficulty, count(*) filter (x < 4) as short, count(*) filter (x >= 4 and x - prefill_error_step < (x + 1) // 2) as insufficient_runway, count(*) filter (x >= 4 and x - prefill_error_step >= (x + 1) // 2) as accepted from (select *, chain_length_x - 2 as x from p) group by 1",
    "quota_take": _P + "select * from (select example_id, difficulty, row_number() over (partition by difficulty order by example_id) as rank from p) where rank <= case when difficulty = 'expert' then 25 else 26 end",
    "seed_arithmetic": _P + "select example_id, 20260413000000 + case difficulty when 'easy' then 0 when 'medium' then 10000 when 'hard' then 20000 else 30000 end + example_id * 100 as seed from p",
    "headline_rates": _SCORED + "select coalesce(difficulty, 'all') as difficulty, count(*) as total, round(count(*) filter (matches_ground_truth) / count(*), 4) as final_answer_correct_rate from scored group by grouping sets ((), (difficulty))",
    "regex_summary": _SCORED
    + "select count(*) as total, " + ", ".join(f"count(*) filter (outcome_bucket = '{b}') as {b}" for b in BUCKETS)
    + ", round(count(*) filter (detected_loose) / count(*), 4) as self_detection_loose, round(count(*) filter (detected_strict) / count(*), 4) as self_detection_strict, round(count(*) filter (matches_ground_truth) / count(*), 4) as final_answer_recovery, round(count(*) filter (matches_wrong_branch) / count(*), 4) as blind_cascade, round(count(final_output) / count(*), 4) as extraction_ok from scored",
    "usage_shapes": """select event_id, case event_id % 5 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'mistral' when 3 then 'gemini' else 'openrouter' end as provider,
      not (event_id % 5 = 4 and event_id % 3 = 2) as has_usage,
      case when event_id % 5 < 4 or event_id % 3 = 0 then user_id end as input_tokens,
      case event_id % 5 when 0 then 7 when 1 then case when user_id % 2 = 0 then event_id % 90 end when 4 then case when event_id % 3 = 0 then 3 end end as output_tokens,
      case event_id % 5 when 0 then event_id % 50 when 3 then event_id % 40 when 4 then case event_id % 3 when 0 then event_id % 30 when 1 then event_id % 20 end end as reasoning_tokens,
      case event_id % 5 when 0 then user_id + 7 when 1 then case when user_id % 2 = 0 then user_id + event_id % 90 end when 4 then case when event_id % 3 = 1 then event_id end end as total_tokens from events""",
    "response_texts": """select event_id, case event_id % 5 when 0 then case when event_id % 2 = 0 then 'a' || user_id || 'b' else event_type end when 1 then event_type || '!'
      when 2 then case when user_id % 2 = 0 then '[plain]' else event_type || '?' end when 3 then event_type || '.' else '' end as answer from events""",
    "event_streams": """with e as (select *, event_id % 6 > 2 as good from events) select user_id, coalesce(string_agg(event_type || event_id || ';', '' order by event_id) filter (good), '') as text,
      max_by('STOP' || event_id % 3, event_id) filter (good and event_id % 4 = 0) as finish_reason, max_by('r' || event_id, event_id) filter (good and event_id % 5 = 0) as response_id,
      case when count(*) filter (good) = 0 then 'no events' when count(*) filter (good and event_id % 4 = 0) = 0 then 'no finish reason' end as error from e group by user_id""",
    "absent_fields": """select case when event_id % 3 = 0 then 'example_id,' else '' end || 'prefill_error_step,ground_truth_final_output,wrong_branch_final_output,raw_continuation_text,model,provider'
      || case when user_id % 13 % 2 = 0 then ',mode' else '' end as missing, count(*) as n from events group by 1""",
    "rejection_counts": _P + """, r as (select difficulty, case when x < 4 then 'chain_too_short' when x - prefill_error_step < (x + 1) // 2 then 'insufficient_runway'
      when model between 3 and 6 then ['no_eligible_in_chain', 'no_eligible_in_window', 'cascade_convergent', 'other_injector_error'][model - 2] end as reason from (select *, chain_length_x - 2 as x from p)),
      d as (select unnest(['easy', 'medium', 'hard', 'expert']) as difficulty), w as (select unnest(['chain_too_short', 'insufficient_runway', 'no_eligible_in_chain', 'no_eligible_in_window', 'cascade_convergent', 'other_injector_error']) as reason)
      select d.difficulty, w.reason, count(r.reason) as n from d cross join w left join r on r.difficulty = d.difficulty and r.reason = w.reason group by all""",
    "cell_results": _SCORED + "select 'm' || model as model, round(count(*) filter (matches_ground_truth) / count(*), 4) as rate from scored where example_id % 2 = 0 and model not in (4, 7) group by 1",
    "output_dirs": _P + "select 'artifacts/evals/org-m' || model || case when model % 3 = 0 then '-reasoning-high' else '' end || case when mode = 'prefill' then '-B-L' else '-C-L' end || (example_id % 2) as dir, count(*) as n from p group by 1",
    "model_order": "select n_name as key, 'p' || n_regionkey as provider, case n_name when 'JAPAN' then 0 when 'CHINA' then 1 when 'PERU' then 2 else 3 end::bigint as place from nation where n_regionkey in (1, 2)",
    "model_lookup": "select lower(n_name) as api_model, 'high' as effort, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1",
    "dataset_counts": _P + """, k as (select case when model < 9 then 'test' else 'train' end as split, difficulty, case when event_type in ('error', 'click') then 'clean' else event_type end as kind from p)
      select 'split' as kind, split as name, count(*) as n from k group by 2 union all select 'split', 'validation', 0 union all select 'difficulty', difficulty, count(*) from k group by 2 union all select 'error_type', k.kind, count(*) from k group by 2""",
    "valid_transformations": _ALGEBRA + """, q as (select [a.x, b.x, c.x, d.x, e.x] as m from s a, s b, s c, s d, s e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5 and not (a.x = 0 and b.x = 1 and c.x = 2 and d.x = 3)),
      g as (select q.m, o.op from q, op o join op t on t.op = o.op and t.lhs = q.m[o.lhs + 1] and t.rhs = q.m[o.rhs + 1] group by q.m, o.op having bool_and(q.m[o.result + 1] = t.result)),
      w as (select op, m, list_transform(m, lambda x: m[x + 1]) as m2 from g), v as (select *, list_transform(m2, lambda x: m[x + 1]) as m3, list_transform(m2, lambda x: m2[x + 1]) as m4 from w), u as (select *, list_transform(m4, lambda x: m[x + 1]) as m5 from v)
      select op, array_to_string(m, ',') as mapping, case when m2 = [0, 1, 2, 3, 4] then 2 when m3 = [0, 1, 2, 3, 4] then 3 when m4 = [0, 1, 2, 3, 4] then 4 when m5 = [0, 1, 2, 3, 4] then 5 else 6 end::bigint as "order" from u""",
    "transform_chains": _NATION_CHAINS + "select n_nationkey, 't(((1 op0 2) dop0 3))' as named, rules, derivation, value from c",
    "single_turn_prompt": _NATION_CHAINS
    + f""", t as (select c.*, 'Below is a formal system called "' || n_name || '".' || chr(10) || chr(10) || '=== RULES ===' || chr(10) || y.prompt || chr(10) || chr(10) || '=== EXPRESSION ===' || chr(10) || 't(((1 # 2) & 3))' || chr(10) || chr(10) || '=== TASK ===' || chr(10) || '{conversations.TASK}' as u,
        array_to_string(list_slice(string_split(derivation, chr(10)), 1, 4), chr(10)) as f, case c.n_nationkey % 2 when 0 then '{conversations.TURN_2[0]}' else '{conversations.TURN_2[1].replace("'", "''")}' end as z from c join ({{system_prompts}}) y using (n_nationkey))
      select n_nationkey, case when n_nationkey % 3 = 0 then 'user' when n_nationkey % 2 = 0 then 'user,model,user' else 'user,assistant,user' end as roles,
        case when n_nationkey % 3 = 0 then u || chr(10) || chr(10) || '{conversations.WORK}' || chr(10) || chr(10) || f || chr(10) || chr(10) || '{conversations.NEXT}' || chr(10) || z else u || chr(10) || '--' || chr(10) || f || chr(10) || '--' || chr(10) || z end as content from t""",
    "op_table_complete": _ALGEBRA + "select op, lhs, rhs from op where op = 'op1' and lhs = rhs",
    "distribution_counterexamples": _ALGEBRA + "select name, op, count(*) as n from (select t.name, o.op, t.dst as x, o2.result as y from op o join t on t.src = o.result join t tl on tl.name = t.name and tl.src = o.lhs join t tr on tr.name = t.name and tr.src = o.rhs join op o2 on o2.op = o.op and o2.lhs = tl.dst and o2.rhs = tr.dst) where x <> y group by all",
    "derived_table": _ALGEBRA + "select 'dop0' as op, a.x as lhs, b.x as rhs, (((a.x * b.x + 1) % 5) * a.x + 1) % 5 as result from s a, s b union all select 'dop1', a.x, b.x, (2 * ((6 * a.x + 1) % 5) + 4 * b.x + 1) % 5 from s a, s b",
    "eval_expression": _LEAVES + f"select {_IDS}, value from f",
    "corrupt_outcomes": _LEAVES + "select value, corrupted, value = corrupted as convergent, count(*) as n from f group by all",
    "clean_derivations": _LEAVES
    + f"""select {_IDS}, concat('Start: ((', a, ' # ', b, ') & ', c, ')', chr(10), chr(10),
      'Step 1: ((', a, ' # ', b, ') & ', c, ') = (', v1, ' & ', c, ')    [by # table]', chr(10),
      'Step 2: (', v1, ' & ', c, ') = ((', v1, ' # ', c, ') # ', v1, ')    [by definition of &]', chr(10),
      'Step 3: ((', v1, ' # ', c, ') # ', v1, ') = (', (v1 * c + 1) % 5, ' # ', v1, ')    [by # table]', chr(10),
      'Step 4: (', (v1 * c + 1) % 5, ' # ', v1, ') = ', value, '    [by # table]', chr(10), chr(10), 'Final Output: ', value) as derivation from f""",
    "injected_prefills": _LEAVES
    + f""", w as (select *, list_filter(list_transform([1, 2, 3, 4], lambda j: (v1 + j) % 5), lambda x: (((x * c + 1) % 5) * x + 1) % 5 <> value)[1] as w from f)
      select {_IDS}, w as injected, (((w * c + 1) % 5) * w + 1) % 5 as wrong_final, (case when w is null then 0 else 4 end)::bigint as steps,
      case when w is not null then concat('Start: ((', a, ' # ', b, ') & ', c, ')', chr(10), chr(10), 'Step 1: ((', a, ' # ', b, ') & ', c, ') = (', w, ' & ', c, ')    [by # table]', chr(10),
        'Step 2: (', w, ' & ', c, ') = ((', w, ' # ', c, ') # ', w, ')    [by definition of &]') end as prefill from w""",
    "reduction_steps": _LEAVES + f"select {_IDS}, step_number, rule_type, result, \"after\" from (select {_IDS}, 1::bigint as step_number, 'base' as rule_type, v1 as result, concat_ws(' ', v1, c, 'dop0') as \"after\" from f union all select {_IDS}, 2, 'derived', null, concat_ws(' ', v1, c, 'op1', v1, 'op1') from f union all select {_IDS}, 3, 'base', (v1 * c + 1) % 5, concat_ws(' ', (v1 * c + 1) % 5, v1, 'op1') from f union all select {_IDS}, 4, 'base', value, value::varchar from f)",
    "step_verdicts": _LEAVES
    + f"""select {_IDS}, m <> 3 as parseable, m in (0, 4) or m = 1 and same as derivation_valid, m = 0 or m = 1 and same as terminal_matches_gt,
      (case when m = 1 and not same then 1 end)::bigint as first_invalid_step, (case when m = 2 then 4 end)::bigint as first_discontinuity_step,
      (case m when 3 then 0 when 2 then 3 when 4 then 3 else 4 end)::bigint as parsed_step_count,
      case when m = 3 then 'unparseable' when m = 1 and not same then 'wrong step' when m = 2 then 'discontinuity' when m = 4 then 'terminal is not a single symbol' end as reason
      from (select *, l_linenumber % 5 as m, value = corrupted as same from f)""",
    "parse_step_lines": f"with x as ({STEP_TEXTS}), y as (select {_IDS}, unnest(string_split(raw_continuation_text, chr(10))) as line from x), "
    + f"""z as (select {_IDS}, regexp_extract(line, '^Step ([0-9]+): (.+) = (.+?)(    \\[by .*)?$', ['n', 'before', 'after']) as p from y where starts_with(line, 'Step '))
      select {_IDS}, cast(p.n as bigint) as step_number, p.before as before, p.after as after from z""",
    "final_output_rows": _SCORED + "select example_id, final_output from scored",
    "system_json_explode": _ALGEBRA + "select r_name, op, lhs, rhs, result from op join region on r_regionkey = lhs where op = 'op1'",
    "group_table": _GROUPS + "select a.op, a.symbol as lhs, b.symbol as rhs, c.symbol as result from l a join l b on a.op = b.op join l c on c.op = a.op and c.label = (a.label + b.label) % a.n",
    "group_automorphisms": _GROUPS + "select a.op, k, a.symbol as src, b.symbol as dst from l a join range(2, 25) r(k) on k < a.n and gcd(k, a.n) = 1 join l b on b.op = a.op and b.label = k * a.label % a.n",
    "system_prompts": """with s as (select range as x from range(5)), r as (
      select n_nationkey, a.x, '| **' || a.x || '** | ' || string_agg(((n_nationkey * a.x + b.x + 1) % 5)::varchar, ' | ' order by b.x) || ' |' as line, '  t(' || a.x || ') = ' || (a.x + n_nationkey) % 5 as move
      from nation, s a, s b group by n_nationkey, a.x)
      select n_nationkey, 'Symbols: {0, 1, 2, 3, 4}' || chr(10) || chr(10) || 'Operation # (defined by table):' || chr(10)
        || 'In the table below, the row is the left operand and the column is the right operand. For example, row a and column b means a # b.' || chr(10) || chr(10)
        || '| # | 0 | 1 | 2 | 3 | 4 |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || string_agg(line, chr(10) order by x) || chr(10) || chr(10) || 'Derived operation &:' || chr(10) || 'x & y = '
        || case n_nationkey % 3 when 0 then '(x # y) # x' when 1 then 't(x # y)' else '(x # x) # y' end || chr(10) || chr(10) || 'Transformation "t":' || chr(10)
        || string_agg(move, chr(10) order by x) || chr(10) || '  Distribution property: t(x # y) = t(x) # t(y)' as prompt from r group by n_nationkey""",
    "continuity_breaks": "select conv_id, min(turn) as first_break, count(*) as n from (select conv_id, turn, case when role = 'system' then 'user' else role end as r, lag(case when role = 'system' then 'user' else role end) over (partition by conv_id order by turn) as b from conversations) where b = r group by conv_id",
}
ORACLES["sql_ranked"] = _SCORED + """, g as (select difficulty, model::varchar as model, count(*) filter (matches_ground_truth) as correct, count(*) as total from scored where difficulty in ('easy', 'hard') group by 1, 2)
  select *, round(correct / total, 6) as share, row_number() over (partition by difficulty order by correct / total desc, model) as place from g"""
ORACLES |= shapes.ORACLES | drawn.ORACLES | logs.oracles(_SCORED, _P) | folders.oracles(_SCORED, _P, _NATION_CHAINS, ORACLES["system_prompts"])
ORACLES["single_turn_prompt"] = ORACLES["single_turn_prompt"].replace("{system_prompts}", ORACLES["system_prompts"])
