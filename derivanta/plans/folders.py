"""Queries that write folders of evaluations and datasets under the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runs
from ..functions import cells, conversations
from ..functions.scoring import SCORE_FIELDS
from ..operators import report
from ..operators.numbering import numbered
from ..sources import evals, files, jsonl
from ..sources.scratch import Scratch


def _cell(model, level):
    return F.concat(F.lit("org-m"), model.cast("string"), F.lit("-"), cells.cell(F.lit("prefill"), level))


def eval_folder(scored: DataFrame) -> DataFrame:
    """Summaries of the scores of each model and level, written as a tree of folders and read back from it. Models 3
    and 5 have predictions only at level 1; model 7's summary can't be read and model 9's lacks its rate."""
    root = Scratch(scored.sparkSession, "evals").path("tree")
    level = F.col("example_id") % 2
    rows = scored.withColumn("cell", _cell(F.col("model"), level))
    told = report.score_summaries(rows.where("not (model in (3, 5) and example_id % 2 = 1)"), "cell")
    told = told.withColumn("headline", F.when(F.col("cell").startswith("org-m9-"), F.col("headline").withField("final_answer_correct_rate", F.lit(None).cast("double"))).otherwise(F.col("headline")))
    evals.write_score_summaries(told, root)
    for m in (3, 5):
        files.write_text(scored.sparkSession, f"{root}/org-m{m}-B-L1/{cells.PREDICTIONS}", "{}\n")
    for k in (0, 1):
        files.write_text(scored.sparkSession, f"{root}/org-m7-B-L{k}/{cells.SCORE_SUMMARY}", '{"headline": ')
    files.write_text(scored.sparkSession, f"{root}/notes/{cells.SCORE_SUMMARY}", "{}")
    found = evals.read_cells(scored.sparkSession, root)
    return found.select("cell", "model", "variant", F.col("level").cast("long").alias("level"), "total", "rate", F.col("by_difficulty")["easy"]["final_answer_correct_rate"].alias("easy_rate"), "status")


def _records(predictions: DataFrame) -> DataFrame:
    """Records of a dataset, one for each prediction."""
    text = lambda c, s: F.lit(s).alias(c)
    own = ["difficulty", "ground_truth_final_output", "wrong_branch_final_output", F.col("prefill_error_step").cast("int").alias("prefill_error_step"), F.col("chain_length_x").cast("int").alias("chain_length_x")]
    return predictions.select(F.col("example_id").cast("string").alias("example_id"), text("base_id", "b"), text("error_type", "E-CONTINUE"), text("turn_1_user", "u"), text("turn_1_assistant_prefill", "p"), *own)


def _answers(predictions: DataFrame) -> DataFrame:
    """Responses: the text, a latency and a usage that some lack."""
    n = F.col("example_id")
    usage = F.when(n % 4 > 0, F.struct((n % 50).alias("input_tokens"), (n % 7).alias("output_tokens"), F.when(n % 3 == 0, n % 5).alias("reasoning_tokens"), (n % 90).alias("total_tokens")))
    sent = [F.lit(x).alias(c) for c, x in (("mode", "prefill"), ("turn_2_user_sent", conversations.TURN_2[0]), ("turn_2_level", 0), ("response_id", "r"))]
    return predictions.select(n.cast("string").alias("example_id"), "raw_continuation_text", *sent, (n % 16 / 16).alias("request_latency_seconds"), F.concat(F.lit("m"), F.col("model").cast("string")).alias("model"), "provider", F.lit("api").alias("api_model"), usage.alias("usage"))


def run_summary(predictions: DataFrame) -> DataFrame:
    """The summaries of three runs into one folder: over records 0 of 3, over all, of which 1 in 5 gets no answer, and over
    all again."""
    spark = predictions.sparkSession
    folder = Scratch(spark, "run").path("m-B-L0")
    records, answers = _records(predictions), _answers(predictions)
    reply = lambda some: lambda pending: some.join(pending.select("example_id"), "example_id", "left_semi")
    settings = {"model": "m", "provider": "p", "mode": "prefill", "turn_2_level": 0}
    told = [
        runs.evaluate(records.where("example_id % 3 = 0"), reply(answers), folder, settings),
        runs.evaluate(records, reply(answers.where("example_id % 5 > 0")), folder, settings),
        runs.evaluate(records, reply(answers), folder, settings),
    ]
    keys = ["total_examples", "completed_examples", "appended_examples", "appended_latency_seconds", "appended_input_tokens", "appended_reasoning_tokens"]
    rows = [(i, t["matrix_cell"], *[t[k] for k in keys]) for i, t in enumerate(told)]
    return spark.createDataFrame(rows, "run long, cell string, " + ", ".join(f"{k} {'double' if 'latency' in k else 'long'}" for k in keys))


def run_predictions(predictions: DataFrame) -> DataFrame:
    """The prediction rows that a run has written."""
    spark = predictions.sparkSession
    folder = Scratch(spark, "run").path("m-B-L0")
    answers = _answers(predictions)
    for part in ("example_id % 2 = 0", "true"):
        runs.evaluate(_records(predictions).where(part), lambda pending: answers, folder, {"mode": "prefill", "turn_2_level": 0})
    rows = jsonl.read_jsonl(spark, cells.eval_paths(folder)["predictions"])
    return rows.select(F.col("example_id").cast("long").alias("example_id"), "difficulty", F.col("chain_length_x").cast("long").alias("chain_length_x"), "request_latency_seconds", "model", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


def scored_file(predictions: DataFrame) -> DataFrame:
    """Predictions as a file, scored into scores.jsonl, and these rows."""
    spark = predictions.sparkSession
    folder = Scratch(spark, "scores").path("run")
    rows = _answers(predictions).drop("usage").join(_records(predictions), "example_id")
    rows.write.json(f"{folder}/{cells.PREDICTIONS}")
    runs.score(spark, folder)
    found = jsonl.read_jsonl(spark, f"{folder}/{cells.SCORES}", ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in SCORE_FIELDS))
    return found.withColumn("example_id", F.col("example_id").cast("long")).drop("raw_continuation_text")


_KINDS = {"chain_length_x": "bigint", "prefill_error_step": "bigint"} | dict.fromkeys(("detected_loose", "detected_strict", "matches_ground_truth", "matches_wrong_branch"), "boolean")


def file_order(predictions: DataFrame) -> DataFrame:
    """Lines of a folder of files, descending by id, with their places; slices are filters on these."""
    spark = predictions.sparkSession
    path = Scratch(spark, "lines").path("rows.jsonl")
    rows = predictions.select("example_id", "difficulty")
    rows.repartitionByRange(F.desc("example_id")).sortWithinPartitions(F.desc("example_id")).write.json(path)
    ordered = jsonl.read_ordered(spark, path, "example_id bigint, difficulty string")
    return jsonl.slice_rows(ordered, start=7)


def numbered_lines(lineitem: DataFrame) -> DataFrame:
    """Lines numbered in all and within their order, without a window over either."""
    scratch = Scratch(lineitem.sparkSession, "numbers")
    slim = scratch.save(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "slim")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    every = scratch.save(numbered(slim, None, keys, scratch).select(*keys, F.col("place").alias("ordinal")), "every")
    own = numbered(every.withColumn("flag", F.pmod("l_partkey", F.lit(3))), "flag", ["l_suppkey", *keys, "ordinal"], scratch)
    return own.select(*keys, "ordinal", "flag", F.col("place").alias("in_flag"), F.col("n").alias("flag_rows"))


def previews(chains: DataFrame) -> DataFrame:
    """Records of a dataset's folder, the third and the ten that follow, as text."""
    spark = chains.sparkSession
    path = Scratch(spark, "dataset").path("made")
    rows = chains.withColumn("split", F.lit("test")).withColumn("example_id", F.format_string("e-%02d", "n_nationkey")).repartitionByRange(1, "n_nationkey").sortWithinPartitions("n_nationkey")
    jsonl.write_splits(rows.drop("n_nationkey"), path, ["train", "test"])
    return runs.preview(spark, path, start=2, count=11).select("ordinal", "example_id", "split", "conversation")


def oracles(scored: str, predictions: str, chains: str, prompts: str) -> dict[str, str]:
    """SQL, given the CTEs scored, p and c (chains) and the prompts' query."""
    easy = "round(count(*) filter (matches_ground_truth and difficulty = 'easy') / nullif(count(*) filter (difficulty = 'easy'), 0), 4)"
    tokens = "sum(case when example_id % 4 > 0 then example_id % 50 end)::bigint as i, sum(case when example_id % 4 > 0 and example_id % 3 = 0 then example_id % 5 end)::bigint as r, sum(example_id % 16 / 16) as s, count(*) as n"
    ids = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return {
        "eval_folder": scored
        + f""", g as (select model, example_id % 2 as level, count(*) as total, round(count(*) filter (matches_ground_truth) / count(*), 4) as rate, {easy} as easy_rate from scored where not (model in (3, 5) and example_id % 2 = 1) group by all),
          h as (select * from g union all select m, 1, null, null, null from (values (3), (5)) v(m))
          select 'org-m' || model || '-B-L' || level as cell, 'org-m' || model as model, 'B' as variant, level, case when model <> 7 then total end as total, case when model not in (7, 9) then rate end as rate, case when model <> 7 then easy_rate end as easy_rate,
          case when total is null then 'no summary' when model = 7 then 'no JSON' when model = 9 then 'no rate' else 'ok' end as status from h""",
        "run_summary": predictions
        + f""", a as (select {tokens} from p where example_id % 3 = 0), b as (select {tokens} from p where example_id % 3 > 0 and example_id % 5 > 0), c as (select {tokens} from p where example_id % 3 > 0 and example_id % 5 = 0), t as (select count(*) as many from p)
          select 0::bigint as run, 'B-L0' as cell, a.n as total_examples, a.n as completed_examples, a.n as appended_examples, a.s as appended_latency_seconds, a.i as appended_input_tokens, a.r as appended_reasoning_tokens from a
          union all select 1, 'B-L0', many, a.n + b.n, b.n, b.s, b.i, b.r from a, b, t union all select 2, 'B-L0', many, many, c.n, c.s, c.i, c.r from c, t""",
        "run_predictions": predictions
        + """select example_id, difficulty, chain_length_x::bigint as chain_length_x, example_id % 16 / 16 as request_latency_seconds, 'm' || model as model, case when example_id % 4 > 0 then example_id % 50 end as input_tokens, case when example_id % 4 > 0 then example_id % 7 end as output_tokens,
          case when example_id % 4 > 0 and example_id % 3 = 0 then example_id % 5 end as reasoning_tokens, case when example_id % 4 > 0 then example_id % 90 end as total_tokens from p""",
        "scored_file": scored
        + "select example_id, difficulty, chain_length_x::bigint as chain_length_x, prefill_error_step::bigint as prefill_error_step, ground_truth_final_output, wrong_branch_final_output, final_output, detected_loose, detected_strict, outcome_bucket, matches_ground_truth, matches_wrong_branch, 'm' || model as model, provider, 'prefill' as mode from scored",
        "file_order": predictions + "select * from (select example_id, difficulty, row_number() over (order by example_id desc) - 1 as ordinal from p) where ordinal >= 7",
        "numbered_lines": f"""with o as (select {ids}, row_number() over (order by {ids}) - 1 as ordinal, l_partkey % 3 as flag from lineitem)
          select *, row_number() over (partition by flag order by l_suppkey, {ids}, ordinal) - 1 as in_flag, count(*) over (partition by flag) as flag_rows from o""",
        "previews": chains
        + f"""select n_nationkey as ordinal, 'e-' || lpad(n_nationkey::varchar, 2, '0') as example_id, 'test' as split, '=== TURN 1 USER ===' || chr(10) || 'Below is a formal system called "' || n_name || '".' || chr(10) || chr(10) || '=== RULES ===' || chr(10) || y.prompt || chr(10) || chr(10)
          || '=== EXPRESSION ===' || chr(10) || 't(((1 # 2) & 3))' || chr(10) || chr(10) || '=== TASK ===' || chr(10) || '{conversations.TASK}' || chr(10) || chr(10) || '=== TURN 1 ASSISTANT PREFILL ===' || chr(10)
          || array_to_string(list_slice(string_split(derivation, chr(10)), 1, 4), chr(10)) || chr(10) || chr(10) || '=== TURN 2 USER ===' || chr(10) || '{conversations.TURN_2[0]}' as conversation from c join ({prompts}) y using (n_nationkey) where n_nationkey between 2 and 12""",
    }
