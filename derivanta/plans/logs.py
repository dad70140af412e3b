"""Queries over registries, logs of attempts, latencies, event times and dataset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import RECORD_FIELDS, missing_fields
from ..operators import latency, registry
from ..sources import dataset, jsonl
from ..sources.scratch import Scratch
from ..streaming import log, windows
from ..streaming.scores import score_stream

#: Models of a registry: provider, name, whether it has a reasoning setting.
_MODELS = [("openai", "gpt-a", True), ("xai", "grok-a", True), ("anthropic", "claude-opus-4-5", False), ("anthropic", "claude-opus-4-8", False), ("anthropic", "claude-haiku", False), ("openrouter", "google/gem", False), ("anthropic", "claude-sonnet-4-6-x", False), ("openai", "gpt-b", False)]


def _models(customer: DataFrame) -> DataFrame:
    """A model for each customer, by its key."""
    kinds = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("api_model"), F.lit(r).alias("reasons")) for p, m, r in _MODELS])
    rows = customer.select("c_custkey", "c_nationkey", F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("key"), F.get(kinds, (F.col("c_custkey") % len(_MODELS)).cast("int")).alias("k"))
    return rows.select("c_custkey", "c_nationkey", "key", "k.provider", "k.api_model", F.when(F.col("k.reasons"), F.struct(F.lit("medium").alias("effort"), F.lit("auto").alias("summary"))).alias("openai_reasoning"), F.lit("low").alias("anthropic_effort"))


def effort_rules(customer: DataFrame) -> DataFrame:
    wanted = F.get(F.array(*[F.lit(e) for e in registry.EFFORTS]), (F.col("c_nationkey") % (len(registry.EFFORTS) + 1)).cast("int"))
    rows = registry.override_effort(_models(customer), wanted)
    return rows.select("c_custkey", (F.col("verdict") == "ok").alias("fine"), "verdict", F.col("openai_reasoning.effort").alias("openai_effort"), "anthropic_effort")


def registry_json(customer: DataFrame) -> DataFrame:
    return registry.to_json(registry.complete(_models(customer)))


def model_choices(models: DataFrame) -> DataFrame:
    """Registered models in order, with their place."""
    found = registry.choices(models, ["NATION_7", "NATION_3", "NATION_11"])
    return found.agg(F.array_join(F.slice(F.collect_list("key"), 1, 3), ",").alias("first"), F.count("*").alias("n"))


def latency_figures(predictions: DataFrame) -> DataFrame:
    """Sketches of two parts of each model's predictions, merged; whether the median's rank and the count of distinct ids
    are within the sketches' error."""
    rows = predictions.select("example_id", "model", (F.col("example_id") * 37 % 1000 / 8).alias("request_latency_seconds"))
    parts = latency.sketched(rows.withColumn("part", F.col("example_id") % 2), "model", "part")
    found = latency.merged(parts, "model").withColumn("median", latency.quantile(0.5)).withColumn("about", latency.distinct_ids())
    exact = rows.join(found.select("model", "median"), "model").groupBy("model").agg((F.count_if(F.col("request_latency_seconds") < F.col("median")) / F.count("*")).alias("below"), (F.count_if(F.col("request_latency_seconds") <= F.col("median")) / F.count("*")).alias("upto"), F.countDistinct("example_id").alias("ids"))
    both = found.drop("ids").join(exact, "model")
    return both.select("model", "rows", "total", "least", "most", ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_fits"), (F.abs(F.col("about") - F.col("ids")) <= 0.04 * F.col("ids") + 1).alias("ids_fit"))


def _shown():
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")]


def score_windows(scored: DataFrame) -> DataFrame:
    found = windows.tumbling(scored, "ts", "6 hours", "difficulty")
    return found.select("difficulty", *_shown(), "total", "correct", "doubted")


def score_sessions(scored: DataFrame) -> DataFrame:
    found = windows.sessions(scored, "ts", "12 hours", "model")
    return found.select("model", *_shown(), "total", "correct", "doubted")


def attempt_log(events: DataFrame) -> DataFrame:
    """Events as attempts at their user's example; views fail, and users of 5 n have no success at all."""
    text = F.when((F.col("event_type") != "view") & (F.col("user_id") % 5 > 0), F.concat("event_type", (F.col("event_id") % 7).cast("string")))
    return log.latest(events.select(F.col("user_id").cast("string").alias("example_id"), (F.col("event_id") % 50).alias("attempt"), text.alias("raw_continuation_text")))


def absent_record_fields(predictions: DataFrame) -> DataFrame:
    """What a JSON line made of a prediction lacks of the fields that an evaluation needs of a record."""
    line = F.to_json(F.struct("example_id", "difficulty", F.when(F.col("example_id") % 2 > 0, F.lit("E")).alias("error_type"), F.when(F.col("model") % 3 > 0, "u").alias("turn_1_user"), "chain_length_x"))
    return predictions.groupBy(F.array_join(missing_fields(line, RECORD_FIELDS), ",").alias("missing")).agg(F.count("*").alias("n"))


def dataset_folder(predictions: DataFrame) -> DataFrame:
    """A dataset written as a folder: the manifest's counts as they are read back, and the rows of each split's file."""
    spark = predictions.sparkSession
    path = Scratch(spark, "dataset").path("made")
    kind = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "click", F.col("event_type"))
    rows = predictions.select("example_id", "difficulty", kind.alias("error_type"), F.when(F.col("model") < 9, "test").otherwise("train").alias("split"))
    lengths = dataset.length_overrides("easy=5, Hard=12", {"easy": 6, "hard": 10})
    dataset.write_dataset(rows, path, dataset.manifest(rows, "made", 7, lengths, {}, 3), "Made", "Rows.")
    told = dataset.read_manifest(spark, path)
    counts = [(k.removesuffix("_counts"), name, n) for k in ("split_counts", "difficulty_counts", "error_type_counts") for name, n in told[k].items()]
    counts += [("lengths", k, n) for k, n in told["target_lengths"].items()] + [("total", "", told["total_examples"]), ("bases", "", told["bases_per_difficulty"])]
    files = [jsonl.read_jsonl(spark, f"{path}/{s}.jsonl", "split string").groupBy(F.lit("file").alias("kind"), F.col("split").alias("name")).agg(F.count("*").alias("n")) for s in ("test", "train")]
    return spark.createDataFrame(counts, "kind string, name string, n long").unionByName(files[0]).unionByName(files[1])


def streamed_scores(predictions: DataFrame) -> DataFrame:
    """Predictions as a folder that a stream scores, some of them there twice: one row of each counts."""
    spark = predictions.sparkSession
    scratch = Scratch(spark, "stream")
    folder, out, state = scratch.path("in"), scratch.path("out"), scratch.path("state")
    rows = predictions.select(F.col("example_id").cast("string").alias("example_id"), "difficulty", "ground_truth_final_output", "wrong_branch_final_output", F.col("prefill_error_step").cast("int").alias("prefill_error_step"), "raw_continuation_text")
    rows.write.json(folder)
    jsonl.append_jsonl(rows.where("example_id % 3 = 0"), folder)
    query = score_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("example_id").cast("long").alias("example_id"), "difficulty", "outcome_bucket", "detected_strict")


def oracles(scored: str, predictions: str) -> dict[str, str]:
    """SQL, given the CTEs scored and p."""
    efforts = "[" + ", ".join(f"'{e}'" for e in registry.EFFORTS) + "]"
    case = "case c_custkey % 8 " + " ".join(f"when {i} then '{m}'" for i, (_, m, _) in enumerate(_MODELS)) + " end"
    provider = "case c_custkey % 8 " + " ".join(f"when {i} then '{p}'" for i, (p, _, _) in enumerate(_MODELS)) + " end"
    docs = "case provider " + " ".join(f"when '{p}' then '{d}'" for p, d, _ in registry.PROVIDERS if d) + " end"
    key_of = "case provider " + " ".join(f"when '{p}' then '{k}'" for p, _, k in registry.PROVIDERS) + " end"
    allowed = """case c_custkey % 8 when 0 then ['none', 'minimal', 'low', 'medium', 'high', 'xhigh'] when 1 then ['none', 'low', 'medium', 'high'] when 2 then ['none', 'low', 'medium', 'high']
      when 3 then ['none', 'low', 'medium', 'high', 'xhigh', 'max'] when 6 then ['none', 'low', 'medium', 'high', 'max'] end"""
    return {
        "effort_rules": f"""with c as (select c_custkey, {efforts}[c_nationkey % 8 + 1] as e, {allowed} as a from customer), d as (select *, e is null or coalesce(list_contains(a, e), false) as fine from c)
          select c_custkey, fine, case when fine then 'ok' when a is null then 'no effort can be set for m' || c_custkey else 'effort ' || e || ' is none of ' || array_to_string(a, ', ') || ' for m' || c_custkey end as verdict,
          case when c_custkey % 8 < 2 then case when fine and e is not null then e else 'medium' end end as openai_effort,
          case when c_custkey % 8 in (2, 3, 6) and fine and e is not null then nullif(e, 'none') else 'low' end as anthropic_effort from d""",
        "registry_json": f"""with c as (select *, {case} as model, {provider} as provider from customer), d as (select *, {docs} as docs, {key_of} as k from c)
          select 'm' || c_custkey as key, '{{"key":"m' || c_custkey || '","label":"m' || c_custkey || '","provider":"' || provider || '","api_model":"' || model || '","docs_url":' || coalesce('"' || docs || '"', 'null') || ',"api_key_env_var":"' || k
          || '","default_max_output_tokens":{registry.MOST_TOKENS},"openai_reasoning":' || case when c_custkey % 8 < 2 then '{{"effort":"medium","summary":"auto"}}' else 'null' end || ',"anthropic_thinking":null,"anthropic_effort":"low","gemini_thinking":null,"notes":null}}' as settings from d""",
        "model_choices": "select 'NATION_7,NATION_3,NATION_11' as first, count(*) as n from nation",
        "latency_figures": predictions + "select model, count(*) as rows, sum(example_id * 37 % 1000 / 8) as total, min(example_id * 37 % 1000 / 8) as least, max(example_id * 37 % 1000 / 8) as most, true as median_fits, true as ids_fit from p group by model",
        "score_windows": scored + "select difficulty, strftime(s, '%Y-%m-%d %H:%M:%S.%f') as start, strftime(s + interval 6 hours, '%Y-%m-%d %H:%M:%S.%f') as end, count(*) as total, count(*) filter (matches_ground_truth) as correct, count(*) filter (detected_loose) as doubted from (select scored.*, make_timestamp(epoch_us(e.ts) // 21600000000 * 21600000000) as s from scored join events e on e.event_id = example_id) group by all",
        "score_sessions": scored
        + """, t as (select scored.*, epoch_us(e.ts) as t from scored join events e on e.event_id = example_id), b as (select *, coalesce(t - lag(t) over (partition by model order by t) >= 43200000000, true) as fresh from t),
          g as (select *, sum(fresh::int) over (partition by model order by t rows unbounded preceding) as g from b)
          select model, strftime(make_timestamp(min(t)), '%Y-%m-%d %H:%M:%S.%f') as start, strftime(make_timestamp(max(t) + 43200000000), '%Y-%m-%d %H:%M:%S.%f') as end, count(*) as total, count(*) filter (matches_ground_truth) as correct, count(*) filter (detected_loose) as doubted from g group by model, g""",
        "attempt_log": """with a as (select user_id::varchar as example_id, event_id % 50 as attempt, case when event_type <> 'view' and user_id % 5 > 0 then event_type || event_id % 7 end as t from events),
          r as (select *, row_number() over (partition by example_id order by t is null, attempt desc, t desc) as r, count(*) over (partition by example_id) as attempts from a)
          select example_id, case when t is not null then attempt end as attempt, t as raw_continuation_text, attempts from r where r = 1""",
        "absent_record_fields": predictions + "select case when model % 3 = 0 then 'turn_1_user,' else '' end || 'turn_1_assistant_prefill,ground_truth_final_output,wrong_branch_final_output,prefill_error_step' || case when example_id % 2 = 0 then ',error_type' else '' end as missing, count(*) as n from p group by 1",
        "dataset_folder": predictions
        + """, k as (select case when model < 9 then 'test' else 'train' end as split, difficulty, case when event_type in ('error', 'click') then 'clean' else event_type end as kind from p)
          select 'split' as kind, split as name, count(*) as n from k group by 2 union all select 'file', split, count(*) from k group by 2 union all select 'split', 'validation', 0 union all select 'difficulty', difficulty, count(*) from k group by 2 union all select 'error_type', k.kind, count(*) from k group by 2
          union all select 'lengths', 'easy', 5 union all select 'lengths', 'hard', 12 union all select 'total', '', count(*) from k union all select 'bases', '', 3""",
        "streamed_scores": scored + "select example_id, difficulty, outcome_bucket, detected_strict from scored",
    }
