import json

import pytest
from derivanta.operators import latency, registry
from pyspark.sql import functions as F


def models(spark, rows):
    """(key, provider, api_model, openai effort or null, anthropic effort or null)."""
    df = spark.createDataFrame([(k, p, m, o, a) for k, p, m, o, a, *_ in rows], "key string, provider string, api_model string, o string, anthropic_effort string")
    return registry.complete(df.withColumn("openai_reasoning", F.when(F.col("o").isNotNull(), F.struct(F.col("o").alias("effort"), F.lit(None).cast("string").alias("summary")))))


CASES = [
    # key, provider, name, efforts set, asked for -> verdict is ok, efforts then
    ("gpt", "openai", "gpt-5.4", "medium", None, "high", True, "high", None),
    ("gpt-none", "openai", "gpt-5.4", "medium", None, "none", True, "none", None),
    ("gpt-max", "openai", "gpt-5.4", "medium", None, "max", False, "medium", None),
    ("grok", "xai", "grok-4.3", "high", None, "low", True, "low", None),
    ("grok-xhigh", "xai", "grok-4.3", "high", None, "xhigh", False, "high", None),
    ("grok-minimal", "xai", "grok-4.3", "high", None, "minimal", False, "high", None),
    ("sonnet", "anthropic", "claude-sonnet-4-6", None, "max", "low", True, None, "low"),
    ("sonnet-max", "anthropic", "claude-sonnet-4-6", None, None, "max", True, None, "max"),
    ("sonnet-none", "anthropic", "claude-sonnet-4-6", None, "max", "none", True, None, None),
    ("sonnet-minimal", "anthropic", "claude-sonnet-4-6", None, "max", "minimal", False, None, "max"),
    ("sonnet-xhigh", "anthropic", "claude-sonnet-4-6", None, "max", "xhigh", False, None, "max"),
    ("opus45-max", "anthropic", "claude-opus-4-5", None, None, "max", False, None, None),
    ("opus47", "anthropic", "claude-opus-4-7", None, "max", "xhigh", True, None, "xhigh"),
    ("opus48", "anthropic", "claude-opus-4-8", None, "max", "xhigh", True, None, "xhigh"),
    ("haiku", "anthropic", "claude-haiku-4-5", None, None, "low", False, None, None),
    ("mistral", "mistral", "m-large", None, None, "low", False, None, None),
    ("plain-gpt", "openai", "gpt-4.1-mini", None, None, "low", False, None, None),
    ("nothing", "openai", "gpt-4.1-mini", None, None, None, True, None, None),
]


def test_effort_rules(spark):
    wanted = spark.createDataFrame([(c[0], c[5]) for c in CASES], "key string, wanted string")
    got = {r.key: r for r in registry.override_effort(models(spark, CASES).join(wanted, "key"), F.col("wanted")).collect()}
    for key, _, _, _, _, asked, fine, openai, anthropic in CASES:
        r = got[key]
        assert (r.verdict == "ok") == fine, r
        assert (r.openai_reasoning and r.openai_reasoning.effort, r.anthropic_effort) == (openai, anthropic), r
        assert fine or asked is None or key in r.verdict
    assert got["haiku"].verdict.startswith("no effort") and "none, low, medium, high" in got["grok-xhigh"].verdict


def test_defaults_and_json(spark):
    made = models(spark, [("a", "anthropic", "x", None, "low"), ("b", "openrouter", "google/y", None, None)]).withColumn("notes", F.lit("é"))
    rows = {r.key: json.loads(r.settings) for r in registry.to_json(made).collect()}
    assert rows["a"]["label"] == "a" and rows["a"]["default_max_output_tokens"] == registry.MOST_TOKENS and rows["a"]["api_key_env_var"] == "ANTHROPIC_API_KEY" and rows["a"]["notes"] == "é"
    assert rows["b"]["openai_reasoning"] is None and set(rows["b"]) == set(made.columns)
    with pytest.raises(Exception, match="unknown provider"):
        models(spark, [("a", "nobody", "x", None, None)]).collect()


def test_sketches_merge(spark):
    """Parts merged give the whole's figures; ranks and counts within their bounds; nulls and empty keys."""
    rows = spark.range(20_000).select((F.col("id") % 3).alias("cell"), F.concat(F.lit("e"), F.col("id") % 7000).alias("example_id"), F.when(F.col("id") % 10 > 0, F.pow(F.col("id") % 997, 2)).alias("request_latency_seconds"))
    parts = latency.sketched(rows.withColumn("part", F.spark_partition_id() % 4), "cell", "part")
    got = latency.merged(parts, "cell").select("cell", "rows", "total", "least", "most", latency.quantile(0.5).alias("median"), latency.quantile(0.95).alias("high"), latency.distinct_ids().alias("about")).orderBy("cell").collect()
    whole = latency.sketched(rows, "cell").orderBy("cell").collect()
    for g, w in zip(got, whole, strict=True):
        assert (g.rows, g.total, g.least, g.most) == (w.rows, w.total, w.least, w.most)
        own = sorted(r[0] for r in rows.where((F.col("cell") == g.cell) & F.col("request_latency_seconds").isNotNull()).select("request_latency_seconds").collect())
        for value, share in ((g.median, 0.5), (g.high, 0.95)):
            assert sum(x < value for x in own) / len(own) <= share + 0.02 and sum(x <= value for x in own) / len(own) >= share - 0.02
        ids = rows.where(F.col("cell") == g.cell).select("example_id").distinct().count()
        assert abs(g.about - ids) < 0.04 * ids
    none = latency.sketched(rows.where("request_latency_seconds is null and cell = 1"), "cell").select("rows", latency.quantile(0.5).alias("q"), "total").collect()
    assert [tuple(r) for r in none] == [(0, None, None)]
