"""A registry of models as a table: key, provider, api_model, effort and efforts (those that can be asked for)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(models: DataFrame, priority: list[str], providers: list[str] | None = None) -> DataFrame:
    """Models with their place: by the list of priority, the others after it, by key."""
    models = models if providers is None else models.where(F.col("provider").isin(*providers))
    place = F.nullif(F.array_position(F.array(*[F.lit(k) for k in priority]).cast("array<string>"), F.col("key")), F.lit(0))
    return models.withColumn("place", F.coalesce(place - 1, F.lit(len(priority))).cast("long")).orderBy("place", "key")


def choices(models: DataFrame, priority: list[str], providers: list[str] | None = None) -> DataFrame:
    return in_order(models, priority, providers).select("key")


def lookup(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """(key, ...) -> the same rows with their model's columns; a key that isn't registered fails the job. The
    registry is a few dozen rows, whose number doesn't follow the data."""
    known = models.withColumn("registered", F.lit(True))
    found = wanted.join(known, "key", "left")
    key = F.when(F.col("registered"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce("key", F.lit("null")))).cast("string"))
    return found.withColumn("key", key).drop("registered")


def with_effort(models: DataFrame, effort: str) -> DataFrame:
    """Models with another effort; one that a model doesn't list fails the job. none takes the effort off
    where efforts say so by holding "off" in its place."""
    can = F.array_contains("efforts", effort)
    off = F.lit(effort == "none") & F.array_contains("efforts", "off")
    bad = F.raise_error(F.concat(F.lit(f"effort {effort} is not supported by "), F.col("key"))).cast("string")
    return models.withColumn("effort", F.when(off, F.lit(None).cast("string")).when(F.coalesce(can, F.lit(False)), effort).otherwise(bad))


#: providers' documentation, the variable that holds their key, and tokens of an answer unless a model says otherwise.
PROVIDERS = [
    ("openai", "https://developers.openai.com/api/docs/models", "OPENAI_API_KEY"),
    ("anthropic", "https://platform.claude.com/docs/en/about-claude/models/overview", "ANTHROPIC_API_KEY"),
    ("openrouter", "https://ai.google.dev/gemini-api/docs/gemini-3", "OPENROUTER_API_KEY"),
    ("mistral", None, "MISTRAL_API_KEY"),
    ("xai", "https://docs.x.ai/developers/model-capabilities/text/reasoning", "XAI_API_KEY"),
]
MOST_TOKENS = 4096
MODEL = """key string, label string, provider string, api_model string, docs_url string, api_key_env_var string, default_max_output_tokens int,
openai_reasoning struct<effort: string, summary: string>, anthropic_thinking struct<enabled: boolean, budget_tokens: int, mode: string>,
anthropic_effort string, gemini_thinking struct<level: string>, notes string"""
#: Efforts that can be asked for. A rule holds for models of a provider (null: any) whose name starts
#: so, if they have the setting; the longest start counts. Without one the effort can't be set.
EFFORTS = ["none", "minimal", "low", "medium", "high", "xhigh", "max"]
RULES = [
    (None, "", "openai_reasoning", ["none", "minimal", "low", "medium", "high", "xhigh"]),
    ("xai", "", "openai_reasoning", ["none", "low", "medium", "high"]),
    ("anthropic", "claude-opus-4-5", "anthropic_effort", ["none", "low", "medium", "high"]),
    ("anthropic", "claude-mythos-preview", "anthropic_effort", ["none", "low", "medium", "high", "max"]),
    ("anthropic", "claude-opus-4-6", "anthropic_effort", ["none", "low", "medium", "high", "max"]),
    ("anthropic", "claude-sonnet-4-6", "anthropic_effort", ["none", "low", "medium", "high", "max"]),
    ("anthropic", "claude-opus-4-7", "anthropic_effort", ["none", "low", "medium", "high", "xhigh", "max"]),
    ("anthropic", "claude-opus-4-8", "anthropic_effort", ["none", "low", "medium", "high", "xhigh", "max"]),
]


def complete(models: DataFrame) -> DataFrame:
    """The columns of MODEL: those that models lacks, and the nulls among its documentation, key variables and token
    limits, by provider. The label is the key unless given. An unknown provider fails the job."""
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(MODEL)}
    own = {c: (F.col(c) if c in models.columns else F.lit(None)).cast(kind) for c, kind in kinds.items()}
    provider = own["provider"]
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in PROVIDERS]), place)
    place = F.array_position(F.array(*[F.lit(p[0]) for p in PROVIDERS]), provider).cast("int") - 1
    unknown = F.raise_error(F.concat(F.lit("unknown provider: "), F.coalesce(provider, F.lit("null")))).cast("string")
    own["provider"] = F.when(place >= 0, provider).otherwise(unknown)
    own["label"] = F.coalesce(own["label"], own["key"])
    own["docs_url"], own["api_key_env_var"] = F.coalesce(own["docs_url"], pick(1)), F.coalesce(own["api_key_env_var"], pick(2))
    own["default_max_output_tokens"] = F.coalesce(own["default_max_output_tokens"], F.lit(MOST_TOKENS))
    return models.select(*[v.alias(c) for c, v in own.items()])


def to_json(models: DataFrame) -> DataFrame:
    """key and settings: each model of the registry as a JSON object of all its fields, nulls too."""
    return models.select("key", F.to_json(F.struct(*models.columns), {"ignoreNullFields": "false"}).alias("settings"))


def override_effort(models: DataFrame, wanted: Column) -> DataFrame:
    """models (columns of MODEL and more) with the effort that is wanted, and verdict: "ok", or why it can't be set; such
    rows stay as they are. A null effort changes nothing.

    The rules are a constant list that each row searches: no join, whatever the number of rows.
    """
    rule = lambda p, name, field, efforts: F.struct(F.lit(len(name) + (p is not None)).alias("order"), F.lit(p).cast("string").alias("provider"), F.lit(name).alias("start"), F.lit(field).alias("field"), F.array(*[F.lit(e) for e in efforts]).alias("efforts"))
    has = lambda r: F.when(r["field"] == "openai_reasoning", F.col("openai_reasoning").isNotNull()).otherwise(F.col("openai_reasoning").isNull())
    fits = lambda r: has(r) & (r["provider"].isNull() | (r["provider"] == F.col("provider"))) & F.startswith("api_model", r["start"])
    rows = models.withColumn("_wanted", wanted.cast("string")).withColumn("_rule", F.array_max(F.filter(F.array(*[rule(*r) for r in RULES]), fits)))
    asked, efforts = F.col("_wanted"), F.col("_rule.efforts")
    why = (
        F.when(asked.isNull(), "ok")
        .when(F.col("_rule").isNull(), F.concat(F.lit("no effort can be set for "), F.col("key")))
        .when(F.array_contains(efforts, asked), "ok")
        .otherwise(F.concat(F.lit("effort "), asked, F.lit(" is none of "), F.array_join(efforts, ", "), F.lit(" for "), F.col("key")))
    )
    rows = rows.withColumn("verdict", why)
    set_ = (F.col("verdict") == "ok") & asked.isNotNull()
    openai, other = set_ & (F.col("_rule.field") == "openai_reasoning"), set_ & (F.col("_rule.field") == "anthropic_effort")
    rows = rows.withColumn("openai_reasoning", F.when(openai, F.struct(asked.alias("effort"), F.col("openai_reasoning.summary").alias("summary"))).otherwise(F.col("openai_reasoning")))
    return rows.withColumn("anthropic_effort", F.when(other, F.nullif(asked, F.lit("none"))).otherwise(F.col("anthropic_effort"))).drop("_wanted", "_rule")
