"""Token counts and texts from the JSON of providers' responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
#: Where each provider's responses hold the four counts.
PLACES = {
    "openai": ["$.usage.input_tokens", "$.usage.output_tokens", "$.usage.output_tokens_details.reasoning_tokens", "$.usage.total_tokens"],
    "anthropic": ["$.usage.input_tokens", "$.usage.output_tokens", None, None],
    "mistral": ["$.usage.prompt_tokens", "$.usage.completion_tokens", None, "$.usage.total_tokens"],
    "gemini": ["$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount", "$.usageMetadata.thoughtsTokenCount", "$.usageMetadata.totalTokenCount"],
    "openrouter": ["$.usage.prompt_tokens", "$.usage.completion_tokens", "$.usage.reasoning_tokens", "$.usage.total_tokens"],
}
DETAIL = "$.usage.completion_tokens_details.reasoning_tokens"


def _integer(v: Column, path: str) -> Column:
    """The integer at a path; null if there is none, or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def usage(response: Column, provider: Column) -> Column:
    """(input_tokens, output_tokens, reasoning_tokens, total_tokens) of a response's JSON text, each null if
    it is missing or no integer; null as a whole without a usage object. One provider gives
    no total, which is the sum; one may give reasoning tokens among the details only."""
    v = F.try_parse_json(response)

    def counts(name: str) -> Column:
        found = [_integer(v, p) if p else F.lit(None).cast("bigint") for p in PLACES[name]]
        if name == "anthropic":
            found[3] = found[0] + found[1]
        if name == "openrouter":
            own = F.try_variant_get(v, PLACES[name][2], "variant")
            found[2] = F.when(own.isNull() | F.is_variant_null(own), _integer(v, DETAIL)).otherwise(found[2])
        whole = F.try_variant_get(v, "$.usageMetadata" if name == "gemini" else "$.usage", "variant")
        return F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.struct(*[f.alias(c) for f, c in zip(found, _TOKENS, strict=True)]))

    out = F.when(provider == "xai", counts("openai"))
    for name in PLACES:
        out = out.when(provider == name, counts(name))
    return out


def _joined(items: Column, kind: str | None) -> Column:
    """Texts of an array of variants, of those of one type."""
    text = lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string"))
    some = F.filter(items, lambda x: F.try_variant_get(x, "$.type", "string") == kind) if kind else items
    return F.coalesce(F.array_join(F.transform(some, text), ""), F.lit(""))


def text(response: Column, provider: Column) -> Column:
    """The answer's text: the parts of its message, joined; empty if there is none."""
    v = F.try_parse_json(response)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    many = "array<variant>"
    outputs = F.filter(at("$.output", many), lambda o: F.try_variant_get(o, "$.type", "string") == "message")
    direct = F.nullif(at("$.output_text", "string"), F.lit(""))
    listed = F.array_join(F.transform(outputs, lambda o: _joined(F.try_variant_get(o, "$.content", many), "output_text")), "")
    said = "$.choices[0].message.content"
    chosen = F.when(F.schema_of_variant(at(said, "variant")) == "STRING", at(said, "string")).otherwise(_joined(at(said, many), "text"))
    return F.coalesce(
        F.when(provider.isin("openai", "xai"), F.coalesce(direct, listed))
        .when(provider == "anthropic", _joined(at("$.content", many), "text"))
        .when(provider == "gemini", _joined(at("$.candidates[0].content.parts", many), None))
        .when(provider.isin("mistral", "openrouter"), chosen),
        F.lit(""),
    )


_EVENT = "candidates array<struct<content:struct<role:string,parts:array<struct<text:string>>>,finishReason:string>>, usageMetadata string, responseId string"


def fold_events(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Lines of event streams -> one row a stream: key, text, role, finish_reason, usage (JSON), response_id and error.

    Only "data:" lines with JSON count. Texts are joined in order; of the rest the last one given
    counts. error tells a stream without events from one without a reason to finish.
    """
    body = F.ltrim(F.col(line).substr(F.lit(6), F.char_length(line)))
    e = F.from_json(F.when(F.col(line).startswith("data:") & F.try_parse_json(body).isNotNull() & (body != ""), body), _EVENT)
    rows = lines.select(F.col(key), F.col(order).alias("at"), e.alias("e"))
    parts = F.flatten(F.transform("e.candidates", lambda c: F.coalesce(c["content"]["parts"], F.array().cast("array<struct<text:string>>"))))
    last = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("at")))
    named = lambda f: F.try_element_at(F.filter(F.transform("e.candidates", f), lambda x: F.coalesce(x != "", F.lit(False))), F.lit(-1))
    piece = F.struct("at", F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    out = rows.groupBy(key).agg(
        F.count("e").alias("events"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), piece))), lambda p: p["text"]), "").alias("text"),
        F.coalesce(last(named(lambda c: c["content"]["role"])), F.lit("model")).alias("role"),
        last(named(lambda c: c["finishReason"])).alias("finish_reason"),
        F.coalesce(last(F.col("e.usageMetadata")), F.lit("{}")).alias("usage"),
        last(F.nullif(F.col("e.responseId"), F.lit(""))).alias("response_id"),
    )
    error = F.when(F.col("events") == 0, "no events").when(F.col("finish_reason").isNull(), "no finish reason")
    return out.select(key, "text", "role", "finish_reason", "usage", "response_id", error.alias("error"))
