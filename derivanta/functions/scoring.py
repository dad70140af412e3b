"""Scoring of free-text continuations as Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ["detect_recover", "silent_recovery", "detect_only", "blind_wrong_branch", "off_rails", "extraction_failed"]

#: The phrases that voice doubt, in the order in which they are tried.
DOUBT = [
    r"\bwait\b",
    r"\bwrong\b",
    r"\bmistake\b",
    r"\berror\b",
    r"\bincorrect\b",
    r"\binvalid\b",
    r"\bcorrection\b",
    r"\bcorrect(ing|ed)?\b",
    r"\breconsider\b",
    r"\brecheck\b",
    r"\bre-?verify\b",
    r"\boops\b",
    r"\bhmm+\b",
    r"\bactually,",
    r"let me (re)?(check|verify|reconsider|reconfirm)\b",
    r"should (be|have been|actually)\b",
    r"(i (made|had) a|there('s| is) an?) (mistake|error|issue)",
    r"does not match",
    r"doesn't match",
    r"doesn't equal",
    r"does not equal",
    r"isn't correct",
    r"is not correct",
]
#: The marker line, a step's mention, and code points looked at on either side of a doubt.
FINAL = r"Final\s*Output\s*[:\-]\s*(.+?)(?:\n|$)"
STEP = r"\bstep\s*(\d+)\b"
WINDOW = 120

#: The fields that a record needs for evaluation and a prediction for scoring, and those of a score row.
RECORD_FIELDS = ["example_id", "turn_1_user", "turn_1_assistant_prefill", "ground_truth_final_output", "wrong_branch_final_output", "chain_length_x", "prefill_error_step", "difficulty", "error_type"]
PREDICTION_FIELDS = ["example_id", "difficulty", "chain_length_x", "prefill_error_step", "ground_truth_final_output", "wrong_branch_final_output", "raw_continuation_text", "model", "provider", "mode"]
SCORE_FIELDS = [*PREDICTION_FIELDS[:6], "final_output", "detected_loose", "detected_strict", "outcome_bucket", "matches_ground_truth", "matches_wrong_branch", "model", "provider", "mode", "raw_continuation_text"]

# Case-insensitive, with Unicode classes and \n as the only line end.
_FLAGS = "(?iduU)"
_DOUBT = _FLAGS + "|".join(DOUBT)
#: The characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Each doubt holds one of these, so a text without them needs no search. The letters are those that
#: are equal to a plain one but for case.
_HINTS = ["wait", "wrong", "mistake", "error", "incorrect", "invalid", "correct", "recon", "rechec", "verif", "oops", "hm", "actually", "let me", "should", "issue", "match", "equal"]
_ALIKE, _PLAIN = "\u017f\u0131\u0130\u212a", "siik"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once: a plan that repeats x in each step would double each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _unwrap(raw: Column, wrap: str) -> Column:
    n = len(wrap)
    inside = lambda r: F.startswith(r, F.lit(wrap)) & F.endswith(r, F.lit(wrap)) & (F.char_length(r) > 2 * n)
    return _let(raw, lambda r: F.when(inside(r), strip(r.substr(F.lit(n + 1), F.char_length(r) - 2 * n))).otherwise(r))


def final_output(text: Column) -> Column:
    """The first word after the last marker, without Markdown wrappers and closing dots; or null."""
    raw = strip(F.try_element_at(F.regexp_extract_all(text, F.lit(_FLAGS + FINAL), F.lit(1)), F.lit(-1)))
    raw = F.btrim(raw, F.lit("`"))
    for wrap in ("**", "*", "_", '"', "'"):
        raw = _unwrap(raw, wrap)
    word = lambda r: F.substring_index(F.btrim(F.translate(r, WHITE, " " * len(WHITE))), " ", 1)
    return _let(F.rtrim(raw, F.lit(".,")), lambda r: F.when(r != "", F.coalesce(F.nullif(word(r), F.lit("")), r)))


def _hinted(text: Column) -> Column:
    low = F.lower(F.translate(text, _ALIKE, _PLAIN))
    return _let(low, lambda t: reduce(or_, [F.contains(t, F.lit(h)) for h in _HINTS]))


def detects_loose(text: Column) -> Column:
    return F.coalesce(_hinted(text) & F.regexp_like(text, F.lit(_DOUBT)), F.lit(False))


def detects_strict(text: Column, error_step: Column) -> Column:
    """A doubt with the step's number within 120 code points; any number counts if error_step is null.

    Between two doubts lies one piece of the text split at doubts, so places follow from lengths."""
    found = F.regexp_extract_all(text, F.lit(_DOUBT), F.lit(0))
    pieces = F.split(text, _DOUBT, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def place(acc, x):
        start = acc["at"] + F.char_length(x["piece"])
        stop = start + F.char_length(x["doubt"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("spans"))

    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, d: F.struct(p.alias("piece"), d.alias("doubt")))
    spans = F.aggregate(both, empty, place)["spans"]

    def near(s):
        start = F.greatest(s["start"] - WINDOW, F.lit(0))
        part = text.substr(start + 1, s["stop"] + WINDOW - start)
        steps = F.regexp_extract_all(part, F.lit(_FLAGS + STEP), F.lit(1))
        return F.exists(steps, lambda n: error_step.isNull() | F.coalesce(n.try_cast("decimal(38,0)") == error_step, F.lit(False)))

    return F.coalesce(_hinted(text) & F.exists(spans, near), F.lit(False))


def outcome(final: Column, loose: Column, truth: Column, wrong: Column) -> Column:
    hit = F.coalesce(final == truth, F.lit(False))
    return (
        F.when(final.isNull(), "extraction_failed")
        .when(loose, F.when(hit, "detect_recover").otherwise("detect_only"))
        .when(hit, "silent_recovery")
        .when(F.coalesce(final == wrong, F.lit(False)), "blind_wrong_branch")
        .otherwise("off_rails")
    )


def score(predictions: DataFrame) -> DataFrame:
    """The columns of predictions and final_output, detected_loose, detected_strict, outcome_bucket,
    matches_ground_truth and matches_wrong_branch. Null texts are scored as failed extraction."""
    need = {"ground_truth_final_output", "wrong_branch_final_output", "prefill_error_step", "raw_continuation_text"} - set(predictions.columns)
    if need:
        raise ValueError(f"missing columns: {sorted(need)}")
    text, truth, wrong = F.col("raw_continuation_text"), F.col("ground_truth_final_output"), F.col("wrong_branch_final_output")
    out = predictions.withColumn("final_output", final_output(text)).withColumn("detected_loose", detects_loose(text))
    out = out.withColumn("detected_strict", detects_strict(text, F.col("prefill_error_step")))
    final = F.col("final_output")
    out = out.withColumn("outcome_bucket", outcome(final, F.col("detected_loose"), truth, wrong))
    return out.withColumn("matches_ground_truth", F.coalesce(final == truth, F.lit(False))).withColumn("matches_wrong_branch", F.coalesce(final == wrong, F.lit(False)))


def require_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows as they are; an error names the fields that are missing."""
    missing = [f for f in fields if f not in rows.columns]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    return rows


def missing_fields(line: Column, fields: list[str]) -> Column:
    """The fields that a JSON line does not have, in their order; all of them if it is no object."""
    wanted = F.array(*[F.lit(f) for f in fields])
    return F.array_except(wanted, F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")))


def score_rows(predictions: DataFrame) -> DataFrame:
    """The score row of each prediction, by SCORE_FIELDS."""
    return score(require_fields(predictions, PREDICTION_FIELDS)).select(*SCORE_FIELDS)


def predictions(records: DataFrame, responses: DataFrame) -> DataFrame:
    """Prediction rows: a record's fields with its response's (example_id, raw_continuation_text, mode,
    turn_2_user_sent, turn_2_level, response_id, request_latency_seconds, model, provider,
    api_model, usage). A null usage gives null token counts. Records without a response have no row."""
    usage = [F.col(f"usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")]
    own = ["example_id", "base_id", "difficulty", "error_type", "ground_truth_final_output", "wrong_branch_final_output", "chain_length_x", "prefill_error_step"]
    sent = ["raw_continuation_text", "mode", "turn_2_user_sent", "turn_2_level", "response_id", "request_latency_seconds", "model", "provider", "api_model"]
    return records.select(*own).join(responses, "example_id").select(*own, *sent, *usage)
