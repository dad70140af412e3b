"""Entry points: evaluate, score, rank and preview, as functions and as commands.

    python -m derivanta.runs score FOLDER_OR_FILE [--output-dir FOLDER]
    python -m derivanta.runs rank EVALS_FOLDER --level 0
    python -m derivanta.runs preview DATASET [--split test] [--start 0] [--count 1] [--id EXAMPLE]
    python -m derivanta.runs generate NAME COUNT OUT [--seed 20260413] [--lengths easy=6,hard=12]
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import cells, conversations, scoring
from .operators import generation, report
from .sources import dataset, evals, files
from .sources.jsonl import PREDICTION, read_jsonl, read_ordered, slice_rows

#: The fields of a run's summary that its settings give, in order.
SETTINGS = ["model", "provider", "api_model", "mode", "reasoning_effort_requested", "openai_reasoning_effort", "anthropic_thinking_enabled", "anthropic_thinking_mode", "anthropic_thinking_budget_tokens", "anthropic_effort", "gemini_thinking_level", "max_output_tokens", "turn_2_level", "input_path"]
TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]


def done_ids(spark: SparkSession, folder: str) -> DataFrame:
    """example_id of the predictions that a run's folder holds, each once."""
    path = cells.eval_paths(folder)["predictions"]
    if not files.exists(spark, path):
        return spark.createDataFrame([], "example_id string")
    return read_jsonl(spark, path, "example_id string").where("example_id is not null").distinct()


def evaluate(records: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, settings: dict, resume: bool = True) -> dict:
    """Answers the records whose example_id isn't among the folder's predictions, appends the answers to
    them and returns the run's summary, which is written beside them.

    answer takes pending records and returns responses as functions.scoring.predictions takes them.
    A record without a response, or with a null text, stays pending; answers to other records are left
    out. settings gives the fields of SETTINGS;
    those that are missing are null. resume=False starts anew.

    What was appended, its tokens and its latency are observed while it is written, so no pass over the
    predictions follows. The counts before the run come from ids alone. Rows appear when the
    job commits: one that fails leaves the folder as it was.
    """
    spark = records.sparkSession
    scoring.require_fields(records, scoring.RECORD_FIELDS)
    paths = cells.eval_paths(folder)
    if not resume:
        files.delete(spark, paths["predictions"])
    files.as_folder(spark, paths["predictions"])
    done = done_ids(spark, folder)
    seen = done.withColumn("seen", F.lit(1))
    total, known = records.select("example_id").join(seen, "example_id", "left").agg(F.count("*"), F.count("seen")).first()
    before, added = done.count(), {"completed": 0, "latency": None} | dict.fromkeys(TOKENS)
    if total > known:
        pending = report.pending(records, done)
        rows = scoring.predictions(pending, answer(pending)).where("raw_continuation_text is not null")
        told = Observation("appended")
        measures = [F.count(F.lit(1)).alias("completed"), F.sum("request_latency_seconds").alias("latency"), *[F.sum(c).alias(c) for c in TOKENS]]
        rows.observe(told, *measures).write.mode("append").option("ignoreNullFields", "false").json(paths["predictions"])
        added = told.get
    level, mode = settings.get("turn_2_level"), settings.get("mode")
    variant = {"prefill": "B", "single_turn": "C"}[mode]
    about = {k: settings.get(k) for k in SETTINGS} | {
        "matrix_variant": variant,
        "matrix_cell": f"{variant}-L{level}",
        "turn_2_user_sent": conversations.TURN_2[level],
        "output_dir": folder,
        "predictions_path": paths["predictions"],
        "total_examples": total,
        "completed_examples": before + added["completed"],
        "appended_examples": added["completed"],
        "appended_latency_seconds": added["latency"],
        **{f"appended_{c}": added[c] for c in TOKENS},
    }
    files.write_text(spark, paths["summary"], json.dumps(about, ensure_ascii=False, indent=2) + "\n")
    return about


def score(spark: SparkSession, predictions: str, folder: str | None = None) -> dict:
    """Scores a predictions file (or the one in a folder): writes scores.jsonl and score_summary.json to its folder, or
    to another, and returns the summary. The summary is worked out from the written scores, so texts
    are searched once."""
    path = f"{predictions.rstrip('/')}/{cells.PREDICTIONS}" if files.exists(spark, f"{predictions.rstrip('/')}/{cells.PREDICTIONS}") else predictions
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    paths = cells.score_paths(path, folder)
    rows = scoring.score_rows(read_jsonl(spark, path, PREDICTION))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(paths["scores"])
    found = report.score_summaries(spark.read.schema(rows.schema).json(paths["scores"]))
    options = {"ignoreNullFields": "false"}
    head, base = found.select(F.to_json("headline", options), F.to_json("regex_baseline", options)).first()
    return evals.write_score_summary(spark, paths, json.loads(head), json.loads(base))


def rank(spark: SparkSession, root: str, level: int, excluded: list[str] = ()) -> DataFrame:
    """model and rate of the B cells of a level, best first."""
    return report.cell_results(evals.read_cells(spark, root, level, "B").select("cell", "rate"), level, excluded)


def preview(spark: SparkSession, path: str, split: str = "test", start: int = 0, count: int = 1, example_id: str | None = None) -> DataFrame:
    """Records of a dataset's split with their conversation as text: count of them in the file's order, or an id's."""
    rows = read_ordered(spark, cells.split_path(path, files.is_dir(spark, path), split), dataset.SCHEMA)
    if example_id is None:
        found = slice_rows(rows, start, count)
    else:
        found = rows.where(F.col("example_id") == example_id)
        if found.isEmpty():
            raise ValueError(f"no example has the id {example_id!r}")
    shown = conversations.shown(F.col("turn_1_user"), F.col("turn_1_assistant_prefill"))
    return found.select("ordinal", *conversations.METADATA, shown.alias("conversation"))


def generate(spark: SparkSession, name: str, count: int, out: str, seed: int = 20260413, lengths: str | None = None) -> dict:
    """Generates a dataset into a folder: splits, manifest and card; returns the manifest."""
    aimed = dataset.length_overrides(lengths, {d: s[4] for d, s in generation.SIZES.items()})
    rows, rejected, bases = generation.generate(spark, name, count, seed, aimed)
    why = report.rejection_counts(rejected, [*generation.SIZES])
    by: dict[str, dict[str, int]] = {}
    for r in why.collect():  # a row for each difficulty and reason
        by.setdefault(r["difficulty"], {})[r["reason"]] = r["n"]
    configs = {d: dict(zip(("n_symbols", "n_base_ops", "n_derived_ops", "n_transformations"), s[:4], strict=True)) for d, s in generation.SIZES.items()}
    about = dataset.manifest(rows, name, seed, aimed, configs, bases, None, by)
    dataset.write_dataset(rows, out, about, name, "Derivations with an injected error, to be continued.")
    return about


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    p = sub.add_parser("score")
    p.add_argument("predictions")
    p.add_argument("--output-dir")
    p = sub.add_parser("rank")
    p.add_argument("evals")
    p.add_argument("--level", type=int, default=0)
    p = sub.add_parser("preview")
    p.add_argument("dataset")
    p.add_argument("--split", default="test")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--count", type=int, default=1)
    p.add_argument("--id")
    p = sub.add_parser("generate")
    p.add_argument("name")
    p.add_argument("count", type=int)
    p.add_argument("out")
    p.add_argument("--seed", type=int, default=20260413)
    p.add_argument("--lengths")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "score":
        print(json.dumps(score(spark, a.predictions, a.output_dir), ensure_ascii=False, indent=2))
    elif a.what == "rank":
        rank(spark, a.evals, a.level).show(1000, truncate=False)
    elif a.what == "generate":
        print(json.dumps(generate(spark, a.name, a.count, a.out, a.seed, a.lengths), ensure_ascii=False, indent=2))
    else:
        for r in preview(spark, a.dataset, a.split, a.start, a.count, a.id).toLocalIterator():
            print("\n".join(f"{c}: {r[c]}" for c in conversations.METADATA if r[c] is not None), r["conversation"], sep="\n\n", end="\n\n")


if __name__ == "__main__":
    main()
