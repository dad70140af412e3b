"""Names of evaluation cells, their folders and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of files in a cell's folder.
PREDICTIONS, SUMMARY, SCORES, SCORE_SUMMARY = "predictions.jsonl", "summary.json", "scores.jsonl", "score_summary.json"


def variant(mode: Column) -> Column:
    """B for a prefilled conversation, C for a single turn; any other mode fails the job."""
    return F.when(mode == "prefill", "B").when(mode == "single_turn", "C").otherwise(F.raise_error(F.concat(F.lit("unsupported mode: "), F.coalesce(mode, F.lit("null")))).cast("string"))


def cell(mode: Column, level: Column) -> Column:
    return F.concat(variant(mode), F.lit("-L"), level.cast("string"))


def slug(model: Column, effort: Column) -> Column:
    """A model's key as a folder name, with the effort asked for, if any."""
    return F.concat(F.replace(model, F.lit("/"), F.lit("-")), F.coalesce(F.concat(F.lit("-reasoning-"), effort), F.lit("")))


def output_dir(model: Column, mode: Column, effort: Column, level: Column, root: str = "artifacts/evals") -> Column:
    return F.concat(F.lit(f"{root}/"), slug(model, effort), F.lit("-"), cell(mode, level))


def split_path(path: str, is_dir: bool, split: str = "test") -> str:
    """A split's file in a dataset's folder; a path to a file stays."""
    return f"{path.rstrip('/')}/{split}.jsonl" if is_dir else path


def eval_paths(folder: str) -> dict[str, str]:
    return {"predictions": f"{folder}/{PREDICTIONS}", "summary": f"{folder}/{SUMMARY}"}


def score_paths(predictions: str, folder: str | None = None) -> dict[str, str]:
    """Where scores of a predictions file go: to its own folder unless another is named."""
    folder = predictions.rpartition("/")[0] if folder is None else folder
    return {"predictions": predictions, "summary": f"{folder}/{SUMMARY}", "scores": f"{folder}/{SCORES}", "score_summary": f"{folder}/{SCORE_SUMMARY}"}
