"""Evaluations as a tree of folders: one for each cell, named <model>-<B or C>-L<level>."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from . import files

#: The parts of a score summary that reports read.
SUMMARY = "headline struct<total: bigint, final_answer_correct_rate: double, by_difficulty: map<string, struct<total: bigint, final_answer_correct_rate: double>>>"
_CELL = r"^([^/]+)-([BC])-L([0-9]+)/"


def _inside(spark: SparkSession, root: str) -> Column:
    """The path of a row's file below root, without the escapes of a URL."""
    top = files.qualified(spark, root).rstrip("/")
    path = F.col("_metadata.file_path")
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    # file:/x and file:///x name one file.
    short = lambda p: F.regexp_replace(p, "^([a-z0-9]+:)/+", "$1/")
    return F.substr(short(plain), F.char_length(short(F.lit(top))) + 2)


def read_cells(spark: SparkSession, root: str, level: int | None = None, variant: str | None = None) -> DataFrame:
    """cell, model, variant, level, total, rate, by_difficulty and status of each cell folder below root that holds
    a file: its score summary's headline, and whether there is one.

    status: "ok", "no summary" (of scores), "no JSON" (that can be read) or "no rate" (in its
    headline). Only folders of the level and variant asked for are listed; of other files than
    summaries, only names are read. No such folder: no rows.
    """
    pattern = f"{root.rstrip('/')}/*-{variant or '[BC]'}-L{'[0-9]*' if level is None else level}"
    schema = "cell string, model string, variant string, level int, total bigint, rate double, by_difficulty map<string, struct<total: bigint, final_answer_correct_rate: double>>, status string"
    if not files.matches(spark, f"{pattern}/*"):
        return spark.createDataFrame([], schema)
    path = _inside(spark, root)
    found = spark.read.format("binaryFile").load(f"{pattern}/*").select(F.regexp_extract(path, "^[^/]+", 0).alias("cell"), path.alias("path"))
    every = found.where(F.col("path").rlike(_CELL)).groupBy("cell").agg(F.first("path").alias("path"))
    part = lambda k: F.regexp_extract("path", _CELL, k)
    named = every.select("cell", part(1).alias("model"), part(2).alias("variant"), part(3).cast("int").alias("level"))
    if not files.matches(spark, f"{pattern}/{cells.SCORE_SUMMARY}"):
        return named.select("*", F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("map<string, struct<total: bigint, final_answer_correct_rate: double>>").alias("by_difficulty"), F.lit("no summary").alias("status"))
    texts = spark.read.text(f"{pattern}/{cells.SCORE_SUMMARY}", wholetext=True)
    parsed = texts.select(F.regexp_extract(path, "^[^/]+", 0).alias("cell"), F.try_parse_json("value").isNotNull().alias("json"), F.from_json("value", SUMMARY).alias("s"))
    head = F.col("s.headline")
    told = parsed.select("cell", head["total"].alias("total"), head["final_answer_correct_rate"].alias("rate"), head["by_difficulty"].alias("by_difficulty"), "json")
    status = F.when(F.col("json").isNull(), "no summary").when(~F.col("json"), "no JSON").when(F.col("rate").isNull(), "no rate").otherwise("ok")
    return named.join(told, "cell", "left").withColumn("status", status).drop("json")


def write_score_summaries(summaries: DataFrame, root: str) -> int:
    """Writes a score_summary.json into the folder of each row's cell, and returns how many.

    summaries: cell, headline, regex_baseline (see report.score_summaries), a few rows, one a cell.
    """
    spark = summaries.sparkSession
    options = {"ignoreNullFields": "false"}
    rows = summaries.select("cell", F.to_json("headline", options).alias("headline"), F.to_json("regex_baseline", options).alias("baseline"))
    n = 0
    for r in rows.toLocalIterator():
        paths = cells.score_paths(f"{root.rstrip('/')}/{r['cell']}/{cells.PREDICTIONS}")
        write_score_summary(spark, paths, json.loads(r["headline"]), json.loads(r["baseline"]))
        n += 1
    return n


def write_score_summary(spark: SparkSession, paths: dict[str, str], headline: dict, baseline: dict) -> dict:
    """Writes one summary of scores and returns it."""
    about = {"predictions_path": paths["predictions"], "scores_path": paths["scores"], "headline": headline, "headline_kind": "final_output_only", "regex_baseline": baseline}
    files.write_text(spark, paths["score_summary"], json.dumps(about, ensure_ascii=False, indent=2) + "\n")
    return about
