"""Scores over a folder that grows."""

import json
import uuid

from derivanta.sources.jsonl import PREDICTION, append_jsonl, read_jsonl
from derivanta.streaming.scores import score_stream
from pyspark.sql import functions as F


def lines(ids, hour):
    return "\n\n".join(json.dumps({"example_id": i, "difficulty": "easy", "prefill_error_step": 2, "ground_truth_final_output": "a", "wrong_branch_final_output": "b", "raw_continuation_text": "Final Output: a", "sent": f"2026-01-01T{hour:02}:00:00Z"}) for i in ids) + "\n"


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for time_col in (None, "sent"):
        name = f"scores_{uuid.uuid4().hex}"
        stream = score_stream(spark, str(folder), time_col, "2 hours", f"{PREDICTION}, sent timestamp")
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            for k, (ids, hour) in enumerate(((["x", "y"], 1), (["y", "z"], 2), (["z"], 2))):
                (folder / f"{name}-{k}.json").write_text(lines([f"{name}{i}" for i in ids], hour))
                query.processAllAvailable()
        finally:
            query.stop()
        got = spark.table(name).where(F.col("example_id").startswith(name)).collect()
        assert sorted(r.example_id[-1] for r in got) == ["x", "y", "z"] and all(r.outcome_bucket == "silent_recovery" for r in got)


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([("é", 3)], "example_id string, chain_length_x int")
    for _ in range(2):
        append_jsonl(rows, str(tmp_path / "out"))
    assert [(r.example_id, r.chain_length_x, r.model) for r in read_jsonl(spark, str(tmp_path / "out")).collect()] == [("é", 3, None)] * 2
