import json
from datetime import datetime, timedelta

from derivanta.streaming import log, windows
from pyspark.sql import functions as F

ATTEMPT = "example_id string, attempt long, raw_continuation_text string"


def test_a_stream_restarted_half_way_gives_the_batch_result(spark, tmp_path):
    rows = [(f"e{i % 9}", (i * 7) % 11, None if i % 3 == 0 or i % 9 == 4 else f"t{i * 5 % 13}") for i in range(60)] + [(None, 1, "x")]
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def put(batch, at):
        sink = batch.select("*", F.lit(at).alias("batch"))
        sink.write.mode("append").json(str(out))

    for part in range(4):  # a query of its own for every two files: each goes on from the checkpoint
        for k in (2 * part, 2 * part + 1):
            (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("example_id", "attempt", "raw_continuation_text"), r, strict=True))) for r in rows[k::8]))
        stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).json(str(folder))
        query = log.latest(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = spark.read.schema(f"{log.OUT}, batch long").json(str(out))
    last = told.groupBy("example_id").agg(F.max_by(F.struct("attempt", "raw_continuation_text", "attempts"), "batch").alias("r")).select("example_id", "r.*")
    want = log.latest(spark.createDataFrame(rows, ATTEMPT))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert {r.example_id: r.attempt for r in want.collect()}["e4"] is None and told.count() > 9


def scored(i, hour, minute, good):
    return {"id": i, "t": (datetime(2026, 1, 1) + timedelta(hours=hour, minutes=minute)).isoformat() + "Z", "matches_ground_truth": good, "detected_loose": not good}


def test_late_rows_on_both_sides_of_the_watermark(spark, tmp_path):
    """A row that is late but within the delay counts; one behind the watermark doesn't, nor does it open a window."""
    files = [[scored(1, 0, 10, True), scored(2, 0, 50, False)], [scored(3, 3, 0, True)], [scored(4, 1, 30, True), scored(5, 0, 5, True)], [scored(6, 9, 0, False)], [scored(7, 9, 1, False)]]
    folder = tmp_path / "in"
    folder.mkdir()
    found = {}
    for kind in ("tumbling", "sessions"):
        stream = spark.readStream.schema("id long, t timestamp, matches_ground_truth boolean, detected_loose boolean").json(str(folder))
        made = windows.tumbling(stream, "t", "1 hour", delay="2 hours") if kind == "tumbling" else windows.sessions(stream.withColumn("model", F.concat(F.lit("m"), F.col("id") * 0)), "t", "45 minutes", "model", delay="2 hours")
        for k, rows in enumerate(files):
            (folder / f"{kind}-{k}.json").write_text("\n".join(map(json.dumps, rows)))
            made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / kind)).trigger(availableNow=True).start(str(tmp_path / f"{kind}-out")).awaitTermination()
        for f in folder.iterdir():
            f.unlink()
        out = spark.read.parquet(str(tmp_path / f"{kind}-out"))
        found[kind] = sorted((r.start.hour, r.total, r.correct, r.doubted) for r in out.select(F.to_utc_timestamp("start", "UTC").alias("start"), "total", "correct", "doubted").collect())
    # The watermark is 1:00 when the late ones come: 1:30 counts, and joins a session that is open until 1:35. What 0:05
    # opens would be closed by then, at 1:00 and 0:50.
    assert found["tumbling"] == [(0, 2, 1, 1), (1, 1, 1, 0), (3, 1, 1, 0)]
    assert found["sessions"] == [(0, 3, 2, 1), (3, 1, 1, 0)]


def test_windows_over_a_batch(spark):
    rows = [scored(1, 0, 10, True), scored(2, 0, 50, False), scored(3, 1, 20, True), scored(4, 2, 0, True)]
    df = spark.createDataFrame([(r["id"], r["t"][:-1], r["matches_ground_truth"], r["detected_loose"]) for r in rows] + [(9, None, True, True)], "id long, t string, matches_ground_truth boolean, detected_loose boolean").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.start.minute, (r.end - r.start).seconds // 60, r.total) for r in windows.sessions(df, "t", "45 minutes").collect()) == [(10, 155, 4)]
    assert sorted((r.start.minute, (r.end - r.start).seconds // 60, r.total) for r in windows.sessions(df, "t", "35 minutes").collect()) == [(0, 35, 1), (10, 35, 1), (50, 65, 2)]
    sliding = windows.tumbling(df, "t", "1 hour", slide="30 minutes").collect()
    assert sum(r.total for r in sliding) == 8 and len(sliding) == 6
