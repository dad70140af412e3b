import json

import pytest
from derivanta import runs
from derivanta.operators import report
from derivanta.operators.numbering import numbered
from derivanta.sources import evals, files, jsonl
from derivanta.sources.scratch import Scratch
from pyspark.sql import functions as F

RECORD = "example_id string, base_id string, difficulty string, error_type string, ground_truth_final_output string, wrong_branch_final_output string, chain_length_x int, prefill_error_step int, turn_1_user string, turn_1_assistant_prefill string"


def records(spark, ids):
    return spark.createDataFrame([(i, "b", "easy", "E", "x", "y", 6, 3, "u", "p") for i in ids], RECORD)


def answers(spark, texts):
    rows = [(i, t, "prefill", "go", 0, "r", 0.5, "m", "p", "api", (7, None, None, 9)) for i, t in texts]
    return spark.createDataFrame(rows, "example_id string, raw_continuation_text string, mode string, turn_2_user_sent string, turn_2_level int, response_id string, request_latency_seconds double, model string, provider string, api_model string, usage struct<input_tokens: bigint, output_tokens: bigint, reasoning_tokens: bigint, total_tokens: bigint>")


SETTINGS = {"model": "m", "mode": "single_turn", "turn_2_level": 1, "max_output_tokens": 100}


def test_a_run_is_resumed(spark, tmp_path):
    folder = str(tmp_path / "m-C-L1")
    reply = answers(spark, [("a", "Final Output: x"), ("b", None), ("c", "Final Output: y"), ("other", "z")])
    asked = []

    def answer(pending):
        asked.append(sorted(r.example_id for r in pending.select("example_id").collect()))
        return reply

    first = runs.evaluate(records(spark, "ab"), answer, folder, SETTINGS)
    assert (first["total_examples"], first["completed_examples"], first["appended_input_tokens"], first["appended_reasoning_tokens"]) == (2, 1, 7, None)
    second = runs.evaluate(records(spark, "abc"), answer, folder, SETTINGS)
    assert (second["total_examples"], second["completed_examples"], second["appended_examples"]) == (3, 2, 1)
    third = runs.evaluate(records(spark, "ac"), answer, folder, SETTINGS)  # nothing is left: nobody is asked
    assert (third["total_examples"], third["completed_examples"], third["appended_examples"]) == (2, 2, 0)
    assert asked == [["a", "b"], ["b", "c"]]
    assert third["matrix_variant"] == "C" and third["matrix_cell"] == "C-L1" and third["turn_2_user_sent"].startswith("Please continue. Double")
    assert json.loads((tmp_path / "m-C-L1" / "summary.json").read_text()) == third
    anew = runs.evaluate(records(spark, "a"), answer, folder, SETTINGS, resume=False)
    assert (anew["completed_examples"], anew["appended_examples"]) == (1, 1)


def test_a_run_goes_on_from_a_single_file(spark, tmp_path):
    (tmp_path / "predictions.jsonl").write_text('{"example_id": "a"}\n\n{"example_id": "a"}\n{"example_id": "gone"}\n')
    done = runs.evaluate(records(spark, "ab"), lambda pending: answers(spark, [("a", "t"), ("b", "t")]), str(tmp_path), SETTINGS)
    assert (done["total_examples"], done["completed_examples"], done["appended_examples"]) == (2, 3, 1)
    assert sorted(r.example_id for r in jsonl.read_jsonl(spark, str(tmp_path / "predictions.jsonl")).collect()) == ["a", "a", "b", "gone"]


def test_what_a_run_needs(spark, tmp_path):
    with pytest.raises(ValueError, match="turn_1_user"):
        runs.evaluate(records(spark, "a").drop("turn_1_user"), lambda p: p, str(tmp_path), SETTINGS)
    none = runs.evaluate(records(spark, ""), lambda p: p, str(tmp_path / "x"), SETTINGS)
    assert (none["total_examples"], none["completed_examples"]) == (0, 0)


def predictions(spark, path, texts):
    row = lambda i, d, t: {"example_id": f"e{i}", "difficulty": d, "chain_length_x": 6, "prefill_error_step": 3, "ground_truth_final_output": "x", "wrong_branch_final_output": "y", "raw_continuation_text": t, "model": "m", "provider": "p", "mode": "prefill"}
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(row(i, d, t)) + "\n" for i, (d, t) in enumerate(texts)))


def test_scores_of_a_file(spark, tmp_path):
    predictions(spark, tmp_path / "predictions.jsonl", [("easy", "Final Output: x"), ("easy", "Wait, step 3 is wrong.\nFinal Output: x"), ("hard", "Final Output: y"), ("hard", "nothing")])
    about = runs.score(spark, str(tmp_path))
    assert about["headline"] == {"total": 4, "final_answer_correct_rate": 0.5, "by_difficulty": {"easy": {"total": 2, "final_answer_correct_rate": 1.0}, "hard": {"total": 2, "final_answer_correct_rate": 0.0}}}
    base = about["regex_baseline"]
    assert base["outcome_buckets"] == {"detect_recover": 1, "silent_recovery": 1, "detect_only": 0, "blind_wrong_branch": 1, "off_rails": 0, "extraction_failed": 1}
    assert base["rates"] == {"self_detection_loose": 0.25, "self_detection_strict": 0.25, "final_answer_recovery": 0.5, "blind_cascade": 0.25, "extraction_ok": 0.75}
    assert base["by_difficulty"]["hard"]["_total"] == 2 and base["by_difficulty"]["hard"]["extraction_failed"] == 1
    assert json.loads((tmp_path / "score_summary.json").read_text()) == about and about["headline_kind"] == "final_output_only"
    assert len(spark.read.json(str(tmp_path / "scores.jsonl")).collect()) == 4
    other = runs.score(spark, str(tmp_path / "predictions.jsonl"), str(tmp_path / "else"))
    assert other["scores_path"] == f"{tmp_path}/else/scores.jsonl" and other["headline"] == about["headline"]
    with pytest.raises(FileNotFoundError):
        runs.score(spark, str(tmp_path / "none.jsonl"))


def test_scores_of_no_rows(spark, tmp_path):
    (tmp_path / "predictions.jsonl").write_text("\n")
    about = runs.score(spark, str(tmp_path))
    assert about["headline"] == {"total": 0, "final_answer_correct_rate": 0.0, "by_difficulty": {}}
    assert set(about["regex_baseline"]["rates"].values()) == {0.0} and about["regex_baseline"]["by_difficulty"] == {}


def test_headline_counts_in_one_pass(spark):
    rows = spark.createDataFrame([("all", True), ("easy", False), (None, True), (None, None)], "difficulty string, matches_ground_truth boolean")
    got = sorted(map(tuple, report.headline(rows).collect()), key=repr)
    assert got == sorted([("all", 4, 2), ("all", 1, 1), ("easy", 1, 0), (None, 2, 1)], key=repr)
    assert [tuple(r) for r in report.headline(rows.limit(0)).collect()] == [("all", 0, 0)]
    plan = report.headline(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type as difficulty", "event_id > 3 as matches_ground_truth"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_tree_of_evaluations(spark, tmp_path):
    root = tmp_path / "my evals+%41"  # names that URLs escape
    ok = lambda r: json.dumps({"headline": {"total": 3, "final_answer_correct_rate": r, "by_difficulty": {"easy": {"total": 3, "final_answer_correct_rate": r}}}})
    cells = {"m a-B-L0": ok(0.25), "b-B-L0": ok(0.5), "b-B-L1": ok(0.75), "c-4096-B-L0": ok(0.9), "d-B-L0": "{", "e-B-L0": "{}", "f-B-L0": json.dumps({"headline": {"final_answer_correct_rate": None}}), "g-B-L0": None, "h-C-L0": ok(0.1), "b-B-L0-B-L0": ok(0.5), "odd": ok(1.0)}
    for name, text in cells.items():
        (root / name).mkdir(parents=True)
        (root / name / "predictions.jsonl").write_text("x\n")
        if text:
            (root / name / "score_summary.json").write_text(text)
    got = {r.cell: r for r in evals.read_cells(spark, str(root)).collect()}
    assert {c: r.status for c, r in got.items()} == {c: {"d-B-L0": "no JSON", "e-B-L0": "no rate", "f-B-L0": "no rate", "g-B-L0": "no summary"}.get(c, "ok") for c in cells if c != "odd"}
    one = got["m a-B-L0"]
    assert (one.model, one.variant, one.level, one.total, one.rate, one.by_difficulty["easy"].total) == ("m a", "B", 0, 3, 0.25, 3)
    assert got["b-B-L0-B-L0"].model == "b-B-L0"
    assert [tuple(r) for r in runs.rank(spark, str(root), 0).collect()] == [("b", 0.5), ("b-B-L0", 0.5), ("m a", 0.25)]
    assert [tuple(r) for r in runs.rank(spark, str(root), 0, ["b"]).collect()] == [("b-B-L0", 0.5), ("m a", 0.25)]
    assert evals.read_cells(spark, str(root), level=7).collect() == [] and evals.read_cells(spark, str(tmp_path / "none")).collect() == []
    assert {r.status for r in evals.read_cells(spark, str(root), 0, "B").where("cell = 'g-B-L0'").collect()} == {"no summary"}


def test_lines_of_a_file_of_several_splits(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    lines = [json.dumps({"example_id": f"e{i}", "raw_continuation_text": "é" * (i % 97)}) if i % 5 else ("" if i % 2 else " \t") for i in range(4000)]
    path.write_text("\n".join(lines))
    want = [json.loads(x)["example_id"] for x in lines if x.strip()]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = jsonl.read_ordered(spark, str(path)).select("example_id", "ordinal")
        assert rows.rdd.getNumPartitions() > 1
        assert [r.example_id for r in rows.orderBy("ordinal").collect()] == want
        for start, count in ((0, 1), (17, 40), (3190, 50), (9999, 1), (0, None)):
            got = [r.example_id for r in jsonl.slice_rows(rows, start, count).orderBy("ordinal").collect()]
            assert got == want[start : None if count is None else start + count]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for wrong in ({"start": -1}, {"count": 0}):
        with pytest.raises(ValueError):
            jsonl.slice_rows(rows, **wrong)


def test_previews(spark, tmp_path):
    rows = [{"example_id": f"e{i}", "split": "test", "turn_1_user": f"u{i}", "turn_1_assistant_prefill": "p"} for i in (3, 1, 2)]
    (tmp_path / "test.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.example_id for r in runs.preview(spark, str(tmp_path)).collect()] == ["e3"]
    assert [r.example_id for r in runs.preview(spark, str(tmp_path), start=1, count=9).orderBy("ordinal").collect()] == ["e1", "e2"]
    one = runs.preview(spark, str(tmp_path / "test.jsonl"), example_id="e2").first()
    assert one.conversation.startswith("=== TURN 1 USER ===\nu2\n") and one.ordinal == 2
    with pytest.raises(ValueError, match="no example"):
        runs.preview(spark, str(tmp_path), example_id="e9")


def test_commands(spark, tmp_path, capsys):
    predictions(spark, tmp_path / "m-B-L0" / "predictions.jsonl", [("easy", "Final Output: x")])
    runs.main(["score", str(tmp_path / "m-B-L0")])
    assert json.loads(capsys.readouterr().out)["headline"]["total"] == 1
    runs.main(["rank", str(tmp_path)])
    assert "|m    |1.0 |" in capsys.readouterr().out


def test_numbers_of_a_hot_group(spark):
    scratch = Scratch(spark, "test")
    rows = scratch.save(spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 3001).alias("k"), "id"), "rows")
    got = numbered(rows, "g", ["k", "id"], scratch).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for own in by.values():
        assert [r.place for r in sorted(own, key=lambda r: (r.k is not None, r.k or 0, r.id))] == list(range(len(own))) and {r.n for r in own} == {len(own)}
    assert numbered(scratch.save(rows.limit(0), "none"), None, ["k"], scratch).collect() == []


def test_files(spark, tmp_path):
    assert not files.exists(spark, str(tmp_path / "x")) and not files.is_dir(spark, str(tmp_path / "x"))
    files.write_text(spark, str(tmp_path / "x"), "ü\n")
    assert (tmp_path / "x").read_text() == "ü\n" and files.exists(spark, str(tmp_path / "x")) and not files.is_dir(spark, str(tmp_path / "x"))
