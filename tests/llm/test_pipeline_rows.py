"""The pipeline's stages on rows with null and repeated ids, and on emptied documents."""

import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_row_by_row(spark, tmp_path):
    rng = random.Random(6)
    good = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    junk = lambda: good().upper().replace(" ", "!! ")
    rows = [(i, good() if i < 300 else junk()) for i in range(400)]
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(None, good()), (600, good()), (600, good()), (700, None)]
    gone = [(None, junk()), (600, junk())]
    df = spark.createDataFrame([(i, t, None if i == 600 else "en", "s", 1) for i, t in rows + kept + gone], COLUMNS)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, df, str(tmp_path)).collect()]
    assert [x for x in kept[:3] if out.count(x) != 1] == [] and [x for x in gone if x in out] == []
    assert len([i for i, _ in out if i is not None and i < 300]) >= 295


def test_emptied_documents_go(spark):
    line = "a line that documents share"
    texts = [line, line, f"{line}\n\n{line}\n", f" \t{line}\n\t\x0b\x0c\r ", f"{line}\n\xa0", f"{line}\nshort", "\n\t\n", "", None]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    out = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert out == {0: line, 4: "\xa0", 5: "short", 6: "\n\t\n", 7: "", 8: None}
