import public_tokenizers
from derivanta.llm import token_files
from pyspark.sql import functions as F


def test_starts_under_the_session_s_writer_settings(spark, tmp_path):
    """A limit on the rows of a file doesn't split a task's running sum; clashing and repeated ids and nulls stay."""
    rows = [(i, "one two three four") for i in range(12)] + [(None, "a"), (5, "a"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("local_start", F.lit(2))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        token_files.write_token_ids(docs, str(tmp_path / "out"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN, end_id=1, partitions=3)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted(token_files.read_token_ids(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 9, 10, 11]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens


def test_files_of_six_digits(spark, tmp_path):
    """Names are ordered by the task's number, not as text."""
    for number, ids in ((99_999, [7, 1]), (100_000, [8, 9, 1])):
        spark.createDataFrame([(number, 0, len(ids), ids)], "doc_id long, local_start long, n_tokens long, ids array<int>").coalesce(1).write.orc(str(tmp_path / "one"), mode="overwrite")
        part = next((tmp_path / "one").glob("part-*.orc"))
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / part.name.replace("part-00000", f"part-{number:05d}"))
    got = {r.doc_id: r.start for r in token_files.read_token_ids(spark, str(tmp_path / "all")).collect()}
    assert got == {99_999: 0, 100_000: 2}
