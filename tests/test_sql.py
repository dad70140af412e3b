from derivanta import sql
from derivanta.operators import report
from derivanta.functions.scoring import score


def rows(spark):
    text = lambda i: f"Step 1: (a # b) = c    [by # table]\nStep 2: c = {i % 3}\nFinal Output: {'xyz'[i % 3]}"
    return spark.createDataFrame([(f"e{i}", f"m{i % 4}", "easy" if i % 2 else "hard", "x", "y", 2, text(i)) for i in range(60)], "example_id string, model string, difficulty string, ground_truth_final_output string, wrong_branch_final_output string, prefill_error_step int, raw_continuation_text string")


def test_ranked_equals_the_leaderboard(spark):
    df = rows(spark)
    sql.register(df)
    want = sorted((r.model, r.correct, r.total, r.place) for r in report.leaderboard(score(df)).collect())
    got = spark.sql("select model, correct, total, place from ranked(null)").collect()
    assert sorted(map(tuple, got)) == want
    easy = spark.sql("select sum(total) as n, max(share) as s from ranked('easy')").first()
    assert easy.n == 30 and 0 < easy.s < 1
    assert spark.sql("select sum(n) from outcomes('m1')").first()[0] == 15 and spark.sql("select share(1, 4), share(3, 0)").first()[:] == (0.25, 0.0)
    assert spark.sql("select count(*), max(step_number) from step_lines where after = 'c' or before = 'c'").first()[:] == (120, 2)
    sql.register(df.limit(0))
    assert spark.sql("select * from ranked(null)").collect() == []
