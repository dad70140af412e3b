import random
import re
from collections import Counter

import pytest
from derivanta.llm import repetition
from pyspark.sql import functions as F


def plain(text, window, least):
    """By looking at every run of words."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    many = Counter(tuple(w[i : i + window]) for i in range(n - window + 1))
    repeated = {j for i in range(n - window + 1) if many[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
    places = {}
    for i in range(n):
        for j in range(i + least, n + 1):
            places.setdefault(tuple(w[i:j]), []).append(i)
    lengths, covered = [], set()
    for run, at in places.items():
        left = {w[i - 1] if i else None for i in at}
        right = {w[i + len(run)] if i + len(run) < n else None for i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            lengths.append(len(run))
            covered |= {j for i in at for j in range(i, i + len(run))}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(lengths), max(lengths, default=0), len(covered)


def test_measure_equals_a_plain_search():
    random.seed(3)
    for _ in range(150):
        batch = ["".join(random.choice(letters) + random.choice([" ", "  ", "\n", " \n", "\t", " ", ""]) for _ in range(random.randint(0, 30))) for letters in random.choices(["ab", "abc", "abcdefgh", "a", "aé#"], k=random.randint(1, 6))]
        got = repetition.measure(batch, 3, 2)
        assert list(zip(*[got[c].tolist() for c in repetition._COUNTS], strict=True)) == [plain(t, 3, 2) for t in batch]


def test_verdicts(spark):
    own = [f"w{i}" for i in range(400)]
    texts = {
        1: " ".join(own),  # nothing repeats
        2: " ".join(own + own[100:119]),  # 19 words: below the least repeat
        3: " ".join(own + own[100:130]),  # 60 of 430 words: covers over 10 %
        4: " ".join([f"v{i}" for i in range(2000)] + own[:50] + ["x"] + own[:50]),  # 50 words, 5 %
        5: " ".join([f"v{i}" for i in range(2000)] + own[:51] + ["x"] + own[:51]),  # a repeat of 51 words
        6: "one two three",
        7: None,
        8: "",
        9: "same " * 20_000,
    }
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    assert [i for i, r in got.items() if r.kept] == [1, 2, 4]
    assert [i for i, r in got.items() if r.base_failed] == [6, 7, 8, 9]
    assert (got[5].longest_repeat, got[5].covered_words, got[5].n_repeats) == (51, 102, 1)
    assert (got[9].n_words, got[9].n_repeat_words, got[9].longest_repeat) == (20_000, 20_000, 19_999)
    assert got[7].n_words == got[8].n_words == 0


def test_rows_are_judged_alone(spark):
    """Null and repeated ids, clashing names, a very long text, an empty table."""
    long_text = " ".join(str(i) for i in range(200_000))
    docs = spark.createDataFrame([(None, "a b"), (1, long_text), (1, "c d"), (1, long_text)], "doc_id long, text string")
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(3)).withColumn("`odd` name", F.lit(1))
    got = repetition.repetition_rules(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 2, False), (1, 2, False), (1, 200_000, True), (1, 200_000, True)]
    assert repetition.repetition_rules(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_one_word_over_and_over(n):
    """All suffixes tie until their ends: each doubling halves what is left."""
    got = repetition.measure(["x " * n, "x " * n], 5, 1)
    assert got["longest_repeat"].tolist() == [n - 1] * 2 and got["n_repeats"].tolist() == [n - 1] * 2
