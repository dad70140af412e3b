"""Nulls, repeated rows, clashing names, long texts and empty tables for the operators on texts and vectors."""

import numpy as np
import pytest
from derivanta.llm import chat_format, embedding_dedup, line_dedup, nearest
from pyspark.sql import functions as F


def lines_of(rows, least=10):
    """Rows (id, text) by the contract of line dedup: (text, lines, dropped)."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owners = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                owners.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if i is None or len(key(x)) < least or len(owners[key(x)]) < 2 or min(owners[key(x)]) == i]
        out.append((i, t if len(kept) == len(parts) else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_line_dedup(spark, kind):
    a, b = "a line that comes often", "another line of some length"
    rows = [(4, f"{a}\nown line of four, long\n{b}"), (2, f" {a.upper()}\t\nshort\n{a}"), (None, f"{a}\n{b}"), (9, b), (9, f"{b}\nx"), (9, f"{b}\nx"), (7, None), (8, ""), (5, "short\nshort"), (6, f"{a}\n\n{a}\nend of the sixth one"), (3, "é" * 9), (1, "é" * 9), (10, "é" * 10), (11, "é" * 10)]
    rows = [(i if i is None or kind == "long" else f"{i:03}", t) for i, t in rows]
    frame = spark.createDataFrame([(*x, 1, "x", 3, 4) for x in rows], f"doc_id {kind}, text string, doc int, `drop` string, n_lines int, _doc int")
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "doc", "drop", "_doc", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == lines_of(rows)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_of_one_id_with_several_texts(spark):
    """Each row loses its own repeated lines only, place by place."""
    rows = [(1, "alpha alpha alpha"), (2, "alpha alpha alpha"), (2, "a unique line of its own"), (2, "one more line of its own\nalpha alpha alpha\nlast line of that row"), (2, None), (3, "a unique line of its own\nx")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == lines_of(rows)
    assert ("a unique line of its own", 0) in {(r.text, r.n_dropped) for r in got if r.doc_id == 2}


def test_line_dedup_of_a_long_text(spark):
    text = "\n".join(f"this is line number {i // 2 if i % 2 else -i}" for i in range(100_000))
    other = "\n".join(f"this is line number {i}" for i in range(50_000))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, other), (2, text)], "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[2].n_lines == 100_000
    assert [(2, got[2].text, 100_000, got[2].n_dropped)] == lines_of([(1, other), (2, text)])[1:]


def test_chat_of_long_roles_and_texts(spark):
    rows = [(1, 0, "r" * 1_000_000, "t" * 1_000_000), (2, 0, "<\n|" * 100_000, "<|" * 300_000), (3, 0, "a<|nl|>\nb<%|", "\n" * 1_000_000), (4, 1, None, None), (4, None, "assistant", "<|im_end|>\n<|im_start|>"), (None, 0, "user", "x"), (4, 1, None, None)]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn int, role string, text string, turns int, formatted int")
    got = {r.conv_id: r for r in chat_format.format_chats(frame).collect()}
    assert [[(t.role, t.text) for t in got[i].turns] for i in (1, 2, 3)] == [[(r[2], r[3])] for r in rows[:3]]
    assert [(t.role, t.text) for t in got[4].turns] == [("assistant", "<|im_end|>\n<|im_start|>"), ("", ""), ("", "")] and got[4].loss_text == "<|im_end|>\n<|im_start|>"
    assert got[None].formatted == "<|im_start|>user\nx<|im_end|>\n" and got[None].level == 0
    assert chat_format.format_chats(frame.limit(0)).count() == 0


VECTORS = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.01], 1), (9, [1.0, 0.01], 1), (10, [0.0, 1.0], None), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1)]


def frame_of_vectors(spark):
    return spark.createDataFrame([(*x, 1, 2, "v") for x in VECTORS], "vec_id long, embedding array<double>, label int, rep int, dim int, v string")


def test_embedding_dedup(spark):
    rows = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_links(frame_of_vectors(spark)).collect()]
    want = [(1, 3, 1), (2, 3, 1), (9, 3, 1), (9, 3, 1), *((i, 0, i) for i in (3, 4, 5, 6, 7, 8, 10, 11, 12)), (None, 0, None)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert embedding_dedup.embedding_links(frame_of_vectors(spark).limit(0)).count() == 0


def test_nearest(spark):
    vectors = frame_of_vectors(spark)
    got = [tuple(r) for r in nearest.nearest(vectors, vectors.where("vec_id in (1, 5, 11, 9) or vec_id is null"), k=2).orderBy("query_id", "rank").collect()]
    near = 1 / np.sqrt(1 + 1e-4)
    assert [r[:3] for r in got] == [(1, 1, 2), (1, 2, 3), (9, 1, 1), (9, 2, 2)]
    assert np.allclose([r[3] for r in got], [1, 1, near, near], atol=1e-15)
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0 and nearest.nearest(vectors, vectors.limit(0)).count() == 0


def test_nearest_merges_by_levels(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 16)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    monkeypatch.setattr(nearest, "FAN", 3)
    monkeypatch.setattr(nearest, "ASKED", 7)
    x = np.random.default_rng(1).normal(size=(300, 4))
    x[200:240] = x[:40] * 2.0  # ties, as doubling is exact
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(vectors, vectors.where("vec_id % 9 = 0"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 300, 9):
        if x[q].any():
            score = {i: (v @ x[q]) / np.sqrt((v @ v) * (x[q] @ x[q])) for i, v in enumerate(x) if v.any() and i != q}
            assert got[q] == sorted(score, key=lambda i: (-round(score[i], 12), i))[:4]


def test_input_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g", 1)], "doc_id long, text string, h long")
    assert line_dedup.dedup_lines(rows.withColumn("doc", F.lit(1)).withColumn("doc_", F.lit(2))).columns[:5] == ["doc_id", "text", "h", "doc", "doc_"]
