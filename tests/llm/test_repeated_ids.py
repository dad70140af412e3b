"""Rows that share an id and differ in text."""

import random

from derivanta.llm import minhash

_rng = random.Random(8)


def _text():
    return " ".join(f"w{_rng.randrange(5000)}" for _ in range(60))


def _lowest(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates(spark):
    a, b, c, d = (_text() for _ in range(4))
    near = lambda t: t + " tail"
    rows = [(1, a), (5, a), (5, b), (7, b), (8, near(b)), (9, c), (9, c), (20, near(c)), (20, d), (3, near(d)), (30, _text()), (30, None), (31, ""), (None, a)]
    links = [(1, 5), (5, 7), (7, 8), (5, 8), (9, 20), (3, 20)]
    root = _lowest([i for i, _ in rows if i is not None], links)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, root.get(i, -1)) for i, _ in rows)
