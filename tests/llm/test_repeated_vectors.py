"""Rows that share an id and differ in vector or label."""

import numpy as np
from derivanta.llm import embedding_dedup


def _lowest(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(int(rng.integers(30)), base[rng.integers(6)] + rng.normal(size=8) * 0.03 * (k % 3), int(rng.integers(2))) for k in range(80)]
    rows += [(40, base[0], 0), (40, base[0] + 1e-4, 0), (40, base[0], 1)]
    unit = [v / np.linalg.norm(v) for _, v, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    n = [sum(i == k for i, _ in pairs) for k in range(len(rows))]
    root = _lowest({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i, j in pairs])
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_links(df).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], n[k], root[r[0]]) for k, r in enumerate(rows))
