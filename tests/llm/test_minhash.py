"""Near-duplicates: shingle sets, registers, recall at the threshold, large groups, odd rows."""

import random

import numpy as np
import pytest
from derivanta.llm import minhash


def plain_sets(texts, words):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        n = min(words, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def plain_components(rows, words, percent=80):
    """rows: (id, text) -> the least id reachable, for each row."""
    sets, up = plain_sets([t for _, t in rows], words), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [None if k is None else least[find(i)] for i, (k, _) in enumerate(rows)], [len(s) for s in sets]


def flat(texts):
    raw = [t.encode() for t in texts]
    return b"".join(raw), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("words", [1, 2, 5])
def test_sets(words, monkeypatch):
    r = random.Random(words)
    texts = ["", " ", "a", "A a", "x" * 300 + " " + "x" * 300 + " " + "x" * 299 + "y", "é É\x0bé b", "a b c d e", "a b c d e f a b c d e f", *(" ".join(r.choices("abcdef", k=r.randint(0, 40))) for _ in range(60))]
    for window in (1 << 20, 7):
        monkeypatch.setattr(minhash, "_WINDOW", window)
        values, bounds = minhash.shingle_sets(*flat(texts), words)
        seen = {}
        for i, s in enumerate(plain_sets(texts, words)):
            own = values[bounds[i] : bounds[i + 1]]
            assert len(own) == len(s) and (own[1:] > own[:-1]).all()
            assert seen.setdefault(frozenset(s), own.tobytes()) == own.tobytes()
        assert len({v for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("n", [9, 45, 180, 900, 9000])
def test_recall_at_the_threshold(n):
    """Pairs of intersection / union of exactly 0.8: nearly all share a band, and the estimate keeps them."""
    rng = np.random.default_rng(n)
    trials = 400 if n < 5000 else 100
    both, one = n * 8 // 9, n // 9
    a, b = [], []
    for _ in range(trials):
        x = rng.integers(0, 1 << 63, both + 2 * one, dtype=np.uint64) * np.uint64(2)
        a.append(np.sort(x[: both + one]))
        b.append(np.sort(np.concatenate([x[:both], x[both + one :]])))
    size = both + one
    bounds = np.arange(trials + 1) * size
    ra, rb = (minhash.registers(np.concatenate(s), bounds) for s in (a, b))
    same = ra == rb
    assert same.reshape(trials, -1, minhash.ROWS).all(axis=2).any(axis=1).all()
    chance = minhash.chances(np.full(trials, size))
    estimate = minhash.similarity(same.mean(axis=1), chance, chance)
    exact = both / (both + 2 * one)
    assert abs(estimate.mean() - exact) < 0.02
    if size > minhash.SMALL:
        assert estimate.std() <= minhash.SLACK / 5 * 1.1 and (estimate >= 0.8 - minhash.SLACK).all()


def test_large_group_of_near_copies(spark, monkeypatch):
    """Keys above LARGE go through centres; blocks of few members; the components stay those of all pairs."""
    monkeypatch.setattr(minhash, "LARGE", 8)
    monkeypatch.setattr(minhash, "BLOCK", 6)
    r = random.Random(8)
    rows, at = [], 0
    for _ in range(3):
        base = [f"w{r.randrange(5000)}" for _ in range(60)]
        for _ in range(40):
            own = [w if r.random() > 0.035 else f"w{r.randrange(5000)}" for w in base]
            rows.append((at, " ".join(own)))
            at += 1
    rows += [(at + i, " ".join(f"w{r.randrange(5000)}" for _ in range(50))) for i in range(20)]
    r.shuffle(rows)
    want, n = plain_components(rows, 2)
    assert 3 < len(set(want)) < 100
    got = {x.doc_id: x for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert [got[k].component_id for k, _ in rows] == want and [got[k].n_shingles for k, _ in rows] == n


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_rows(spark, kind):
    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(9, a, 1), (3, a.upper(), 1), (None, a, 1), (None, None, 1), (5, None, 1), (6, "", 1), (7, " \n", 1), (8, "one", 1), (2, "one", 1), (8, a + " thirteen", 1), (4, "two", 1), (9, a, 1)]
    rows = [(k if k is None or kind == "long" else f"id{k}", t, x) for k, t, x in rows]
    frame = spark.createDataFrame([(*x, 1, 2, "k") for x in rows], f"doc_id {kind}, text string, rep int, label int, n int, `key` string")
    got = minhash.near_duplicates(frame, words=2)
    want, n = plain_components([(k, t) for k, t, _ in rows], 2)
    assert sorted(map(repr, ((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()))) == sorted(map(repr, ((k, m, c) for (k, _, _), m, c in zip(rows, n, want, strict=True))))
