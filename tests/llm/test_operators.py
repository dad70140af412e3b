"""Each operator against a plain version on small rows: nulls, empty texts, ties, repeats, other columns."""

import base64
import bisect
import collections
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from derivanta.llm import bpe, chat_format, embedding_dedup, license_scan, line_dedup, minhash, nearest, packing, quality, token_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(random.choices(WORDS, k=120))


def near(text, n):
    w = text.split()
    for _ in range(n):
        w[random.randrange(len(w))] = random.choice(WORDS)
    return " ".join(w)


TEXTS = [None, "", "one", "  lead  and trail ", "Line one is here\nshared line of text\n", "SHARED line of text\nother\nshared line of text", "é中 ꙮ's 12\t\n\n x", BASE, BASE.upper(), "x" * 5000, " " * 300, "a\x1cb <|endoftext|>"]
TEXTS += [near(BASE, k) for k in (1, 2, 3, 5, 8, 13, 20)] + [" ".join(random.choices(WORDS, k=30)) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src0", "en", "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rep string")


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_bpe(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = by_id(bpe.decode_ids(bpe.encode_texts(docs, path, P.PATTERN), path, P.PATTERN))
    for i, t in enumerate(TEXTS):
        want = array("I", enc.encode_ordinary(t or ""))
        assert bytes(got[i]["ids"]) == want.tobytes() and got[i]["n_tokens"] == len(want) and bytes(got[i]["decoded"]) == (t or "").encode()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(999)]
    h = bpe.PerfectHash(keys, list(range(999)))
    assert all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"x") is None and bpe.PerfectHash([], []).get(b"") is None


def library_ids(name, end):
    t = Tokenizer.from_file(P.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in TEXTS]


def test_token_files(spark, docs, tmp_path):
    out = str(tmp_path / "orc")
    token_files.write_token_ids(docs, out, P.path("word_bpe_49k.json"), P.PATTERN, 1)
    got, start = by_id(token_files.with_crc32(token_files.read_token_ids(spark, out))), 0
    for i, ids in enumerate(library_ids("word_bpe_49k.json", 1)):
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    assert token_files.read_token_ids(spark, out).where("doc_id = 3").count() == 1


def test_packing(docs):
    pieces = packing.cut_pieces(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 0, 100)
    rows = packing.pack(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), 100).collect()
    want = []
    for i, ids in enumerate(library_ids("byte_bpe_50k.json", 0)):
        first = (len(ids) - 1) % 100 + 1
        cuts = [0, *range(first, len(ids), 100), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows) == sorted(want)
    full = collections.defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100


@pytest.mark.parametrize("groups", [3, 256])
def test_plan_uses_each_document_once(groups):
    counts = {n: random.randrange(50) for n in range(1, 201)}
    plan = packing.plan_sequences(counts, 200, groups)
    used = collections.Counter()
    for lengths, m in plan:
        assert sum(lengths) <= 200
        for n in lengths:
            used[n] += m
    assert used == +collections.Counter(counts)
    if groups == 256:
        rooms, bins = [], 0  # best fit, longest first, one document at a time
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                at = bisect.bisect_left(rooms, n)
                room = rooms.pop(at) if at < len(rooms) else 200
                bins += room == 200
                bisect.insort(rooms, room - n)
        assert sum(m for _, m in plan) <= bins * 1.005 + 1


def test_line_dedup(docs):
    got = by_id(line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped", "rep"))
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holds = collections.defaultdict(set)
    for i, t in enumerate(TEXTS):
        for x in (t or "").split("\n"):
            holds[key(x)].add(i)
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holds[key(x)]) < 2 or min(holds[key(x)]) == i]
        assert ((got[i]["text"] or ""), got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words):
    got, sets = by_id(minhash.near_duplicates(docs, words=words)), []
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(sets)))
    for _ in root:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert [tuple(got[i]) for i in range(len(sets))] == [(i, len(s), root[i]) for i, s in enumerate(sets)]
    assert len(set(root)) < len(root)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.3)], i % 2 if i % 7 else 0) for i in range(150)]
    rows += [(200 + i, rows[5][1], 1) for i in range(9)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [1.0, None] + [0.0] * 6, 1), (304, rows[5][1], None), (350, [], 1), (351, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def fine(r):
    v = r.embedding
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_links(vectors):
    rows = vectors.collect()
    ids = [r.vec_id for r in rows]
    x = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows if fine(r) and r.label is not None}
    label = {r.vec_id: r.label for r in rows}
    links = {i: [j for j in x if i in x and j != i and label[i] == label[j] and float(x[i] @ x[j]) >= 0.98] for i in ids}
    root = {i: i for i in ids}
    for _ in range(20):
        for i in ids:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    got = by_id(embedding_dedup.embedding_links(vectors))
    assert {i: tuple(got[i]) for i in ids} == {i: (i, len(links[i]), root[i]) for i in ids}


def test_nearest(vectors):
    x = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in vectors.collect() if fine(r)}
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()]
    want = []
    for q in (q for q in x if q % 50 == 0):
        best = sorted((round(-float(x[q] @ x[c]), 12), c) for c in x if c != q)[:5]
        want += [(q, k + 1, c) for k, (_, c) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_license_scan(spark):
    rows = [(1, "Text.\nReleased under the MIT License.\nMore"), (2, "licensed under the  Apache License, Version 2.0. All rights reserved."), (3, None), (4, ""), (5, "no such words")]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["license"] for i in range(1, 6)] == ["MIT", "Apache-2.0", None, None, None]
    custom = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known={"a": "no such words"}, rules=[("r", "X", ["a"])])
    assert by_id(custom)[5]["license"] == "X"


def test_chat_round_trip(spark):
    forged = chat_format.FORGED
    rows = [(-1, 0, "user", forged), (-1, 1, "assistant", forged), (1, 1, "assistant", None), (1, 0, "us\ner", "a <%| b <|nl|>"), (2, None, "assistant", "x\n" * 50)]
    got = by_id(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert [tuple(t) for t in got[-1]["turns"]] == [("user", forged), ("assistant", forged)] and got[-1]["loss_text"] == forged
    assert [tuple(t) for t in got[1]["turns"]] == [("us\ner", "a <%| b <|nl|>"), ("assistant", "")] and got[2]["level"] == 0


def test_quality(spark):
    good = [(i, " ".join(random.choices(WORDS, k=40)), 1, 0) for i in range(300)]
    junk = [(i, " ".join(x.upper() + "!!" for x in random.choices(WORDS, k=40)), 0, 0) for i in range(300, 400)]
    toxic = [(i, " ".join([*random.choices(WORDS, k=30), "nasty", "vile"]), 1, 1) for i in range(400, 480)]
    rows = spark.createDataFrame(good + junk + toxic, "doc_id long, text string, quality int, toxic int")
    docs = rows.select("doc_id", "text", F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"))
    model = quality.fit(docs, rows.where("doc_id % 5 > 0").select("doc_id", "quality", "toxic"))
    got = by_id(quality.classify(docs, model, F.col("source"), F.col("lang")))
    held = [i for i in range(480) if i % 5 == 0]
    assert sum(got[i]["keep"] != (i < 300) for i in held) <= 2 and len(got) == 480
    silent = quality.fit(docs, rows.limit(0).select("doc_id", "quality", "toxic"))
    assert quality.classify(docs, silent, F.col("source"), F.col("lang")).where("not keep").count() == 0


def test_empty_tables(spark, docs, vectors, tmp_path):
    none, no_vectors = docs.limit(0), vectors.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert embedding_dedup.embedding_links(no_vectors).count() == 0
    assert nearest.nearest(no_vectors, no_vectors).count() == 0
    pieces = packing.cut_pieces(none, P.path("byte_bpe_50k.json"), P.PATTERN, 0, 100)
    assert packing.pack(pieces, 100).count() == 0
    token_files.write_token_ids(none, str(tmp_path / "none"), P.path("word_bpe_49k.json"), P.PATTERN, 1)
    assert token_files.read_token_ids(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, "/root/testdata/sf0.001").cache()
        assert out.columns == docs.columns and out.join(kept, "doc_id", "left_anti").count() == 0, name
        kept = out
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()}
    total = collections.Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048
