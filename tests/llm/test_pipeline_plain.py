"""Quality's shrinkage, and each stage of the pipeline, against plain versions."""

import collections
import zlib
from array import array

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from derivanta.llm import quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_minhash import plain_components
from test_odd_rows import lines_of

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_rates(host, path, first, n_of):
    """Rates of all rows by the method of quality.classify, with loops over sites."""
    prior = min(max(first.sum() / max(1, n_of), 1e-4), 1 - 1e-4)
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, (h, p) in enumerate(zip(host, path, strict=True)):
        hosts[h].append(i)
        paths[h, p].append(i)

    def worth(groups, prior_of):
        spread, pq_ = [], []
        for key, at in groups.items():
            q = prior_of(key)
            spread.append((first[at].mean() - q) ** 2 - q * (1 - q) / len(at))
            pq_.append(q * (1 - q))
        s = np.mean(spread)
        return 1000.0 if s <= 0 else min(1000.0, max(1.0, np.mean(pq_) / s - 1))

    at_host = worth(hosts, lambda _: prior)
    at_path = worth(paths, lambda k: (first[hosts[k[0]]].sum() + at_host * prior) / (len(hosts[k[0]]) + at_host))
    out = []
    for i, (h, p) in enumerate(zip(host, path, strict=True)):
        upper = (first[hosts[h]].sum() - first[i] + at_host * prior) / (len(hosts[h]) - 1 + at_host)
        out.append((first[paths[h, p]].sum() - first[i] + at_path * upper) / (len(paths[h, p]) - 1 + at_path))
    return np.clip(out, 1e-4, 1 - 1e-4)


def test_shrinkage(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 17 > 0, F.col("source"))).withColumn("keep", F.lit(1)).withColumn("n", F.lit(1))
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model, F.col("source"), F.col("lang")).toPandas()
    assert len(got) == 1000
    keep = np.ones(len(got), bool)
    host, path = ([None if x is None else str(x) for x in got[c]] for c in ("host", "path"))
    for c, r in zip(quality.TRAITS, model.rates, strict=True):
        evidence = got[f"evidence_{c}"].to_numpy()
        rates = plain_rates(host, path, sigmoid(evidence + np.log(r / (1 - r))), len(got))
        assert np.allclose(got[f"rate_{c}"], rates, rtol=1e-9)
        posterior = sigmoid(evidence + np.log(rates / (1 - rates)))
        assert np.allclose(got[f"p_{c}"], posterior, rtol=1e-9)
        keep &= posterior < 0.5
    assert (got["keep"].to_numpy() == keep).all()
    assert quality.classify(docs.limit(0), model, F.col("source"), F.col("lang")).count() == 0


def test_held_out_rows(spark):
    """Fitted on half of the labels, judged on the other: the traits that the text shows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.classify(docs, model, F.col("source"), F.col("lang")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    junk, toxic, clean = got[got.quality == 0], got[got.toxic == 1], got[(got.quality == 1) & (got.toxic == 0)]
    shares = [float((~x.keep).mean()) for x in (junk, toxic)] + [float(clean.keep.mean())]
    assert shares[0] > 0.95 and shares[1] > 0.75 and shares[2] > 0.97, shares


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each; some documents have a near copy on one line."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    copies = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.replace("text", F.lit("\n"), F.lit(" also ")), F.lit(" end"))).withColumn("doc_id", F.col("doc_id") + 100_000)
    out = [docs.unionByName(copies)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [x.toPandas() for x in out]


def rows(frame):
    return sorted(map(tuple, frame[COLUMNS].itertuples(index=False)), key=repr)


def test_quality_stage(spark, stages):
    docs = spark.createDataFrame(stages[0])
    judged = quality.classify(docs, quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet")), F.col("source"), F.col("lang")).toPandas()
    kept = set(judged[judged.keep].doc_id)
    assert rows(stages[1]) == rows(stages[0][stages[0].doc_id.isin(kept)])


def test_line_stage(stages):
    want = []
    by = {r.doc_id: r for r in stages[1].itertuples()}
    for i, text, _, dropped in lines_of([(r.doc_id, r.text) for r in stages[1].itertuples()]):
        if not (dropped and not text.strip(" \t\n\x0b\x0c\r")):
            want.append((i, text, by[i].lang, by[i].source, len(text) if dropped else by[i].n_chars))
    assert rows(stages[2]) == sorted(want, key=repr)


def test_near_stage(stages):
    of = [(r.doc_id, r.text) for r in stages[2].itertuples()]
    component, _ = plain_components(of, 5)
    kept = {i for (i, _), c in zip(of, component, strict=True) if i == c}
    assert rows(stages[3]) == rows(stages[2][stages[2].doc_id.isin(kept)]) and len(kept) < len(of)


def test_packing_stage(stages):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in stages[3].itertuples():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = stages[4]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    full = collections.defaultdict(list)
    for r in got.itertuples():
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [at for at, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(full) <= -(-sum(x[3] for x in want) // 2048) * 1.005 + 1


def test_run_is_the_stages(spark, stages, tmp_path):
    spark.createDataFrame(stages[0]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(stages[4][key].itertuples(index=False, name=None))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
