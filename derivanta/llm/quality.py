"""Quality classifier by hierarchical empirical Bayes.

Two traits are judged apart: low quality and toxicity. For each, a logistic model over word evidence
and plain measures of the text gives a document's own evidence; how often the trait occurs on
the document's host, and under its path there, gives a prior that shrinks towards the
host's rate and the global one the fewer documents there are. Both are added as log odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, texts
from .common import Scratch

TRAITS = ("junk", "toxic")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_MARKS = [ord(c) for c in _EDGES]


def words_of(text: str) -> set[str]:
    """Distinct words: lower case, without ASCII marks at the ends."""
    return {w.strip(_EDGES) for w in text.lower().split()} - {""}


def measures(text: str) -> list[float]:
    """Shares that lie between 0 and 1, but for the logarithms of length and of line length."""
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(text))
    of = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters = int(of[65:91].sum() + of[97:123].sum() + of[192:].sum())  # a first byte for each other letter
    often = Counter(words)
    return [
        np.log1p(len(text)) / 10,
        sum(map(str.isupper, words)) / n,
        int(of[65:91].sum()) / max(1, letters),
        int(of[48:58].sum()) / size,
        int(of[_MARKS].sum()) / size,
        int(of[ord("!")]) / n,
        int(of[ord("|")]) / n,
        len(often) / n,
        len(set(lines)) / len(lines),
        max(often.values(), default=0) / n,
        min(1.0, letters / n / 20),
        letters / size,
        np.log1p(size / len(lines)) / 10,
    ]


def features(text: str, lexicons: list[dict[str, float]]) -> list[float]:
    """Evidence of each trait's words (sum of log odds, within bounds, and the strongest), then measures."""
    words, out = words_of(text), []
    for lexicon in lexicons:
        found = [lexicon[w] for w in words if w in lexicon]
        out += [float(np.clip(sum(found), -12, 12)) / 4, max(found, default=0.0)]
    return out + measures(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights, the last for the constant, by iterated least squares."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """lexicons, weights and rate of each trait; fit() on a bounded sample of labelled rows."""

    def __init__(self, lexicons: list[dict[str, float]], weights: list[np.ndarray | None], rates: list[float]):
        self.lexicons, self.weights, self.rates = lexicons, weights, rates

    def logits(self, all_texts: list[str]) -> np.ndarray:
        """Log odds of each trait by the text alone, relative to the trait's rate among labelled rows."""
        x = np.array([features(t, self.lexicons) for t in all_texts]).reshape(len(all_texts), -1)
        x = np.hstack([x, np.ones((len(x), 1))])
        none = np.zeros(len(x))
        return np.stack([none if w is None else np.clip(x @ w, -30, 30) - np.log(r / (1 - r)) for w, r in zip(self.weights, self.rates, strict=True)], axis=1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, lexicon: int = 2_000, least: int = 4) -> Model:
    """labels: id_col, quality (0: junk), toxic (1: toxic).

    Fits on at most sample labelled rows, those of least hash of the id: one half gives the
    lexicons (at most lexicon words of largest log odds each, held by at least `least` documents of
    the trait), the other half the weights. Rows with a null in any of the three
    columns are passed over. A trait that is always or never there gets no weights: no evidence.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-fit")
    named = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col("quality") == 0).cast("int").alias("junk"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    picked = named.orderBy(F.xxhash64("id"), *named.columns).limit(sample).toPandas()  # at most sample rows
    picked = spark.createDataFrame(picked.astype("int64"), named.schema) if len(picked) else named.limit(0)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = scratch.save(slim.join(F.broadcast(picked), "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int")), "labelled")

    def count(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            n, junk, toxic = Counter(), Counter(), Counter()
            for t, j, x in zip(texts(b, 0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words_of(t)
                n.update(w)
                if j:
                    junk.update(w)
                if x:
                    toxic.update(w)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (n, junk, toxic))], names=["w", "n", "junk", "toxic"])

    words = rows.where("half = 0").select("text", "junk", "toxic").mapInArrow(count, "w string, n long, junk long, toxic long")
    words = scratch.save(words.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n", *TRAITS))), "words")
    totals = {r["half"]: r for r in rows.groupBy("half").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in TRAITS)).collect()}
    if not {0, 1} <= totals.keys():
        scratch.clear()
        return Model([{}, {}], [None, None], [0.5, 0.5])
    lexicons = []
    for c in TRAITS:
        inside, outside = totals[0][c], totals[0]["n"] - totals[0][c]
        odds = F.log((F.col(c) + 0.5) / (inside + 1)) - F.log((F.col("n") - F.col(c) + 0.5) / (outside + 1))
        # Two standard errors below: words that met a trait a few times by chance stay out.
        error = F.sqrt(1 / (F.col(c) + 0.5) + 1 / (F.col("n") - F.col(c) + 0.5))
        top = words.where(f"{c} >= {least}").withColumn("odds", odds - 2 * error).where("odds > 0.5").orderBy(F.desc(F.col("odds") * F.sqrt(c)), "w").limit(lexicon)
        lexicons.append({r["w"]: r["odds"] for r in top.select("w", "odds").collect()})
    width = 2 * len(TRAITS) + len(measures(""))

    def measure(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            x = np.array([features(t, lexicons) for t in texts(b, 0)]).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "junk", "toxic"])

    held = rows.where("half = 1").select("text", "junk", "toxic").mapInArrow(measure, "x array<double>, junk int, toxic int").toPandas()
    scratch.clear()
    x = np.array(held["x"].tolist()).reshape(len(held), width)
    weights, rates = [], []
    for c in TRAITS:
        y = held[c].to_numpy(float)
        mixed = 0 < y.sum() < len(y)
        weights.append(fit_logistic(x, y) if mixed else None)
        rates.append(float(y.mean()) if mixed else 0.5)
    return Model(lexicons, weights, rates)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def classify(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, host, path, and for each trait evidence_* (log odds by the text
    alone), rate_* (the site's shrunken rate without this document) and p_* (posterior);
    keep: neither posterior reaches a half.

    1. A document's text gives its evidence, and with the trait's rate among labelled rows a
       first probability.
    2. Grouped sums of these per path and per host, with partial sums on the map side: a host that
       holds a third of all rows is one row a task.
    3. How far hosts' rates spread beyond chance (method of moments) says how many documents the
       global prior is worth, within 1 and 1000; for paths likewise around their hosts.
    4. rate = (sum - own + strength * prior) / (n - 1 + strength): the host's from the global
       prior, the path's from the host's. A site without other documents gets its parent's rate.

    Null hosts and paths are sites of their own; null texts are empty, and empty ones are judged like
    any other; null ids stay; repeated rows count each; other columns are ignored. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            x = packed.value.logits(texts(b, 3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["doc_id", "host", "path", *(f"evidence_{c}" for c in TRAITS)])

    host_kind, path_kind = (slim.schema[c].dataType.simpleString() for c in ("host", "path"))
    rows = slim.mapInArrow(run, f"doc_id {kind}, host {host_kind}, path {path_kind}, evidence_junk double, evidence_toxic double")
    for c, r in zip(TRAITS, model.rates, strict=True):
        # Without weights there is no evidence for or against: the first probability is none.
        first = F.lit(0.0) if model.weights[TRAITS.index(c)] is None else _sigmoid(F.col(f"evidence_{c}") + float(np.log(r / (1 - r))))
        rows = rows.withColumn(f"first_{c}", first)
    rows = scratch.save(rows, "evidence")
    sums = [F.count("*").alias("n"), *(F.sum(f"first_{c}").alias(c) for c in TRAITS)]
    paths = rows.groupBy("host", "path").agg(*sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in TRAITS))
    paths, hosts = scratch.save(paths, "paths"), scratch.save(hosts, "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in TRAITS)).first()
    both = paths.join(hosts.select(F.col("host").alias("_h"), F.col("n").alias("hn"), *(F.col(c).alias(f"h{c}") for c in TRAITS)), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    out = rows.join(both.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", *TRAITS, "hn", *(f"h{c}" for c in TRAITS)), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    keep = F.lit(True)
    shown = ["doc_id", "host", "path"]
    for c in TRAITS:
        prior = min(max((whole[c] or 0.0) / max(1, whole["n"] or 0), 1e-4), 1 - 1e-4)
        at_host = strength(hosts, F.col(c), F.lit(prior), "n")
        at_path = strength(both, F.col(c), (F.col(f"h{c}") + at_host * prior) / (F.col("hn") + at_host), "n")
        own = F.col(f"first_{c}")
        host_rate = (F.col(f"h{c}") - own + at_host * prior) / (F.col("hn") - 1 + at_host)
        rate = (F.col(c) - own + at_path * host_rate) / (F.col("n") - 1 + at_path)
        rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
        out = out.withColumn(f"rate_{c}", rate).withColumn(f"p_{c}", _sigmoid(F.col(f"evidence_{c}") + F.log(F.col(f"rate_{c}") / (1 - F.col(f"rate_{c}")))))
        if model.weights[TRAITS.index(c)] is not None:
            keep = keep & (F.col(f"p_{c}") < 0.5)
        shown += [f"evidence_{c}", f"rate_{c}", f"p_{c}"]
    return out.select(*shown, keep.alias("keep"))


def strength(sites: DataFrame, total: Column, prior: Column, n: str) -> float:
    """How many documents the prior of a site is worth: p (1 - p) / (spread beyond chance) - 1, from
    one aggregation over sites, within 1 and 1000."""
    rate = total / F.col(n)
    noise = prior * (1 - prior) / F.col(n)
    r = sites.agg(F.avg((rate - prior) ** 2 - noise).alias("spread"), F.avg(prior * (1 - prior)).alias("pq")).first()
    if not r["spread"] or r["spread"] <= 0:
        return 1000.0
    return float(min(1000.0, max(1.0, r["pq"] / r["spread"] - 1)))
