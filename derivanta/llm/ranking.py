"""Ranked lexical search over impact-ordered postings, score at a time.

A posting's impact is its exact integer score for one occurrence of the term in the query. Documents come
in blocks; a block's postings are grouped by term and lie in descending order of impact. A
query takes its terms' highest contributions first and stops once what remains cannot change which
documents are the best; then these documents' scores are completed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow_text import slices, texts
from .common import Scratch

#: (query, term) pairs of a block of queries, about, and postings of a block of documents, unless one text has more.
PAIRS, POSTINGS = 1 << 19, 1 << 20
#: Parts of a query's results in the first merge.
PARTS = 256
_LEAST = -(1 << 63)
#: Bytes of terms as they are, A-Z lower-cased; all others part terms.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The text's terms, with A-Z lower-cased: the longest runs of ASCII letters, digits and other characters beyond ASCII."""
    return text.encode().translate(_FOLD).split()


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a hash of id and text), id, term, q (how often the text has it), for each distinct row."""
    slim = queries.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    slim = slim.select(F.xxhash64("id", "text").alias("item"), "id", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            counts = [Counter(terms_of(t)) for t in texts(b, 2)]
            row = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
            term, q = (pa.array([x for c in counts for x in f(c)], kind) for f, kind in ((Counter.keys, pa.binary()), (Counter.values, pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), term, q], names=["item", "id", "term", "q"])

    return slim.mapInArrow(run, f"item long, id {slim.schema['id'].dataType.simpleString()}, term binary, q long")


def document_terms(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all its terms), and terms and tfs: of those in the broadcast vocabulary (term -> number)."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in slices(batches, 1):
            sizes, bounds, terms, tfs = [], [0], [], []
            for t in texts(b, 1):
                words = terms_of(t)
                found = [(known[w], n) for w, n in Counter(words).items() if w in known]
                sizes.append(len(words))
                terms += [x for x, _ in found]
                tfs += [n for _, n in found]
                bounds.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """The postings of some documents by term, each term's by descending impact."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((-impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        by_doc = np.argsort(doc, kind="stable")  # for completing single documents
        self.own_terms, self.own_impact, self.own = term[by_doc], impact[by_doc], np.searchsorted(doc[by_doc], np.arange(len(ids) + 1))

    def complete(self, at: int, gain: dict[int, int]) -> int:
        s = slice(self.own[at], self.own[at + 1])
        return sum(gain.get(t, 0) * i for t, i in zip(self.own_terms[s].tolist(), self.own_impact[s].tolist(), strict=True))

    def best(self, gain: dict[int, int], k: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """(-score, doc_id) of the k best documents with a score above 0, best first, ties to the smaller id.

        gain: what an impact of 1 adds, by term. floor: what the k-th best must beat, as known from
        elsewhere; documents that can't are left out.

        Each round takes, of every term, the postings whose contribution is at least half the
        highest that is left. What a document may still get is at most the sum of the terms' next
        contributions; rounds go on until no document but k can be among the best (or none that
        scores like the k-th is left out), or until nothing is left.
        """
        at = np.searchsorted(self.terms, np.fromiter(gain, np.int64, len(gain)))
        lists = [[int(self.starts[i]), int(self.ends[i]), g] for i, (t, g) in zip(at.tolist(), gain.items(), strict=True) if i < len(self.terms) and self.terms[i] == t and g > 0]
        score = np.zeros(len(self.ids), np.int64)
        while lists:
            top = max(int(self.impact[s]) * g for s, _, g in lists)
            for x in lists:
                start, end, g = x
                cut = -(-(top // 2 + 1) // g)  # contributions of over half of top
                stop = start + int(np.searchsorted(-self.impact[start:end], -cut, side="right"))
                if stop > start:
                    score[self.doc[start:stop]] += g * self.impact[start:stop]
                    x[0] = stop
            lists = [x for x in lists if x[0] < x[1]]
            rest = sum(int(self.impact[s]) * g for s, _, g in lists)
            least = int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else 0
            least = max(least, -floor[0]) if floor else least
            if rest and np.count_nonzero(score + rest >= max(least, 1)) <= k:
                break
        else:
            rest, least = 0, int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else 0
        # All that may be among the best: where the lists ran out, ties with the k-th come too.
        near = np.flatnonzero(score + rest >= max(least, 1)).tolist()
        found = sorted((-(self.complete(i, gain) if rest else int(score[i])), int(self.ids[i])) for i in near)
        return [x for x in found[:k] if x[0] < 0 and (floor is None or x <= floor)]


def _blocks(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, n, bounds, terms and tfs of documents with up to POSTINGS postings."""
    held, many = [], 0

    def whole():
        b = pa.Table.from_batches(held).combine_chunks()
        lists = [b.column(c).chunk(0) if b.column(c).num_chunks else pa.array([], pa.list_(pa.int32())) for c in ("terms", "tfs")]
        ids = b.column("doc_id").fill_null(_LEAST).to_numpy()
        return ids, b.column("n").to_numpy(), lists[0].value_lengths().to_numpy(), lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy().astype(np.int64)

    for b in batches:
        sizes = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            base = int(sizes[start - 1]) if start else 0
            stop = int(np.searchsorted(sizes, base + POSTINGS - many, side="right"))
            if stop <= start and held:
                yield whole()
                held, many = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(b.slice(start, stop - start))
            many += int(sizes[stop - 1]) - base
            start = stop
    if held:
        yield whole()


def _search(postings: DataFrame, asked: dict[int, dict[int, int]], k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task's documents for each item (term -> how often it has it)."""
    spark = postings.sparkSession
    many, total = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.lit(many) + 2) / (2 * F.col("n") + 1)))
    weights = {r["t"]: r["w"] for r in df.select("t", weight.alias("w")).collect()}  # of a block's terms: see PAIRS
    sent = spark.sparkContext.broadcast({i: {t: q * weights[t] for t, q in of.items() if weights.get(t)} for i, of in asked.items()})

    def run(batches) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for ids, n, sizes, terms, tfs in _blocks(batches):
            doc = np.repeat(np.arange(len(ids)), sizes)
            m = np.array([25 + 75 * x * many // total for x in n.tolist()], np.int64)  # of Python, as products grow large
            block = Block(ids, doc, terms, 1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc]))
            for item, gain in sent.value.items():
                had = best.get(item, [])
                best[item] = sorted(had + block.best(gain, k, had[k - 1] if len(had) == k else None))[:k]
        flat = [(i, d, -s) for i, found in best.items() for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return postings.where("size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k documents of highest score for each row of queries, ties to
    the smaller doc_id; only scores above 0.

    Terms are the longest runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. With N documents
    that have a term, L terms in all of them, n in this one: m = 25 + (75 * n * N) div L, and a
    posting's impact is (10^9 * tf) div (1000 * tf + 8 * m). A term in df documents weighs w = floor(1000 *
    ln((2 N + 2) / (2 df + 1))). The score is the sum of w * impact over the query's terms, with repeats.

    Null and empty texts have no terms: such documents are never found, such queries find nothing. A null
    doc_id comes before all others in ties; rows of equal ids are documents of their own. Equal rows of
    queries are one query; rows of equal id and different texts, null ids too, are queries of
    their own, each with ranks from 1. Other columns are ignored. No documents or no queries: no rows.

    Queries come in blocks of about PAIRS (query, term) pairs, which the driver holds and sends to all tasks.
    Documents stay where they are: a task makes blocks of up to POSTINGS postings, keeps the k best of each
    query from block to block and starts the next from their bound. What is shuffled is k rows
    for each query and task; they are merged in PARTS parts a query, then these.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranking")
    pairs = scratch.save(query_terms(queries, query_id, query_text), "pairs")
    blocks = pairs.count() // PAIRS + 1
    found = []
    for i in range(blocks):
        own = pairs.where(F.pmod("item", F.lit(blocks)) == i).collect()
        number: dict[bytes, int] = {}
        asked: dict[int, dict[int, int]] = {}
        for r in own:
            asked.setdefault(r["item"], {})[number.setdefault(bytes(r["term"]), len(number))] = r["q"]
        postings = scratch.save(document_terms(docs, spark.sparkContext.broadcast(number), doc_id, doc_text), "postings")
        found.append(_search(postings, asked, k))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    ranks = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    parts = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    ranked = ranks(ranks(parts, "item", "part"), "item")
    names = pairs.select("item", F.col("id").alias("query_id")).distinct()
    shown = F.when(F.col("doc_id") != _LEAST, F.col("doc_id"))
    return ranked.join(names, "item").select("query_id", "rank", shown.alias("doc_id"), "score")
