"""Quality rules with a suffix array: repetition inside a text, in words.

A batch of texts becomes one array of word numbers. Sorting all suffixes, the longest common
prefixes of neighbours form intervals, and each interval is a repeated run of words; one whose
occurrences follow different words is a maximal repeat. All of it is numpy over a slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, texts
from .common import fresh

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat", "covered_words")


def suffix_order(ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of texts in order, and the common prefix, in words, of each with the one before it.

    words: the texts' words as numbers, one text after another; ends: each word's end of text.
    Suffixes of different texts share nothing. Prefix doubling: ranks by the first word, then by two,
    four, ...; only suffixes that still tie are sorted again. The ranks of all rounds then give the
    common prefixes, by adding up the powers of two for which two suffixes rank alike.
    """
    n = len(words)
    first = ends * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(first, kind="stable")
    slots = np.arange(n)

    def heads(*keys: np.ndarray) -> np.ndarray:
        new = np.zeros(len(keys[0]), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return new

    new = heads(first[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    rounds, step = [rank.astype(np.int32)], 1
    while not new.all():
        # A group is open if it has more than one suffix: a slot that is no head, or one before such a slot.
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        open_ = order[at]
        beyond = open_ + step
        second = np.where(beyond < ends[open_], rank[np.minimum(beyond, n - 1)], -1)
        own = rank[open_]
        by = np.lexsort((second, own))
        order[at] = open_ = open_[by]
        new[at] = heads(own[by], second[by])
        rank[open_] = np.maximum.accumulate(np.where(new[at], at, 0))
        step *= 2
        rounds.append(rank.astype(np.int32))
    prefix = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(rounds) - 1, -1, -1):
        x, y = a + prefix[1:], b + prefix[1:]
        same = (x < ends[a]) & (y < ends[b])
        same[same] = rounds[k][x[same]] == rounds[k][y[same]]
        prefix[1:] += same.astype(np.int64) << k
    return order, prefix


def maximal_repeats(order: np.ndarray, prefix: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each maximal repeat of at least least words, one place where it starts and its length.

    before: the word before each suffix, -1 at a text's start. Intervals of common prefixes open and
    close on a stack; one whose suffixes all follow the same word is part of a longer repeat.
    """
    starts, lengths, stack = [], [], []
    high = np.append(prefix, 0)
    # Slots that no long prefix touches belong to no interval: only the others are looked at.
    at = np.flatnonzero((high[:-1] >= least) | (high[1:] >= least))
    left = before[order[at]].tolist()
    shared = np.where(high[at] >= least, high[at], 0).tolist()
    places = order[at].tolist()
    many = -2  # follows more than one word, or starts the text
    mixed = lambda x, y: x if x == y and x >= 0 else many
    for i in range(len(at) + 1):
        now = shared[i] if i < len(at) else 0
        word = left[i - 1] if i else many
        # The suffix before belongs to the interval that is open, or to the one that opens here.
        carried = word if word >= 0 else many
        if stack and stack[-1][0] >= now:
            stack[-1][1] = mixed(stack[-1][1], carried)
            while stack and stack[-1][0] > now:
                length, carried, place = stack.pop()
                if carried == many:
                    starts.append(place)
                    lengths.append(length)
                if stack and stack[-1][0] >= now:
                    stack[-1][1] = mixed(stack[-1][1], carried)
            if now and (not stack or stack[-1][0] < now):
                stack.append([now, carried, places[i]])
        elif now:
            stack.append([now, carried, places[i]])
    return np.array(starts, np.int64), np.array(lengths, np.int64)


def _covered(lengths: np.ndarray, least: int, reach: np.ndarray) -> np.ndarray:
    """Words within the union of spans: one from each word on whose length is at least least."""
    place = np.arange(len(lengths))
    ends = np.maximum.accumulate(np.where(lengths >= least, place + reach, 0))
    return ends > place


def measure(batch: list[str], window: int, least: int) -> dict[str, np.ndarray]:
    """The counts of _COUNTS for each text."""
    raw = [t.encode() for t in batch]
    split = [r.split() for r in raw]  # of bytes: at ASCII white space
    sizes = np.array([len(w) for w in split], np.int64)
    out = {"n_words": sizes}
    out["word_chars"] = np.array([len(t) - (len(r) - len(r.translate(None, _SPACE))) for t, r in zip(batch, raw, strict=True)], np.int64)
    out["n_symbols"] = np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], np.int64)
    lines = ([x for x in r.split(b"\n") if x and not x.isspace()] for r in raw)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    words = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    bounds = np.cumsum(sizes)
    ends = np.repeat(bounds, sizes)
    order, prefix = suffix_order(ends, words)
    deepest = np.zeros(len(words), np.int64)  # the longest repeat that starts at each word
    deepest[order] = np.maximum(prefix, np.append(prefix[1:], 0))
    before = np.append(-1, words[:-1]) if len(words) else words
    before[(bounds - sizes)[sizes > 0]] = -1
    starts, lengths = maximal_repeats(order, prefix, before, least)
    text_of = np.repeat(np.arange(len(batch)), sizes)
    per = lambda mask: np.bincount(text_of[mask], minlength=len(batch)).astype(np.int64)
    out["n_repeat_words"] = per(_covered(deepest, window, np.full(len(words), window)))
    out["n_repeats"] = np.bincount(text_of[starts], minlength=len(batch)).astype(np.int64)
    longest = np.zeros(len(batch), np.int64)
    np.maximum.at(longest, text_of[starts], lengths)
    out["longest_repeat"] = longest
    out["covered_words"] = per(_covered(deepest, least, deepest))
    return out


def repetition_rules(
    docs: DataFrame, window: int = 5, min_words: int = 10, max_window_percent: int = 20, least: int = 20, max_covered_percent: int = 10, max_longest: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and, for each row: n_words (maximal runs without ASCII white space), word_chars (their code
    points), n_symbols, n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
    within window words that the text holds twice or more), n_repeats (maximal repeats of at least least
    words), longest_repeat (words of the longest of them, else 0), covered_words (in the union of their
    spans), base_failed and kept.

    base_failed: fewer than min_words words, or more than max_window_percent of the words in
    n_repeat_words. A text is kept if that is false, repeats of least words or more cover at
    most max_covered_percent of it, and none is longer than max_longest words.

    Null texts count as empty, so they fail; each row is judged alone, so null and repeated ids, copies and
    ties need no rule, and rows stay where they are: no shuffle. Other columns are ignored, whatever their
    names. An empty table gives none. A task holds a few MB of text at a time, or one longer text.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 20):
            found = measure(texts(b, 1), window, least)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[c]) for c in _COUNTS]], names=["doc_id", *_COUNTS])

    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * n)
    fine = (100 * F.col("covered_words") <= max_covered_percent * n) & (F.col("longest_repeat") <= max_longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
