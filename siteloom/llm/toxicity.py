"""Toxicity by a chain of linear classifiers.

Links predict one category after another; each sees the words of a text and the probabilities of the categories before
it. While learning, those probabilities come from folds that had not seen the row, so a link learns from what its
predecessors will be worth on new texts.

The categories of ``labels`` are one, toxic or not. Two finer ones are read off the learned-from rows: marks are words
far more common in toxic rows; a text *mentions* with one mark and *repeats* with two. They come first in the chain,
toxic last.

Result for odd input: null and empty texts, and all without a word, have probability 0 of everything; labels that are
null or not 0 or 1 are not learned from; without usable labels of both kinds every probability is 0; rows that repeat
are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learners import decision, folds, logistic, sigmoid
from .shared import held_out, labelled_texts, table
from .textvec import span_hash, text_blocks

#: Labelled rows that are learned from, at most: of toxic ones, and of others.
TOXIC, OTHER = 3000, 6000
#: Words that are features, at most; folds of the chain.
WORDS, FOLDS = 1024, 3
#: A word counts from this many rows on, or this share of the toxic rows if that is more: fewer are chance. It is a mark if it
#: is this much more common in toxic rows than elsewhere.
MARK_ROWS, MARK_SHARE, MARK_RATIO = 3, 1 / 150, 12.0
#: A word is a feature if it is so much more common in toxic rows than elsewhere, or the reverse.
LEAST_RATIO = 2.0
CATEGORIES = ("mention", "repeat", "toxic")
THRESHOLD = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def text_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words (letters, lower-cased) of each row, and the rows."""
    low = _FOLD[buf]
    low = np.where((low >= 0x80) & (low <= 0x9E) & (np.roll(low, 1) == 0xC3) & (low != 0x97), low + 0x20, low).astype(np.uint8)  # capitals of Latin-1 in UTF-8
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _LETTER[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    first[cuts] |= word[cuts]
    last[cuts - 1] |= word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h, rows = span_hash(low, starts, ends), np.searchsorted(offs, starts, side="right") - 1
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], rows[keep]


def presence(h: np.ndarray, rows: np.ndarray, n: int, words: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """(n, words) which of the sorted words each row has: a word's weight, or 0."""
    x = np.zeros((n, len(words)), np.float32)
    if len(words) and len(h):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        on = words[at] == h
        x[rows[on], at[on]] = weight if np.isscalar(weight) else weight[at[on]]
    return x


class Chain:
    """The words that are features, and the weights of each link."""

    def __init__(self, h: np.ndarray, rows: np.ndarray, toxic: np.ndarray):
        n, pos = len(toxic), max(1, int(toxic.sum()))
        neg = max(1, n - pos)
        least = max(MARK_ROWS, int(pos * MARK_SHARE))
        words, at = np.unique(h, return_inverse=True)
        with_toxic = np.bincount(at, toxic[rows], len(words))
        without = np.bincount(at, 1 - toxic[rows], len(words))
        a, b = (with_toxic + 0.5) / (pos + 1), (without + 0.5) / (neg + 1)
        # Words about as common either way say little and would make short texts, which lack them, look odd.
        worth = np.where((with_toxic + without >= least) & (np.abs(np.log(a / b)) >= np.log(LEAST_RATIO)), (a - b) * np.log(a / b), 0)
        chosen = np.sort(np.argsort(-worth, kind="stable")[: min(WORDS, int((worth > 0).sum()))])
        self.words = words[chosen]
        self.marks = ((with_toxic >= least) & (a >= MARK_RATIO * b))[chosen]
        hits = presence(h, rows, n, self.words)[:, self.marks].sum(axis=1)
        # Rare words weigh more, as they deviate less: so all weights are learned at one pace, and penalised alike.
        share = ((with_toxic + without)[chosen] / n).clip(1e-9, 1)
        self.weight = np.minimum(1 / np.sqrt(share), 16.0).astype(np.float32)
        x = presence(h, rows, n, self.words, self.weight)
        y = np.column_stack([hits >= 1, hits >= 2, toxic]).astype(float)
        fold, self.links, before = folds(n, FOLDS), [], np.zeros((n, 0))
        for c in range(y.shape[1]):
            inputs = self._inputs(x, before)
            out = np.zeros(n)
            for k in range(FOLDS):
                w = logistic(inputs[fold != k], y[fold != k, c])
                out[fold == k] = sigmoid(decision(inputs[fold == k], w))
            self.links.append(logistic(inputs, y[:, c]))
            before = np.column_stack([before, out])

    @staticmethod
    def _inputs(x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.hstack([x, before.astype(np.float32) * 2])

    def probabilities(self, h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """(n, categories), each link fed with the ones before."""
        x, before = presence(h, rows, n, self.words, self.weight), np.zeros((n, 0))
        for w in self.links:
            before = np.column_stack([before, sigmoid(decision(self._inputs(x, before), w))])
        before[np.bincount(rows, minlength=n) == 0] = 0
        return before


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch):
            h, rows = text_words(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], ["doc_id", "y", "words"])


def fit(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """Learn from labelled rows that are not held out, at most TOXIC and OTHER of them, taken by a hash of doc_id.

    An id counts once: unlike labels of it are its larger one, unlike texts of it one of them.
    """
    y = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    picked = y.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(TOXIC).unionByName(y.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(OTHER))
    rows = labelled_texts(docs, picked)  # TOXIC + OTHER rows of two numbers
    got = rows.mapInArrow(_worded, "doc_id long, y int, words array<long>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending")]).combine_chunks()
    toxic, lists = got.column(1).to_numpy().astype(float), got.column(2).combine_chunks()
    if toxic.min() == toxic.max():
        return None
    sizes = np.asarray(lists.value_lengths())
    return Chain(np.asarray(lists.flatten()).view(np.uint64), np.repeat(np.arange(len(toxic)), sizes), toxic)


def score(docs: DataFrame, model: Chain | None) -> DataFrame:
    """(doc_id, held_out, p_mention, p_repeat, score, predicted) of every text; score is the probability of toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS hashes and as many weights for each link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch):
                p = np.zeros((hi - lo, len(CATEGORIES)))
                if model is not None:
                    h, rows = text_words(buf, offs)
                    p = model.probabilities(h, rows, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(c) for c in p.T), pa.array((p[:, -1] >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "p_mention", "p_repeat", "score", "predicted"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, p_mention double, p_repeat double, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
