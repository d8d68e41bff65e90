"""Document quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted over one feature at a time, in turn, and then over the pairs of features that explain most of
what is left; each feature's and pair's trees add up to a lookup table over its bins, so a score is a sum of table cells.

Result for odd input: null and empty texts have all features 0 and are scored like any text; labels that are null or
not 0 or 1 are not learned from; without usable labels every score is 0.5; rows that repeat are scored each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learners import sigmoid
from .shared import held_out, labelled_texts, table
from .textvec import mix, row_starts, span_hash, text_blocks, window_hash, word_spans

#: Labelled rows that are learned from, at most.
SAMPLE = 8000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.08
#: A text is good from this score on.
GOOD = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 white space, 6-9 some signs
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
for _i, _signs in enumerate(("!?", "|<>{}[]=_/\\", "#$%&*@^~+", ".,;:'\"()-"), 6):
    for _c in _signs:
        _CLASS[ord(_c)] = _i

NAMES = ("log bytes", "log words", "bytes a word", "upper", "digit", "beyond ascii", "shouts", "code signs", "odd signs", "stops", "distinct words", "distinct triples", "same as before", "top word", "words a line", "distinct lines", "long words", "signs a word")


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) shape figures of each text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    one = np.maximum(size, 1)
    rows = np.repeat(np.arange(n), np.diff(offs))
    of = np.bincount(rows * 10 + _CLASS[buf], minlength=n * 10).reshape(n, 10) if len(buf) else np.zeros((n, 10))
    starts, ends, owner = word_spans(buf, offs)
    h = span_hash(buf, starts, ends)
    at = row_starts(owner, n)
    words = np.diff(at).astype(float)
    some = np.maximum(words, 1)

    def distinct(values: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each row, and how often its most frequent one comes."""
        if not len(values):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((values, own))
        v, o = values[order], own[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        first = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, o[first], np.diff(np.append(first, len(v))))
        return np.bincount(o[first], minlength=n).astype(float), top

    kinds, top = distinct(h, owner)
    triples = window_hash(h, 3)
    ok = owner[: len(triples)] == owner[2:] if len(triples) else np.zeros(0, bool)
    n_triples = np.bincount(owner[: len(triples)][ok], minlength=n)
    t_kinds, _ = distinct(triples[ok], owner[: len(triples)][ok])
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    # Lines: what lies between line feeds, as hashes of their words in order.
    n_lines, l_kinds = np.zeros(n), np.zeros(n)
    if len(h):
        feeds = np.cumsum(buf == 10)
        line = feeds[starts]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        value = np.add.reduceat(mix(h + place.astype(np.uint64)), first)
        n_lines = np.bincount(owner[first], minlength=n).astype(float)
        l_kinds, _ = distinct(value, owner[first])
    long = np.bincount(owner[(ends - starts) > 18], minlength=n) if len(h) else np.zeros(n)
    return np.column_stack([
        np.log1p(size), np.log1p(words), (size - of[:, 5]) / some, of[:, 2] / one, of[:, 3] / one, of[:, 4] / one, of[:, 6] / some, of[:, 7] / some, of[:, 8] / some, of[:, 9] / some,
        kinds / some, np.where(n_triples > 0, t_kinds / np.maximum(n_triples, 1), 1.0), same / some, top / some, words / np.maximum(n_lines, 1), np.where(n_lines > 0, l_kinds / np.maximum(n_lines, 1), 1.0), long / some, (of[:, 0] + of[:, 6:].sum(axis=1)) / some,
    ])


class Additive:
    """The model: bin edges, a table for each feature, and a table for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                step = RATE * self._tree(b, len(self.tables[f]), y - sigmoid(z), z)
                self.tables[f] += step
                z += step[b]
        # Pairs by how much a table over both would gain over what is left.
        left = y - sigmoid(z)
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            k = len(self.coarse[j]) + 1
            cell = coarse[i] * k + coarse[j]
            g, n = np.bincount(cell, left, (len(self.coarse[i]) + 1) * k), np.bincount(cell, minlength=(len(self.coarse[i]) + 1) * k)
            gains.append(((g * g / (n + 20)).sum(), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.grids = [np.zeros((len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for p, (i, j) in enumerate(self.pairs):
                a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
                cell = coarse[i] * b + coarse[j]
                step = RATE * self._quarters(cell, a, b, y - sigmoid(z), z)
                self.grids[p] += step
                z += step[cell]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    @staticmethod
    def _tree(b: np.ndarray, k: int, left: np.ndarray, z: np.ndarray) -> np.ndarray:
        """A tree of up to three leaves over the bins, as a table: two splits, each where it gains most."""
        p = sigmoid(z)
        g, h = np.bincount(b, left, k), np.bincount(b, p * (1 - p), k)
        out = np.zeros(k)
        spans, done = [(0, k)], []
        for _ in range(2):
            best = None
            for lo, hi in spans:
                if hi - lo < 2:
                    continue
                cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                at = int(gain.argmax())
                if best is None or gain[at] > best[0]:
                    best = gain[at], lo, lo + at + 1, hi
            if best is None or best[0] <= 0:
                break
            spans.remove((best[1], best[3]))
            spans += [(best[1], best[2]), (best[2], best[3])]
        for lo, hi in spans + done:
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
        return out

    @staticmethod
    def _quarters(cell: np.ndarray, a: int, b: int, left: np.ndarray, z: np.ndarray) -> np.ndarray:
        """A tree that cuts both features once, where the four parts gain most, as a table."""
        p = sigmoid(z)
        g, h = np.bincount(cell, left, a * b).reshape(a, b), np.bincount(cell, p * (1 - p), a * b).reshape(a, b)
        if a < 2 or b < 2:
            return np.zeros(a * b)
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

        def parts(c: np.ndarray) -> list[np.ndarray]:
            q = c[:-1, :-1]
            return [q, c[:-1, -1:] - q, c[-1:, :-1] - q, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + q]

        gs, hs = parts(cg), parts(ch)
        gain = sum(x * x / (y + 1) for x, y in zip(gs, hs, strict=True))
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        value = [float(x[i, j] / (y[i, j] + 1)) for x, y in zip(gs, hs, strict=True)]
        out = np.empty((a, b))
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
        return out.ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t, b in zip(self.tables, self._bins(x, self.edges), strict=True):
            z += t[b]
        coarse = self._bins(x, self.coarse)
        for grid, (i, j) in zip(self.grids, self.pairs, strict=True):
            z += grid[coarse[i] * (len(self.coarse[j]) + 1) + coarse[j]]
        return sigmoid(z)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(features(buf, offs)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Additive | None:
    """Learn from at most SAMPLE labelled rows that are not held out, taken by a hash of doc_id.

    An id counts once: unlike labels of it are its larger one, unlike texts of it one of them.
    """
    y = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = labelled_texts(docs, y)  # SAMPLE rows of two numbers
    got = rows.mapInArrow(_featured, "doc_id long, y int, x array<double>").toArrow()
    if not got.num_rows:
        return None
    ids, y = got.column(0).to_numpy(), got.column(1).to_numpy().astype(float)
    x = np.asarray(got.column(2).combine_chunks().flatten(), float).reshape(len(y), -1)
    order = np.lexsort((x[:, 0], ids))
    return Additive(x[order], y[order])


def score(docs: DataFrame, model: Additive | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch):
                s = model.score(features(buf, offs)) if model is not None else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
