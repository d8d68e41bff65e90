"""Language identification by hierarchical discrimination.

Languages are grouped into families by the likeness of their mean letter n-grams. A document's family comes first, by
one-versus-one linear support vector machines between families; then those between the languages of that family.

Result for odd input: a text that is null or has no letter is ``und`` with score 0; null languages are not learned from;
without any labelled row every document is ``und``; rows that repeat are predicted each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learners import linear_svm, sigmoid
from .shared import held_out, table
from .textvec import give_back, mix, text_blocks

#: Labelled rows that are learned from, at most: of each language, and of all together.
SAMPLE, TOTAL = 500, 40_000
FEATURES = 2048
#: Rows that are turned into features at once, at most.
ROWS = 256
#: Margins are turned into scores by this slope.
SLOPE = 4.0
#: A stage that drops documents does so below this score. The winner of all its duels has a quarter at least, so by default
#: only texts whose duels go round in a circle fall below it, and those without letters.
REJECT = 0.02

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngram_features(buf: np.ndarray, offs: np.ndarray, d: int = FEATURES) -> np.ndarray:
    """(rows, d) hashed counts of 1 to 4 bytes of letters and word edges, by square root, rows of length 1."""
    n = len(offs) - 1
    low = _FOLD[buf]
    if len(low):
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)  # white space and signs collapse
        rows = np.repeat(np.arange(n), np.diff(offs))[keep]
        low = low[keep].astype(np.uint64)
    else:
        rows = np.zeros(0, np.int64)
    x = np.zeros(n * d, np.float32)
    code = np.zeros(len(low), np.uint64)
    for k in range(1, 5):
        m = len(low) - k + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | low[k - 1 :]
        ok = rows[:m] == rows[k - 1 :]
        h = (mix(code[ok] + np.uint64(k << 40)) % np.uint64(d)).astype(np.int64)
        x += np.bincount(rows[:m][ok] * d + h, minlength=n * d)
    x = np.sqrt(x, out=x).reshape(n, d)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm == 0, 1, norm)
    return x


class Hierarchy:
    """Families of languages and the machines between and within them."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.languages = sorted(set(lang))
        means = np.stack([x[lang == g].mean(axis=0) for g in self.languages])
        means -= means.mean(axis=0)
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        groups = [[i] for i in range(len(self.languages))]
        for _ in range(len(groups) - max(1, round(len(groups) ** 0.5))):  # average linkage down to the root of their number
            a, b = max(combinations(range(len(groups)), 2), key=lambda p: (means[groups[p[0]]] @ means[groups[p[1]]].T).mean())
            groups[a] = sorted(groups[a] + groups[b])
            del groups[b]
        self.families = [[self.languages[i] for i in g] for g in sorted(groups)]
        of = {g: f for f, gs in enumerate(self.families) for g in gs}
        self.between = self._machines(x, np.array([of[g] for g in lang]), range(len(self.families)))
        self.within = [self._machines(x, lang, gs) for gs in self.families]

    @staticmethod
    def _machines(x: np.ndarray, y: np.ndarray, names) -> dict:
        out = {}
        for a, b in combinations(names, 2):
            on = (y == a) | (y == b)
            out[a, b] = linear_svm(x[on], np.where(y[on] == a, 1.0, -1.0)).astype(np.float32)
        return out

    @staticmethod
    def _vote(x: np.ndarray, names: list, machines: dict) -> tuple[np.ndarray, np.ndarray]:
        """The place of the winner of most duels (ties: the larger sum of margins) and its least certainty in a duel."""
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        m = np.zeros((len(x), len(names), len(names)), np.float32)
        for (a, b), w in machines.items():
            i, j = names.index(a), names.index(b)
            m[:, i, j] = x @ w[:-1] + w[-1]
            m[:, j, i] = -m[:, i, j]
        best = ((m > 0).sum(axis=2) + np.tanh(m.sum(axis=2)) / 4).argmax(axis=1)
        own = m[np.arange(len(x)), best].astype(np.float64)
        own[np.arange(len(x)), best] = np.inf
        return best, sigmoid(SLOPE * own.min(axis=1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self._vote(x, list(range(len(self.families))), self.between)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for f, names in enumerate(self.families):
            on = np.flatnonzero(family == f)
            if len(on):
                best, inner = self._vote(x[on], names, self.within[f])
                lang[on] = np.array(names, object)[best]
                score[on] = sure[on] * inner
        return lang, score


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch, most=ROWS):
            x = ngram_features(buf, offs)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame) -> Hierarchy | None:
    """Learn from rows that are not held out: of each language the same number of unlike texts at most, taken by a hash of doc_id and text.

    No language is left out: with very many, each gives fewer rows. Rows that repeat count once, whatever their number.
    """
    known = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return None
    most = max(1, min(SAMPLE, TOTAL // len(counts)))
    # A share of each language that gives enough, copies merged where they lie; then the first of each by hash: 1.3 * TOTAL texts, or one a language.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.3 * most / r["count"] + 1e-3))])
    h = F.xxhash64("doc_id", "text")
    near = known.withColumn("h", h).where(F.pmod(F.hash("h"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).dropDuplicates(["lang", "h"])
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most)
    got = chosen.select("text", "lang").mapInArrow(_features, "lang string, x binary").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    x = np.frombuffer(got.column(1).combine_chunks().buffers()[2], np.float16, count=got.num_rows * FEATURES).reshape(got.num_rows, -1).astype(np.float32)
    lang = np.array(got.column(0).to_pylist(), object)
    del got
    pa.default_memory_pool().release_unused()
    order = np.lexsort((x[:, :8].sum(axis=1), lang.astype(str)))
    order = order[x[order].any(axis=1)]  # texts without letters teach nothing
    x, lang = x[order], lang[order]
    return Hierarchy(x, lang) if len(order) else None


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every text; only the text is an input of a prediction."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of a bounded number of machines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            letter = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, offs in text_blocks(batch, most=ROWS):
                lang, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model is not None:
                    lang, score = model.predict(ngram_features(buf, offs))
                lang[~letter[lo:hi]], score[~letter[lo:hi]] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Hierarchy | None, reject: float = REJECT, unsure: float = 0.0) -> DataFrame:
    """The documents that have a language, in all their columns, with ``lang`` as predicted; where there is none, it is added.

    Rejected are texts without letters and those whose prediction scores below ``reject``; those that score below ``unsure`` stay as ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    lang_at = names.index("lang") if "lang" in names else len(names)
    schema = docs.schema if "lang" in names else T.StructType([*docs.schema.fields, T.StructField("lang", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, offs in text_blocks(own, most=ROWS):
                if model is None:
                    continue
                lang, score = model.predict(ngram_features(buf, offs))
                lang[score < unsure] = "und"
                columns = own.slice(lo, hi - lo).columns
                columns[lang_at : lang_at + 1] = [pa.array(lang, pa.string())]
                part = pa.RecordBatch.from_arrays(columns, names=schema.names)
                yield part.filter(pa.array(letter[lo:hi] & (score >= reject)))
            del batch, own
        give_back()

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(f"siteloom_{uuid.uuid4().hex}")
    return docs.select(*docs.columns, letter).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
