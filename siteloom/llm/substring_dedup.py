"""Removal of passages that an earlier document has, by level-wise doubling of repeated windows.

A level has windows of one length, and those of its windows that repeat between texts name the candidates of twice
that length: half the window asked for, the window itself, and on until no candidate survives.

Result for odd input: null texts have no words (n_words 0, the hash of nothing); texts shorter than a window keep
all words; texts that share a doc_id are one document to each other (neither is smaller), each is judged by its own
words and gets a row of its own; a null doc_id is neither smaller nor greater than any, so such a row keeps its words
and removes none elsewhere; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_facts, materialize, table
from .textvec import _Q, _QI, mix, powers, row_starts, span_hash, text_blocks, window_hash, word_spans

WINDOW = 50


def _least_of(v: np.ndarray, width: int) -> np.ndarray:
    """Element i: the least of v[i:i+width]."""
    have, size = v, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(v) - width + 1], have[width - size : len(v) - size + 1])


def _anchors(words: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that lie in one row (their first words), and the anchor of each.

    A window's anchor is the least hash of its half-length windows: equal windows have equal anchors wherever they
    stand, and neighbouring windows mostly share theirs, so one half-length window in seven or so is an anchor.
    """
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    half = window // 2
    least = _least_of(window_hash(words, half), window - half + 1)
    at = np.flatnonzero(rows[: len(words) - window + 1] == rows[window - 1 :])
    return at, least[at]


def _whole(words: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    h = mix(words + np.uint64(salt))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) * powers(_QI, len(h) + 1)[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _read(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(buf, offs)
    return span_hash(buf, starts, ends), rows, row_starts(rows, len(offs) - 1)


def anchored(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, t, n_words, k1, k2, anchors): the distinct anchors of each text, k1 and k2 a hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch):
                words, rows, at = _read(buf, offs)
                i, a = _anchors(words, rows, window)
                r = rows[i] if len(i) else np.zeros(0, np.int64)
                if len(a):
                    first = np.ones(len(a), bool)
                    first[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                    a, r = a[first], r[first]
                lists = pa.ListArray.from_arrays(pa.array(row_starts(r, hi - lo).astype(np.int32)), pa.array(a.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(_whole(words, at, 1)), pa.array(_whole(words, at, 2)), lists], ["doc_id", "t", "n_words", "k1", "k2", "anchors"])

    return docs.mapInArrow(run, "doc_id long, t long, n_words long, k1 long, k2 long, anchors array<long>")


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(row_starts(rows, n).astype(np.int32)), pa.array(values))


def _windows(window: int):
    """From (doc_id, t, text, anchors): the windows of each text whose anchor is among the repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch):
                words, rows, at = _read(buf, offs)
                i, a = _anchors(words, rows, window)
                part = batch.slice(lo, hi - lo)
                on = np.zeros(len(i), bool)
                cut = row_starts(rows[i], hi - lo)
                for r, wanted in enumerate(part.column(3)):
                    on[cut[r] : cut[r + 1]] = np.isin(a[cut[r] : cut[r + 1]], wanted.values.to_numpy().view(np.uint64))
                i = i[on]
                h, g = window_hash(words, window)[i], (window_hash(mix(words + np.uint64(7)), window)[i] >> np.uint64(33)).astype(np.int32)
                owner = rows[i]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(owner, hi - lo, (i - at[owner]).astype(np.int32)), _lists(owner, hi - lo, h.view(np.int64)), _lists(owner, hi - lo, g)], ["doc_id", "t", "pos", "h", "g"])

    return run


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of rows that come in two documents, and the least of these: aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").drop("most")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Level ``window // 2`` alone names the candidates of level ``window``.

    ``docs`` are (doc_id, t, text), t a hash of the text. Returns the texts as (doc_id, t, n_words, first) - first is
    the least doc_id with the very same words - and the candidates (doc_id, t, pos, h, g), lists in order of position,
    one copy standing for all equal texts.
    """
    own = materialize(anchored(docs, window), "half-windows")
    same = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    whole = join_facts(own.select("doc_id", "t", "n_words", "k1", "k2"), same, ["k1", "k2"]).select("doc_id", "t", "n_words", "first")
    standing = own.where("doc_id is not null").join(whole.where("first < doc_id").select("doc_id", "t"), ["doc_id", "t"], "left_anti").select("doc_id", "t", F.explode("anchors").alias("a"))
    standing = materialize(standing, "anchors")
    wanted = join_facts(standing, repeated(standing, ["a"]), ["a"]).groupBy("doc_id", "t").agg(F.collect_set("a").alias("anchors"))
    return whole, docs.join(wanted, ["doc_id", "t"]).select("doc_id", "t", "text", "anchors").mapInArrow(_windows(window), CANDIDATES)


CANDIDATES = "doc_id long, t long, pos array<int>, h array<long>, g array<int>"


def _twice(pos: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of twice the length all of whose windows are candidates (their places in ``pos``), and the anchor of each."""
    if len(pos) <= length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(pos[length:] - pos[:-length] == length)
    return at, _least_of(h, length + 1)[at]


def _doubled_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_twice(p.values.to_numpy(), h.values.to_numpy().view(np.uint64), length)[1]) for p, h in zip(batch.column(2), batch.column(3), strict=True)]
            sizes = np.array([len(a) for a in found])
            if sizes.sum():
                of = np.repeat(np.arange(len(found)), sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "t", "a"])

    return run


def _double(length: int):
    """From candidates of a length and their repeated anchors: the candidates of twice that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, hashes = [], []
            for p, h, wanted in zip(batch.column(2), batch.column(3), batch.column(5), strict=True):
                p, h = p.values.to_numpy(), h.values.to_numpy().view(np.uint64)
                at, a = _twice(p, h, length)
                at = at[np.isin(a, wanted.values.to_numpy().view(np.uint64))]
                pos.append(p[at])
                hashes.append(mix(h[at] * _Q + h[at + length]))
            owner = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
            if len(owner):
                lists = [_lists(owner, len(pos), x) for x in (np.concatenate(pos), np.concatenate(hashes).view(np.int64), np.zeros(len(owner), np.int32))]
                some = pa.array(np.bincount(owner, minlength=len(pos)) > 0)
                yield pa.RecordBatch.from_arrays([x.filter(some) for x in (batch.column(0), batch.column(1), *lists)], ["doc_id", "t", "pos", "h", "g"])

    return run


def doubled(candidates: DataFrame, length: int) -> Iterator[tuple[int, DataFrame]]:
    """Levels (length, candidates) while any survive, each twice as long as the one before.

    A window of twice the length has as its anchor the least hash of its windows of this length, so anchors are few;
    those that repeat between documents alone name the next candidates, whose hashes are made of two that adjoin.
    """
    while not candidates.isEmpty():
        yield length, candidates
        anchors = materialize(candidates.mapInArrow(_doubled_anchors(length), "doc_id long, t long, a long"), f"anchors-{length}")
        wanted = join_facts(anchors, repeated(anchors, ["a"]), ["a"]).groupBy("doc_id", "t").agg(F.collect_set("a").alias("anchors"))
        candidates = materialize(candidates.join(wanted, ["doc_id", "t"]).select("doc_id", "t", "pos", "h", "g", "anchors").mapInArrow(_double(length), CANDIDATES), f"level-{2 * length}")
        length *= 2


def _keep(window: int):
    """From (doc_id, text, all_gone, starts, longest): what is left when the windows at ``starts`` are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest, longest = [], [], [], []
            for text, gone, starts, most in zip(*batch.columns[1:5], strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if gone.as_py():
                    kept = []
                elif starts.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    covered = np.cumsum(step)[:-1] > 0
                    kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                longest.append(len(words) if gone.as_py() else most.as_py() or 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(longest, pa.int64())], ["doc_id", "n_words", "n_removed", "kept_sha256", "longest"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, longest): words in a window that also starts in a smaller doc_id go.

    Windows are judged on the input. ``longest`` is the last level, ``window`` times a power of two, at which the
    text still had a candidate, 0 without one, and all its words for a copy of a text with a smaller doc_id.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    whole, found = repeated_windows(docs, window)
    found = materialize(found, "windows")
    each = found.select("doc_id", "t", F.explode(F.arrays_zip("pos", "h", "g")).alias("w")).select("doc_id", "t", "w.*")
    hits = join_facts(each, repeated(each, ["h", "g"]), ["h", "g"]).where("least < doc_id").groupBy("doc_id", "t").agg(F.collect_list("pos").alias("starts"))
    lengths = None
    for length, level in doubled(found, window):
        now = level.select("doc_id", "t", F.lit(length).cast("long").alias("longest"))
        lengths = now if lengths is None else lengths.unionByName(now)
    gone = whole.where(f"first < doc_id and n_words >= {window}").select("doc_id", "t", F.lit(True).alias("all_gone")).distinct()
    marks = hits.join(gone, ["doc_id", "t"], "full_outer")
    if lengths is None:
        marks = marks.withColumn("longest", F.lit(None).cast("long"))
    else:
        marks = marks.join(lengths.groupBy("doc_id", "t").agg(F.max("longest").alias("longest")), ["doc_id", "t"], "full_outer")
    known = docs.where("doc_id is not null").join(marks, ["doc_id", "t"], "left").select("doc_id", "text", "all_gone", "starts", "longest")
    unknown = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("boolean").alias("all_gone"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("long").alias("longest"))
    return known.unionByName(unknown).mapInArrow(_keep(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
