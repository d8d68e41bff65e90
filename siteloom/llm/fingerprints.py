"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence of names into phrases by looking only at a few neighbours; phrases get
names of their own, which are cut again. So equal substrings get equal phrases inside, wherever they stand. The
fingerprint is a fast similarity sketch of a document's phrase names.

Result for odd input: null and empty texts have the fingerprint of no phrases, which is like itself (1.0) and
unlike all others (0.0); the next document of the last is the first, of a single document itself; rows that repeat a
doc_id are ordered by their text; null doc_ids come last; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table
from .textvec import fast_sketch, mix, powers, _Q, _QI

COORDINATES = 64
#: Names of these levels make the set: phrases of about 10, 35 and 120 characters.
LEVELS = (2, 3, 4)


def _labels(x: np.ndarray, first: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Labels below 6 such that neighbours differ: each round names the lowest bit in which a name differs from the one before."""
    v = x
    for _ in range(rounds):
        before = np.empty_like(v)
        before[1:] = v[:-1]
        before[first] = ~v[first]  # as if the least bit differed
        diff, one = v ^ before, v.dtype.type(1)
        low = diff & (~diff + one)
        k = np.bitwise_count(low - one).astype(v.dtype)
        v = ((k << one) | ((v >> k) & one)).astype(np.uint8)  # below 128 from the first round on
    return v


def _level(x: np.ndarray, rows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of the next level, and their rows."""
    salt = np.uint64(level)
    # Runs of one name become a single name first, so neighbours always differ.
    n = len(x)
    head = np.ones(n, bool)
    head[1:] = (x[1:] != x[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n)).astype(np.uint64)
    x, rows = np.where(size == 1, x[at], mix(x[at] ^ mix(size + salt))), rows[at]
    n = len(x)
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    label = _labels(x, first)
    up = np.zeros(n, bool)  # strictly greater than the label before and not less than the one after, within the row
    up[1:] = label[1:] > label[:-1]
    down = np.ones(n, bool)
    down[:-1] = (label[:-1] >= label[1:]) | first[1:]
    cut = first | (up & down)
    at = np.flatnonzero(cut)
    end = np.append(at[1:], n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(x + salt) * powers(_Q, n), out=total[1:])
    names = mix((total[end] - total[at]) * powers(_QI, n + 1)[at] + (end - at).astype(np.uint64))
    return names, rows[at]


def phrase_names(points: np.ndarray, rows: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The names of the given levels over code points sorted by row, as often as they come, with their rows, sorted by row."""
    x, r = mix(points.astype(np.uint64) + np.uint64(1)), rows
    names, owners = [], []
    for level in range(1, max(levels) + 1):
        if not len(x):
            break
        x, r = _level(x, r, level)
        if level in levels:
            names.append(mix(x + np.uint64(level)))
            owners.append(r)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, owners = np.concatenate(names), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return names[order], owners[order]


def fingerprints(texts: list[str], t: int = COORDINATES) -> np.ndarray:
    """A row of t 16-bit coordinates for each text; texts of no characters have all ones."""
    lengths = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, owners = phrase_names(points, np.repeat(np.arange(len(texts)), lengths))
    s = fast_sketch(names, owners, len(texts), t)
    out = (mix(s) >> np.uint64(48)).astype(np.uint16)
    out[lengths == 0] = 0xFFFF
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of coordinates in which fingerprints agree."""
    return (a == b).mean(axis=1)


def _hex(f: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in f]


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's fingerprint."""
    for batch in batches:
        for lo, hi in _runs(batch, 1):
            part = batch.slice(lo, hi - lo)
            f = fingerprints([x.as_py() or "" for x in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in f], pa.binary())], ["doc_id", "text", "fp"])


def _runs(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about half a million bytes."""
    lo = size = 0
    for i in range(batch.num_rows):
        size += sum(len(batch.column(c)[i].as_buffer() or b"") for c in columns if batch.column(c)[i].is_valid)
        if size >= 1 << 19:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < batch.num_rows:
        yield lo, batch.num_rows


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in _runs(batch, 1, 3):
            part = batch.slice(lo, hi - lo)
            own, nxt = ([x.as_py() or "" for x in part.column(i)] for i in (1, 3))
            f, g = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(hi - lo, -1) for i in (2, 4))
            edited = [edited_text(a, b) for a, b in zip(own, nxt, strict=True)]
            e = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(_hex(f)), pa.array(_hex(e)), pa.array(likeness(f, e)), pa.array(likeness(f, g))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _greater(cuts: list[int], value: F.Column) -> F.Column:
    """How many of the descending cuts are greater than a value: found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads, bodies = F.array(*[F.lit(r[0]) for r in runs]), F.array(*[F.array(*[F.lit(x) for x in r]) for r in runs])
    within = lambda k: F.when(k == 0, 0).otherwise((k - 1) * width + F.size(F.filter(F.get(bodies, k - 1), lambda b: b > value)))
    return F.get(F.transform(F.array(F.size(F.filter(heads, lambda b: b > value))), within), F.lit(0))


def following(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): text and fingerprint of the next row in descending doc_id; after the last, the first.

    Rows are dealt into buckets of neighbouring doc_ids of about equal size; the first row of each bucket is dealt to
    the one before it as well. So no task sees more than its bucket, and each text moves once.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text").mapInArrow(_own, "doc_id long, text string, fp binary").withColumnRenamed("doc_id", "id")
    docs = docs.select(F.col("doc_id").alias("id"))
    n = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds and first rows: a few longs a bucket, whatever the size of the table.
    cuts = docs.select(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), F.lit(max(10_000, 50 * n)))).first()[0] or []
    cuts = sorted({int(x) for x in cuts}, reverse=True)
    place = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(_greater(cuts, F.col("id")))
    dealt = own.select("id", "text", "fp", place.alias("bucket"))
    heads = {r["bucket"]: r["id"] for r in docs.select("id", place.alias("bucket")).groupBy("bucket").agg(F.max("id").alias("id")).collect()}
    order = sorted(heads)
    if not order:
        return own.select(F.col("id").alias("doc_id"), "text", "fp", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    before = {b: order[i - 1] for i, b in enumerate(order)}
    # The head rows: those of the greatest id in a bucket (all that share it; order below takes the first).
    places = range(max(order) + 1)
    head = F.array(*[F.lit(before.get(b)).cast("int") for b in places])
    top = F.array(*[F.lit(heads.get(b)).cast("long") for b in places])
    copies = F.when(F.col("id").eqNullSafe(F.get(top, F.col("bucket"))), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("extra")), F.struct(F.get(head, F.col("bucket")).alias("b"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("extra"))))
    rows = dealt.select("id", "text", "fp", F.explode(copies).alias("c")).select("id", "text", "fp", "c.b", "c.extra")
    w = Window.partitionBy("b").orderBy(F.col("extra"), F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return rows.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where("not extra").select(F.col("id").alias("doc_id"), "text", "fp", "next_text", "next_fp")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited text, and their likeness to each other and to the next document."""
    return following(docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
