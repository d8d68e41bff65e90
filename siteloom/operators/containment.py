"""Which texts of a corpus hold the sentences of others: an index of probes instead of comparing texts in pairs.

A probe is the first seven words of a sentence, as ``content.matchable`` writes them. A text holds it if the probe
stands in its own words: the first one at the end of a word, the last one at the beginning of one, all between as they
are. So the words between, with the letters next to them, are the key by which probes and texts meet in an equi-join of
hashes; the strings are compared on what met. What a text has and no probe does, a bitmap of all keys keeps from being
moved at all. Probes of one or two words, which have no words between, meet pieces of words instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import written
from . import content as C

#: Words of a probe.
PROBE = 7
#: Bits of the bitmap for each key, and of the whole bitmap at most: beyond, more of a text's runs are moved, none is lost.
BITS, MOST_BITS = 32, 1 << 28
#: Places of a key in the bitmap: its last bits, after so many shifts.
SHIFTS = (0, 17, 34)
#: Bytes of texts that are looked at together, about.
BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)


def _words(text: Column) -> Column:
    return F.filter(F.split(C.matchable(text), " "), lambda w: w != "")


def _sentences(texts: DataFrame) -> DataFrame:
    """(scope, id, probe) of each sentence; those without a word have none."""
    probe = F.transform(C.sentences(F.col("text"), None), lambda s: F.array_join(F.slice(_words(s), 1, PROBE), " "))
    return texts.select("scope", "id", F.explode(probe).alias("probe")).where("probe <> ''")


def sentence_probes(texts: DataFrame) -> DataFrame:
    """(scope, id, probe, n): the probes of each text's sentences and how many sentences begin so."""
    return _sentences(texts).groupBy("scope", "id", "probe").agg(F.count("*").alias("n"))


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _block_runs(texts: list[bytes], seeds: np.ndarray, sizes: range, whole: bool, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, key, run) of runs of so many words, two at least: the run's key hashes its inner words and the letter on either side of them.

    ``whole``: only those that are a whole text; ``bitmap``: only keys that it has.
    """
    offs = np.cumsum([0, *map(len, texts)])
    joined = b"".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf * _powers(_R, len(buf)), out=sums[1:], dtype=np.uint64)
    back = _powers(_R_INVERSE, len(buf) + 1)
    spaces, full = np.flatnonzero(buf == 32), np.diff(offs) > 0
    start, end = np.sort(np.concatenate([offs[:-1][full], spaces + 1])), np.sort(np.concatenate([offs[1:][full], spaces]))
    row = np.searchsorted(offs, start, "right") - 1
    found = []
    for n in sizes:
        at = np.arange(max(0, len(start) - n + 1))
        at = at[row[at] == row[at + n - 1]]
        if whole:
            at = at[(start[at] == offs[row[at]]) & (end[at + n - 1] == offs[row[at] + 1])]
        lo, hi = end[at] - 1, start[at + n - 1] + 1
        key = _mixed((sums[hi] - sums[lo]) * back[lo] ^ seeds[row[at]])
        if bitmap is not None:
            for shift in SHIFTS:
                k = key >> np.uint64(shift) & np.uint64(8 * len(bitmap) - 1)
                on = (bitmap[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, key = at[on], key[on]
        found.append((row[at], key, start[at], end[at + n - 1]))
    rows, keys, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, keys, [joined[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def _runs(df: DataFrame, sizes: range, whole: bool, bitmap: np.ndarray | None = None) -> DataFrame:
    """The columns of ``df`` (scope, words, ...) but the words, with ``key`` and ``run`` for each run of these."""
    held = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)
    others = [c for c in df.columns if c != "words"]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField("key", T.LongType()), T.StructField("run", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            words = batch.column(1).cast(pa.binary())
            ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(words):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
                rows, keys, found = _block_runs(words.slice(lo, hi - lo).to_pylist(), seeds[lo:hi], sizes, whole, held.value if held else None)
                at = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays([*[batch.column(2 + i).take(at) for i in range(len(others))], pa.array(keys.view(np.int64)), pa.array(found, pa.binary()).cast(pa.string())], names=schema.names)
                lo = hi

    return df.where("scope is not null").select(F.xxhash64("scope").alias("seed"), F.coalesce("words", F.lit("")).alias("words"), *others).mapInArrow(run, schema)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the keys, by their last bits: put together on the executors, of bounded size on the driver."""
    n = keys.count()
    bits = 1 << 15
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2
    at = keys.select(F.explode(F.array(*[F.shiftrightunsigned("key", x).bitwiseAND(F.lit(bits - 1)) for x in SHIFTS])).alias("k"))
    parts = at.groupBy(F.shiftright("k", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts.toArrow().to_pylist():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _pid() -> tuple[Column, Column]:
    """128 bits of a probe and its scope, which stand for both where only equality counts."""
    return F.xxhash64("scope", "probe").alias("pid"), F.xxhash64("probe", F.lit("siteloom"), "scope").alias("pid2")


def _unlike(probes: DataFrame) -> DataFrame:
    """(scope, probe) of ``probes``, each once; written."""
    return written(probes.select("scope", "probe").where("scope is not null").distinct(), "probes")


def _pairs(p: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, probe, id) of every text of (scope, id, text) that holds a probe of ``p``, in the same scope; may come more than once."""
    t = texts.select("scope", C.matchable(F.col("text")).alias("words"), "id")
    n = F.size(F.split("probe", " "))
    asked = p.select("scope", F.col("probe").alias("words"))

    def met(sizes: range) -> tuple[DataFrame, DataFrame]:
        keyed = _runs(asked, sizes, whole=True)
        return keyed.withColumnRenamed("run", "probe"), _runs(t, sizes, False, _bitmap(keyed))

    keyed, runs = met(range(3, PROBE + 1))
    found = [runs.join(keyed, ["scope", "key"]).where(F.contains("run", "probe")).select("scope", "probe", "id")]
    p = p.withColumn("words", F.split("probe", " "))
    n = F.size("words")
    two, one = p.where(n == 2), p.where(n == 1)
    if two.limit(1).count():
        shapes = two.select("scope", F.length(F.col("words")[0]).alias("l"), F.length(F.col("words")[1]).alias("r")).distinct().groupBy("scope").agg(F.collect_list(F.struct("l", "r")).alias("shapes"))
        a, b = F.split("run", " ")[0], F.split("run", " ")[1]
        pairs = met(range(2, 3))[1].select("scope", "id", F.struct(a.alias("a"), b.alias("b")).alias("w")).distinct().join(shapes, "scope")
        cut = pairs.select("scope", "id", "w", F.explode("shapes").alias("s")).where("length(w.a) >= s.l and length(w.b) >= s.r")
        found.append(cut.select("scope", "id", F.expr("concat(right(w.a, s.l), ' ', left(w.b, s.r))").alias("probe")).join(two.select("scope", "probe"), ["scope", "probe"]).select("scope", "probe", "id"))
    if one.limit(1).count():
        sizes = one.select("scope", F.length("probe").alias("l")).distinct().groupBy("scope").agg(F.collect_set("l").alias("sizes"))
        words = t.join(F.broadcast(sizes), "scope").select("scope", "id", "sizes", F.explode(F.array_distinct(F.filter(F.split("words", " "), lambda w: w != ""))).alias("w"))
        cut = words.select("scope", "id", "w", F.explode("sizes").alias("l")).where("length(w) >= l").select("scope", "id", F.explode(F.expr("transform(sequence(1, length(w) - l + 1), i -> substring(w, i, l))")).alias("probe"))
        found.append(cut.join(one.select("scope", "probe"), ["scope", "probe"]).select("scope", "probe", "id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def holders(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, probe, id) of every text of (scope, id, text) that holds a probe of (scope, probe), in the same scope."""
    return _pairs(_unlike(probes), texts).distinct()


def absences(texts: DataFrame) -> DataFrame:
    """(scope, id, texts, sentences, absences, alone) of each text of (scope, id, text) that has sentences.

    ``texts`` are those of its scope; ``absences`` sums up over all other ones which of its sentences they lack; ``alone``
    are its sentences that no other one has. Pairs of texts are counted, not made: a sentence that all pages of a host
    share costs a row a page.
    """
    texts = written(texts.select("scope", "id", "text"), "texts")
    own = _sentences(texts)
    sizes = texts.groupBy("scope").agg(F.count("*").alias("texts"))
    held = _pairs(_unlike(own), texts).select(*_pid(), "id").distinct().groupBy("pid", "pid2").agg(F.count("*").alias("held"))
    met = own.select("scope", "id", *_pid(), F.lit(1).alias("n")).join(held, ["pid", "pid2"]).join(sizes, "scope")
    return met.groupBy("scope", "id").agg(F.first("texts").alias("texts"), F.sum("n").alias("sentences"), F.sum(F.col("n") * (F.col("texts") - F.col("held"))).alias("absences"), F.sum(F.when(F.col("held") == 1, F.col("n")).otherwise(0)).alias("alone"))


def absent_between(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, other, sentences, present, absent): sentences of ``ours`` (id, text) in each text of ``theirs`` that holds any of them.

    Pairs that are not there share nothing: all sentences are absent.
    """
    one = F.lit("").alias("scope")
    own = written(sentence_probes(ours.select(one, "id", "text")), "sentence-probes")
    totals = own.groupBy("id").agg(F.sum("n").alias("sentences"))
    held = holders(own, theirs.select(one, "id", "text")).select("probe", F.col("id").alias("other"))
    met = own.join(held, "probe").groupBy("id", "other").agg(F.sum("n").alias("present")).join(totals, "id")
    return met.select("id", "other", "sentences", "present", (F.col("sentences") - F.col("present")).alias("absent"))
