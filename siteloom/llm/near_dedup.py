"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

Result for odd input: null or word-less texts have an empty set, link with nothing and are their own component;
equal sets are one class whatever their texts; rows that repeat a doc_id each get a row, and each is linked by its own
text (unlike texts of one doc_id are two documents, whose components may differ); a null doc_id never
names a component (its component is that of the documents with an equal set, else null, and ``kept`` compares
null-safely); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import join_facts, materialize, partitions, table
from .textvec import fast_sketch, give_back, mix, row_starts, shingle_sets, text_blocks

#: 44 bands of 5 coordinates: a pair at similarity 0.75 shares no band with probability 7e-6, at 0.8 with 3e-8.
BANDS, WIDTH = 44, 5
#: A pair at 0.75 agrees on fewer than this share of 220 coordinates with probability 4e-6; exact counts decide.
LEAST_AGREEMENT = 0.62
#: Documents of a bucket that are held while its others stream by, and where texts are, so many shingles of them.
BLOCK, HELD = 2048, 1 << 20
#: Bytes of shingle sets that a task remembers.
KNOWN = 64 << 20
SHINGLE = 5


def _folded(s: np.ndarray) -> np.ndarray:
    """One byte of each coordinate: unequal coordinates agree with probability 1/256."""
    return (mix(s) >> np.uint64(56)).astype(np.uint8)


def sketches(docs: DataFrame, shingle: int = SHINGLE, t: int = BANDS * WIDTH) -> DataFrame:
    """(doc_id, t, n_shingles, k1, k2, sketch): t tells texts of one doc_id apart, k1 and k2 are a 128-bit hash of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch):
                h, rows = shingle_sets(buf, offs, shingle)
                n = hi - lo
                at = row_starts(rows, n)
                k = []
                for salt in (1, 2):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h + np.uint64(salt)), out=total[1:])
                    k.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                s = _folded(fast_sketch(h, rows, n, t))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(at)), pa.array(k[0]), pa.array(k[1]), pa.array([x.tobytes() for x in s], pa.binary())], ["doc_id", "t", "n_shingles", "k1", "k2", "sketch"])
            del batch
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, n_shingles long, k1 long, k2 long, sketch binary")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: each row after the first of a run, with the run's first and the row before.

    Only the last row and the first of the open run are carried, so a bucket of any size streams through. The first and
    the last row of all come with themselves too: their runs may go on in another task.
    """
    key0 = pivot0 = prev0 = None
    for batch in batches:
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        goes_on = key0 is not None and key[0] == key0
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        pivot, prev = doc[start], np.empty_like(doc)
        prev[1:] = doc[:-1]
        on = ~new
        if key0 is None:
            prev[0], on[0] = doc[0], True
        if goes_on:
            new[0] = False
            pivot = np.where(start == 0, pivot0, pivot)
            prev[0], on[0] = prev0, True
        key0, pivot0, prev0 = key[-1], pivot[-1], doc[-1]
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (key, doc, pivot, prev)], ["key", "doc", "pivot", "prev"])
    if key0 is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key0, prev0, prev0, prev0)], ["key", "doc", "pivot", "prev"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        same = (a == b).sum(axis=1)
        on = same >= LEAST_AGREEMENT * a.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(on)), batch.column(1).filter(pa.array(on)), pa.array(same[on].astype(np.int32))], ["a", "b", "same"])


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a < b) whose sketches agree enough to need exact counts."""
    met = pairs.join(nodes.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a").join(nodes.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(_agreement, "a long, b long, same int")


def _cross(per_hundred: int, shingle: int, exact: bool):
    """Over rows sorted by (key, block, side): the held side of a block against all rows of its bucket that follow.

    A pair is taken up in the first band that it shares, if its labels differ and its sketches agree enough. Then its
    full sets decide, and nothing but confirmed links leaves; or, if not ``exact``, the rows of such pairs leave, as
    (key, document), so that only their texts need to be fetched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, held = None, [[], [], [], []]
        known: dict[int, np.ndarray] = {}
        size = 0

        def set_of(doc: int, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if doc not in known:
                if size >= KNOWN:
                    known.clear()
                    size = 0
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                known[doc] = shingle_sets(raw, np.array([0, len(raw)]), shingle)[0]
                size += known[doc].nbytes
            return known[doc]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, block, right, doc, label, lead = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            sketch = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(n, -1)
            text = np.empty(n, object)
            if exact:
                text[:] = list(batch.column(7))
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (right[1:] != right[:-1])
            cuts = np.append(np.flatnonzero(new), n)
            found: list[tuple[int, int]] = []
            rows: list[np.ndarray] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if at_block != (key[lo], block[lo]):
                    at_block, held = (key[lo], block[lo]), [[], [], [], []]
                if not right[lo]:
                    for x, part in zip(held, (doc, label, sketch, text), strict=True):
                        x.append(part[lo:hi])
                    continue
                if not held[0]:
                    continue
                d, lab, s, words = (x[0] if len(x) == 1 else np.concatenate(x) for x in held)
                for at in range(lo, hi, 64):
                    to = min(hi, at + 64)
                    far = (lab[:, None] != label[None, at:to]) & ((label[at:to] == lead[at:to])[None, :] | (d[:, None] < doc[None, at:to]))
                    i, j = np.nonzero(far)
                    for k in range(0, len(i), 1 << 14):
                        x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)] + at
                        same = s[x] == sketch[y]
                        first = same.reshape(len(x), BANDS, WIDTH).all(axis=2).argmax(axis=1)
                        on = (same.sum(axis=1) >= LEAST_AGREEMENT * s.shape[1]) & (first == (key[lo] & 63))
                        if not exact and on.any():
                            docs = np.unique(np.concatenate([d[x[on]], doc[y[on]]]))
                            rows.append(np.column_stack([np.full(len(docs), key[lo]), docs]))
                            continue
                        for p, q in zip(x[on], y[on], strict=True):
                            if _alike(set_of(d[p], words[p]), set_of(doc[q], text[q]), per_hundred):
                                found.append((d[p], doc[q]))
            if rows:
                a, b = np.unique(np.concatenate(rows), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["key", "doc"])
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, per_hundred: int) -> bool:
    most = min(len(x), len(y))
    if 100 * most < per_hundred * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= per_hundred * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, per_hundred: int, shingle: int) -> DataFrame:
    """The pairs with 100 * intersection >= per_hundred * union on their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch, "ta", 1 << 19):
                ha, ra = shingle_sets(buf, offs, shingle)
                part = batch.slice(lo, hi - lo)
                on = np.zeros(hi - lo, bool)
                at = row_starts(ra, hi - lo)
                for l2, h2, buf2, offs2 in text_blocks(part, "tb", 1 << 19):
                    hb, rb = shingle_sets(buf2, offs2, shingle)
                    bt = row_starts(rb, h2 - l2)
                    for i in range(h2 - l2):
                        x, y = ha[at[l2 + i] : at[l2 + i + 1]], hb[bt[i] : bt[i + 1]]
                        on[l2 + i] = _alike(x, y, per_hundred)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(on)), part.column(1).filter(pa.array(on))], ["a", "b"])
        give_back()

    met = pairs.select("a", "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, per_hundred: int, shingle: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, lead_t): lead_t is the text that stands for the component.

    1. Sketch every document; equal sets are a class, which goes on as one node.
    2. Band the sketches and sort the buckets by range, which splits a large bucket over tasks. In a bucket, each
       node meets its first and its previous one; of all it met, it tries the one that agrees most.
    3. Exact counts confirm; components label the nodes.
    4. Wherever a bucket still holds several labels, all its pairs of unlike labels are tried too. So every pair
       that shares a bucket is confirmed, refuted, or already in one component; copies never expand into pairs.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sk = materialize(sketches(docs, shingle), "sketches")
    classes = sk.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("rep"), F.max("n_shingles").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("t"), "n"), "classes")
    reps = classes.where("rep is not null").select(F.col("node").alias("doc"), F.col("rep").alias("doc_id"), "t", "n")
    nodes = materialize(sk.select("doc_id", "t", "sketch").join(reps, ["doc_id", "t"]).select("doc", "n", "sketch"), "nodes")
    banded = nodes.select(
        "doc",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring("sketch", b * WIDTH + 1, F.lit(WIDTH))).bitwiseAND(F.lit(-64)).bitwiseOR(b.cast("long")))).alias("key"),  # the low bits name the band
    )
    members = banded.select("key", "doc").repartitionByRange(partitions(spark), "key", "doc").sortWithinPartitions("key", "doc").mapInArrow(_neighbours, "key long, doc long, pivot long, prev long")
    members = materialize(members, "members")

    met = members.select(F.explode(F.array(F.struct(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")), F.struct(F.least("doc", "prev").alias("a"), F.greatest("doc", "prev").alias("b")))).alias("p")).select("p.a", "p.b")
    likely = _agreeing(met.where("a <> b").distinct(), nodes)
    best = likely.groupBy("b").agg(F.max_by("a", "same").alias("a")).select("a", "b")

    in_buckets = members.select("doc").unionByName(members.select(F.col("pivot").alias("doc"))).distinct()
    named_by = reps.join(in_buckets, "doc", "left_semi").select("doc", "doc_id", "t")
    texts = materialize(docs.withColumn("t", F.xxhash64("text")).join(named_by, ["doc_id", "t"]).select("doc", "text"), "bucket-texts")
    links = materialize(verified(best, texts, per_hundred, shingle), "links")
    labels = components(links, "labels")

    # Unlike labels in one bucket: pairs that have at least one side outside the bucket's leading label.
    rows = members.select("key", "doc").unionByName(members.select("key", F.col("pivot").alias("doc"))).distinct()
    named = rows.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    named = materialize(named, "bucket-labels")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    lead = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("lead"), F.count("*").alias("labels")).where("labels > 1")
    open_ = materialize(named.join(lead.select("key", "lead"), "key").join(nodes, "doc"), "open-buckets")
    order = ["key", "block", "side"]

    def dealt(rows: DataFrame, counted: str, *more: str) -> DataFrame:
        """The side that is held is dealt into blocks; the bucket's rows go to each of its blocks."""
        blocks = rows.where("label <> lead").groupBy("key").agg(F.expr(f"cast({counted} as int)").alias("blocks"))
        rows = rows.join(blocks, "key")
        held = rows.where("label <> lead").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("side", F.lit(False))
        passing = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(True))
        return held.unionByName(passing).select(*order, "doc", "label", "lead", "sketch", *more).repartition(partitions(spark), "key", "block").sortWithinPartitions(*order)

    promising = materialize(dealt(open_, f"ceil(count(*) / {BLOCK})").mapInArrow(_cross(per_hundred, shingle, exact=False), "key long, doc long").distinct(), "promising")
    few = open_.join(promising, ["key", "doc"], "left_semi").join(texts, "doc")
    more = dealt(few, f"greatest(ceil(count(*) / {BLOCK}), ceil(sum(n) / {HELD}))", "text").mapInArrow(_cross(per_hundred, shingle, exact=True), "a long, b long")

    final = materialize(components(links.unionByName(materialize(more, "cross-links")), "components"), "labelled")
    leads = final.join(classes.select("node", "rep", "t"), "node").groupBy("label").agg(F.min(F.struct("rep", "t")).alias("lead"))
    of_node = join_facts(final, leads, ["label"], by="node").select("node", F.col("lead.rep").alias("component_id"), F.col("lead.t").alias("lead_t"))
    of_class = classes.join(of_node, "node", "left").select("k1", "k2", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("lead_t", classes["t"]).alias("lead_t"))
    own = sk.select("doc_id", "t", "n_shingles", "k1", "k2")
    out = join_facts(own.where("n_shingles > 0"), of_class, ["k1", "k2"]).select("doc_id", "t", "n_shingles", "component_id", "lead_t")
    return out.unionByName(own.where("n_shingles = 0").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"), F.col("t").alias("lead_t")))


def near_duplicates(docs: DataFrame, per_hundred: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    out = _grouped(docs, per_hundred, shingle).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, per_hundred: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """The documents of which one stays for each component, in all their columns; of rows that repeat doc_id and text, one.

    A document without an id cannot be named by a component and stays. The texts are shuffled once, by doc_id and a
    hash of the text.
    """
    found = _grouped(docs, per_hundred, shingle)
    gone = found.where("doc_id is not null and not (doc_id <=> component_id and t = lead_t)").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct()
    t, alone = (f"siteloom_{uuid.uuid4().hex}" for _ in range(2))
    own = docs.withColumn(t, F.xxhash64("text")).withColumn(alone, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))  # rows without an id are no copies of each other
    return own.join(gone, (own["doc_id"] == gone["gone_id"]) & (own[t] == gone["gone_t"]), "left_anti").dropDuplicates(["doc_id", t, alone]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
