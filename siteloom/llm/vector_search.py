"""Nearest neighbours by additive quantisation.

Full-dimensional residual codebooks, learned on a bounded sample, approximate a unit vector by a sum of one entry of
each; a beam search picks the entries. A query's inner products with all entries make a lookup table, by which codes
are scored; the members of the best codes are compared exactly.

Result for odd input: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part; rows that repeat a vec_id are queries and candidates each, and none of them its own; null vec_ids take no
part; with fewer candidates than asked for, all are returned; an empty table gives an empty result; extra columns are
ignored. Components of any finite size count: vectors are scaled by a power of two, which changes no cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

#: Rows from which codebooks are learned, at most.
SAMPLE = 8192
BOOKS, ENTRIES, BEAM = 16, 256, 4
#: Vectors that are scored at once, and how many of their distinct codes a query looks into.
BLOCK, CODES = 8192, 400
#: Queries of a pass over the index, about: so many are on the driver and sent to the executors at a time. And queries
#: whose lookup tables a task holds at once.
QUERIES, TABLES = 32768, 256


def learn(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Codebooks (books, entries, dimension): k-means of what the books before leave over."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        k = min(entries, len(rest))
        c = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = (rest @ c.T * 2 - (c * c).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(n)
            sums = np.add.reduceat(rest[order], np.concatenate([[0], np.cumsum(n[filled])[:-1]]), axis=0)
            c[filled] = sums / n[filled, None]
        rest -= c[(rest @ c.T * 2 - (c * c).sum(axis=1)).argmax(axis=1)]
        out.append(np.pad(c, ((0, entries - k), (0, 0)), mode="edge"))
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books): the best sum found by a beam over the books."""
    n, (m, k, d) = len(x), books.shape
    rest, codes, alive = x.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8), 1
    for b in range(m):
        c = books[b]
        cost = (c * c).sum(axis=1)[None, None, :] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, alive, k) + (rest * rest).sum(axis=2)[:, :, None]
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        src, entry = best // k, best % k
        row = np.arange(n)[:, None]
        rest = rest[row, src] - c[entry]
        codes = np.concatenate([codes[row, src], entry[:, :, None].astype(np.uint8)], axis=2)
        alive = keep
    last = (rest * rest).sum(axis=2).argmin(axis=1)
    return codes[np.arange(n), last]


def _vectors(col: pa.Array) -> np.ndarray:
    """Rows of a list column, each scaled by the power of two that brings its largest component below 1."""
    x = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def valid_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    df = df.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    length = df.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.where(F.size("embedding") == (length[0]["n"] if length else 0))


def build_index(df: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, embedding, norm, codes) of every vector that takes part, and the codebooks."""
    df = valid_vectors(df)
    sample = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    if not sample.num_rows:
        return df.select("vec_id", "embedding", F.lit(0.0).alias("norm"), F.lit(b"").alias("codes")), None
    x = _vectors(sample.column(0).combine_chunks())
    books = learn(x / np.linalg.norm(x, axis=1, keepdims=True))
    held = df.sparkSession.sparkContext.broadcast(books)  # of fixed size: books * entries * dimension floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = _vectors(part.column(1))
                norm = np.linalg.norm(x, axis=1)
                codes = encode(x / norm[:, None], held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(norm), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "norm", "codes"])

    return materialize(df.mapInArrow(run, "vec_id long, embedding array<double>, norm double, codes binary"), "index"), books


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(held, k: int, codes_in: int | None, first: int):
    """One pass of a partition of the index against the queries sent along; keeps k for each query. Queries are numbered from ``first``: ids may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, q_ids, q = held.value
        q_norm = np.linalg.norm(q, axis=1)
        unit = (q / q_norm[:, None]).astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)

        def scan(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids, x, norm = t.column(0).to_numpy(), _vectors(t.column(1).combine_chunks() if t.column(1).num_chunks != 1 else t.column(1).chunk(0)), t.column(2).to_numpy()
            raw = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            codes, member = np.unique(raw, axis=0, return_inverse=True)
            member = member.ravel()
            order = np.argsort(member, kind="stable")
            start = np.searchsorted(member[order], np.arange(len(codes) + 1))
            flat = codes.astype(np.int64) + np.arange(codes.shape[1]) * books.shape[1]
            every = codes_in is None or len(codes) <= codes_in
            for lo in range(0, len(q), TABLES):
                tables = None if every else np.einsum("qd,mkd->qmk", unit[lo : lo + TABLES], books, optimize=True)
                for i in range(lo, min(lo + TABLES, len(q))):
                    if every:
                        at = np.arange(len(ids))
                    else:
                        approx = tables[i - lo].ravel()[flat].sum(axis=1)
                        top = np.argpartition(-approx, codes_in - 1)[:codes_in]
                        at = order[np.concatenate([np.arange(start[c], start[c + 1]) for c in top])]
                    at = at[ids[at] != q_ids[i]]
                    score = (x[at] @ q[i]) / (norm[at] * q_norm[i])
                    own, s = np.concatenate([found[i][0], ids[at]]), np.concatenate([found[i][1], score])
                    b = _best(own, s, k)
                    found[i] = own[b], s[b]

        rows, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                rows.append(batch.slice(lo, BLOCK))
                n += rows[-1].num_rows
                if n >= BLOCK:
                    scan(rows)
                    rows, n = [], 0
        if n:
            scan(rows)
        for lo in range(0, len(found), 4096):
            part = found[lo : lo + 4096]
            sizes = [len(f[0]) for f in part]
            if sum(sizes):
                own = np.arange(lo, lo + len(part)) + first
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.repeat(q_ids[lo : lo + 4096], sizes)), pa.array(np.concatenate([f[0] for f in part])), pa.array(np.concatenate([f[1] for f in part]))], ["q", "query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, wanted, k: int = 5, codes: int | None = CODES, per_pass: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that satisfies ``wanted``, by cosine.

    ``codes`` says into how many codes of each block of vectors a query looks; None is all, an exact search. Queries go
    out in bounded blocks, each a pass over the index whose finds are written before the next one starts, so that one
    block at a time is on the driver; a partition keeps k of each query, and the partitions' finds are ranked by query.
    """
    spark = df.sparkSession
    index, books = build_index(df)
    queries = index.where(wanted)
    n = queries.count() if books is not None else 0
    finds = spark.createDataFrame([], "q long, query_id long, vec_id long, score double")
    passes, before = -(-n // per_pass), 0
    for i in range(passes):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).select("vec_id", "embedding").toArrow()
        if not block.num_rows:
            continue
        held = spark.sparkContext.broadcast((books, block.column(0).to_numpy(), _vectors(block.column(1).combine_chunks())))
        part = index.mapInArrow(_search(held, k, codes, before), "q long, query_id long, vec_id long, score double")
        before += block.num_rows
        if passes > 1:
            part = materialize(part, "finds")
            held.destroy()
        finds = finds.unionByName(part)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return finds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
