import collections
import re

import pytest
from pyspark.sql import functions as F

from siteloom.llm import mixing

from .fixtures import documents, empty, rows


def targets(sizes):
    """Share 150 % by weight, cap at twice a source's size, share again what is over."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_targets_and_what_is_taken(spark):
    out = mixing.mix_sources(documents(spark)).collect()
    assert len(out) == len(rows())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, _, s in rows():
        sizes[s] += words(t)
    want = targets(sizes)
    taken = collections.Counter()
    text = {i: t for i, t, *_ in rows()}
    for r in out:
        assert r.size == words(text[r.doc_id]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(mixing.BLOCK, 0.02 * t)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_sources(documents(spark)).collect()), key=str)


def test_schedule_spreads_sources(spark):
    """Any run of slots has each source about as often as its target says: that is what low discrepancy is for."""
    x = [(i * mixing.GOLDEN) % mixing.SPAN / mixing.SPAN for i in range(20_000)]
    for lo, hi in ((0.0, 0.1), (0.25, 0.3), (0.6, 1.0)):
        for a in range(0, 20_000, 1000):
            n = sum(lo <= v < hi for v in x[a : a + 1000])
            assert abs(n - 1000 * (hi - lo)) <= 4


def test_nothing_and_no_words(spark):
    assert mixing.mix_sources(empty(spark)).collect() == []
    out = mixing.mix_sources(documents(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mixed_documents(spark):
    docs = documents(spark, [r for r in {r[0]: r for r in rows()}.values()])
    plan = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    n = collections.Counter(r.doc_id for r in got)
    assert n == {i: -(-r.taken // r.size) for i, r in plan.items() if r.size and r.taken}
    words = collections.Counter()
    for r in got:
        words[r.doc_id] += len(r.text.split(None) if r.text.isascii() else re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {i: r.taken for i, r in plan.items() if r.taken}


def test_mixed_words_are_near_their_targets(spark):
    """Short documents and a column named as the operator's own: no source's words overshoot, none fall short."""
    data = [(i, " ".join(f"w{j}" for j in range(30 + i % 90)), None, "abc"[i % 3]) for i in range(300)]
    docs = documents(spark, data).withColumn("siteloom_copy", F.lit(7)).withColumn("size", F.lit(1)).withColumn("d", F.lit("x"))
    target = {r.source: r.target for r in mixing.mix_sources(docs).collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert (r.siteloom_copy, r["size"], r.d) == (7, 1, "x")
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - t) <= 1 for s, t in target.items())


def test_small_source_beside_a_large_one_reaches_its_target(spark):
    data = [(i, "w " * 400_000, None, s) for i, s in enumerate("aabb")] + [(10, "few " * 90, None, "m"), (11, "v " * 700, None, "z")]
    out = {r.doc_id: r for r in mixing.mix_sources(documents(spark, data)).collect()}
    for i in (10, 11):
        assert 0 < out[i].target <= 2 * out[i].size and out[i].taken == int(out[i].target)
    assert all(r.taken <= 2 * r.size for r in out.values())
    for ids in ((0, 1), (2, 3)):
        assert sum(out[i].taken for i in ids) == int(out[ids[0]].target)


def test_sql_has_the_blocks_that_the_points_leave_out_too(spark, tmp_path):
    import duckdb

    rows = [(i, "w " * 4000, "big") for i in range(300)] + [(1000 + i, "w " * (60 + i), f"small{i % 3}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, size, source_size, target, taken, first_slot"
    want = con.execute(f"select {columns} from ({mixing.oracle()})").fetchall()
    got = mixing.query(spark, f"file://{tmp_path}").select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[4] > 0 for r in want if r[0] >= 1000} == {True}
