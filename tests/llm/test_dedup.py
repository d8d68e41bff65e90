import collections
import hashlib
import re

import pyarrow as pa
import pytest

from siteloom.llm import near_dedup, substring_dedup
from siteloom.llm.components import components

from .fixtures import documents, empty, rows


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(data):
    sets = {i: shingles(t) for i, t, *_ in data}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    out = near_dedup.near_duplicates(documents(spark)).collect()
    want = brute_components(rows())
    assert len(out) == len(rows())
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_large_group_of_near_copies(spark):
    """Every copy differs from every other; links between copies that are no link of the first one count too."""
    from .fixtures import edited, prose

    base = prose(5, 120)
    data = [(i, edited(base, i, 0.004 * (i % 12)), None, None) for i in range(150)]
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, data)).collect()}
    assert out == {i: c for i, (_, c) in brute_components(data).items()}


def test_bucket_cut_between_tasks_keeps_its_members():
    batch = lambda *r: pa.RecordBatch.from_arrays([pa.array([x for x, _ in r], pa.int64()), pa.array([y for _, y in r], pa.int64())], ["key", "doc"])
    tasks = [[batch((1, 5), (1, 6)), batch((2, 7))], [batch((2, 8))], [batch((2, 9), (3, 4))], [batch()]]
    rows = [r for t in tasks for b in near_dedup._neighbours(iter(t)) for r in b.to_pylist()]
    assert {7, 8, 9} <= {x for r in rows if r["key"] == 2 for x in (r["doc"], r["pivot"])}
    assert {(r["doc"], r["pivot"], r["prev"]) for r in rows if r["key"] == 1} == {(5, 5, 5), (6, 5, 5)}


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert near_dedup.near_duplicates(empty(spark)).collect() == []
    out = near_dedup.near_duplicates(documents(spark, [(None, "a b c d e f", None, None), (4, "a b c d e f", None, None), (None, None, None, None), (None, "q r s", None, None)])).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True)], key=str)


def test_one_id_with_unlike_texts_chains_nothing(spark):
    """Each text of an id is linked by itself; of near copies under one id, one stays."""
    from .fixtures import prose

    a, b = prose(51, 80), prose(52, 80)
    data = [(1, a, None, None), (2, a, None, None), (2, b, None, None), (3, b + " more", None, None), (4, prose(53, 60), None, None), (4, prose(54, 60), None, None), (5, a + " five", None, None), (5, b + " five", None, None), (5, b + " five", None, None)]
    out = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, data)).collect())
    assert out == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (5, 1, False), (5, 2, False), (5, 2, False)]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.deduplicated(documents(spark, data)).collect())
    assert kept == sorted([(1, a), (2, b), (4, data[4][1]), (4, data[5][1])])
    same = near_dedup.deduplicated(documents(spark, [(7, b, None, None), (7, b + " x", None, None), (7, b.upper(), None, None)])).collect()
    assert [r.doc_id for r in same] == [7]


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    docs = documents(spark)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    want = {i for i, (_, c) in brute_components(rows()).items() if i == c}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (139, 138)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), most=1)


def brute_repeats(data, window=50):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t, *_ in data]
    for i, w in texts:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = collections.Counter()
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def removed(out):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())


def test_removed_repeats_equal_brute_force(spark):
    out = removed(substring_dedup.remove_repeats(documents(spark)))
    assert out == brute_repeats(rows())
    assert any(k[2] for k in out)


def test_one_id_with_unlike_texts(spark):
    """Neither text of an id removes from the other, and each is judged by its own words."""
    from .fixtures import prose

    a, b, c = prose(31, 80), prose(32, 80), prose(33, 90)
    for data in (
        [(1, c), (2, "x y z " + c + " q"), (2, "short text here")],
        [(1, a), (2, a), (2, b), (3, b)],
        [(2, a), (2, a + " " + b), (2, b), (1, "v " + b)],
    ):
        data = [(i, t, None, None) for i, t in data]
        assert removed(substring_dedup.remove_repeats(documents(spark, data))) == brute_repeats(data)


def test_very_common_window(spark):
    """A passage in all documents, one key with most of the rows, beside passages of two."""
    from .fixtures import prose

    common = prose(41, 60)
    data = [(i, prose(500 + i // 2, 55) + " " + common + " " + prose(9000 + i, 5), None, None) for i in range(2500)]
    assert removed(substring_dedup.remove_repeats(documents(spark, data))) == brute_repeats(data)


def test_repeats_of_nothing_and_null_ids(spark):
    assert substring_dedup.remove_repeats(empty(spark)).collect() == []
    out = substring_dedup.remove_repeats(documents(spark, [(None, "a " * 60, None, None), (1, "a " * 60, None, None), (2, "a " * 60, None, None)])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in out), key=str) == sorted([(None, 0), (1, 0), (2, 60)], key=str)


def test_levels_double_until_none_survives(spark):
    from .fixtures import prose

    shared = prose(77, 430)
    data = [(1, prose(1, 30) + " " + shared, None, None), (2, shared + " " + prose(2, 30), None, None), (3, prose(3, 200) + " " + " ".join(shared.split()[:70]), None, None), (4, prose(4, 500), None, None), (5, prose(4, 500), None, None)]
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, data)).collect()}
    assert {i: r.n_removed for i, r in out.items()} == {1: 0, 2: 430, 3: 70, 4: 0, 5: 500}
    assert {i: r.longest for i, r in out.items()} == {1: 400, 2: 400, 3: 50, 4: 0, 5: 500}
    docs = documents(spark, data).selectExpr("doc_id", "xxhash64(text) t", "text")
    _, found = substring_dedup.repeated_windows(docs)
    levels = {length: {r.doc_id: len(r.pos) for r in rows.collect()} for length, rows in substring_dedup.doubled(substring_dedup.materialize(found, "t"), 50)}
    assert list(levels) == [50, 100, 200, 400]
    for length, n in levels.items():  # all windows of the passage are candidates; few others are
        assert all(431 - length <= n[i] <= 431 - length + 60 for i in (1, 2))


def test_deduplicated_keeps_documents_without_an_id(spark):
    out = near_dedup.deduplicated(documents(spark, [(None, "a b c d e f", None, None), (4, "a b c d e f", None, None), (5, "a b c d e f", None, None), (None, "q", None, None)])).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(None, "a b c d e f"), (None, "q"), (4, "a b c d e f")], key=str)


def test_documents_without_an_id_stay_each(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, text, "a"), (None, text, "b"), (3, text, "c"), (3, text, "c"), (4, text, "d")], "doc_id long, text string, extra string")
    got = sorted(((r.doc_id is not None, r.doc_id, r.extra) for r in near_dedup.deduplicated(docs).collect()), key=str)
    assert got == [(False, None, "a"), (False, None, "b"), (True, 3, "c")]
