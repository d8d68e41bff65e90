import random
import zlib

import numpy as np
import pytest

from siteloom.llm import language_id, learners, quality, toxicity, vector_search
from pyspark.sql import functions as F

from .fixtures import documents, empty

SYLLABLES = {"aa": ["tha", "ing", "er", "on"], "ab": ["tha", "ung", "er", "ein"], "ba": ["eau", "que", "oi", "ment"], "bb": ["eau", "ción", "os", "mente"]}


def invented(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def languages():
    data = [(i, invented(g, i), g, "s") for i, g in enumerate(list(SYLLABLES) * 60)]
    return data + [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 34 !!", "aa", None), (1003, invented("bb", 9), None, None)]


def test_language_families_and_languages(spark):
    docs = documents(spark, languages())
    model = language_id.fit(docs)
    assert model.families == [["aa", "ab"], ["ba", "bb"]]
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(out) == len(languages())
    for i, text, lang, _ in languages():
        assert out[i].held_out == held(i) and 0 <= out[i].score <= 1
        if i >= 1000:
            assert out[i].lang_pred == ("bb" if i == 1003 else "und")
    sure = [(out[i].lang_pred, g) for i, _, g, _ in languages() if i < 1000 and held(i)]
    assert np.mean([a == b for a, b in sure]) > 0.95


def test_language_stage_keeps_columns_and_clean_documents(spark):
    docs = documents(spark, languages())
    out = language_id.with_language(docs, language_id.fit(docs))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, *_ in languages() if i not in (1000, 1001, 1002))


def test_language_stage_without_lang_and_with_ids_repeated(spark):
    docs = documents(spark)
    model = language_id.fit(docs)
    out = language_id.with_language(docs.drop("lang"), model)
    assert out.columns == [c for c in docs.columns if c != "lang"] + ["lang"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in language_id.with_language(docs, model).collect())


def fitted(monkeypatch, spark, module, call):
    """How many rows a fit brings to the driver."""
    sizes = []
    whole = type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: sizes.append((t := whole(self)).num_rows) or t)
    call()
    monkeypatch.undo()
    return max(sizes)


def test_ids_repeated_very_often_do_not_multiply_what_is_learned_from(spark, monkeypatch):
    rows = [(i % 4, f"{'alpha beta' if i % 2 else 'gamma delta'} {i} words here", "en" if i % 2 else "fr", "s") for i in range(1600)] + [(9, "the same text", "en", "s")] * 400
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i % 4, i % 2, i % 2) for i in range(1600)] + [(9, 1, 1)] * 400, "doc_id long, quality int, toxic int")
    assert fitted(monkeypatch, spark, language_id, lambda: language_id.fit(docs)) <= 2 * language_id.SAMPLE
    assert fitted(monkeypatch, spark, toxicity, lambda: toxicity.fit(docs, labels)) <= 5
    assert fitted(monkeypatch, spark, quality, lambda: quality.fit(docs, labels)) <= 5


def test_language_of_nothing(spark):
    assert language_id.fit(empty(spark)) is None
    assert language_id.identify(empty(spark), None).collect() == []
    out = language_id.identify(documents(spark, [(1, "abc", None, None)]), None).collect()
    assert out[0].lang_pred == "und" and out[0].score == 0


def good_and_bad():
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = invented("aa", i, 60) if good else [invented("aa", i, 30).upper().replace(" ", "!! "), " ".join(["buy now"] * 30), "*** ".join(invented("aa", i, 30).split())][i % 9 // 3]
        docs.append((i, text, "aa", "s"))
        labels.append((i, int(good), 0))
    return docs + [(900, None, None, None), (901, "", None, None)], labels


def test_quality(spark):
    rows, labels = good_and_bad()
    docs = documents(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab)
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(out) == len(rows)
    assert np.mean([out[i].predicted == y for i, y, _ in labels if held(i)]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert out[900].score == out[901].score
    x = quality.features(np.frombuffer(b"a b c", np.uint8), np.array([0, 5]))
    z = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, x[0], strict=True))
    for g, (i, j) in zip(model.grids, model.pairs, strict=True):
        z += g[np.searchsorted(model.coarse[i], x[0, i], side="right") * (len(model.coarse[j]) + 1) + np.searchsorted(model.coarse[j], x[0, j], side="right")]
    assert model.score(x)[0] == pytest.approx(learners.sigmoid(np.array([z]))[0])


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(empty(spark), none) is None
    assert [r.score for r in quality.score(documents(spark, [(1, "a", None, None)]), None).collect()] == [0.5]
    assert quality.score(empty(spark), None).collect() == []


def test_toxicity_chain(spark):
    marks = ["vilx", "nastyx", "grimx", "foulx"]
    docs, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        words = invented("aa", i, 50).split()
        if bad:
            r = random.Random(i)
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(marks))
        docs.append((i, " ".join(words), "aa", "s"))
        labels.append((i, 1, int(bad)))
    rows = [*docs, (900, None, None, None), (901, "", None, None)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int"))
    assert len(model.links) == 3 and len(model.links[2]) == len(model.words) + 2 + 1  # words, two probabilities, bias
    out = {r.doc_id: r for r in toxicity.score(documents(spark, rows), model).collect()}
    assert len(out) == len(rows)
    test = [(out[i].predicted, t) for i, _, t in labels if held(i)]
    assert np.mean([p for p, t in test if t]) > 0.9 and np.mean([p for p, t in test if not t]) < 0.03
    assert all(0 <= r.score <= 1 for r in out.values()) and out[900].predicted == out[901].predicted == 0


def test_toxicity_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(empty(spark), none) is None
    assert [r.score for r in toxicity.score(documents(spark, [(1, "a", None, None)]), None).collect()] == [0.0]


def vectors(n=900, d=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[200:500] = x[200]  # a third are one vector
    x[500:520] = x[500] * np.linspace(1, 2, 20)[:, None]  # equal directions
    return x


def test_nearest_neighbours(spark):
    x = vectors()
    data = [(i, [float(v) for v in np.float32(row)], 1) for i, row in enumerate(x)]
    odd = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] + [1.0] * 15, 0), (5150, [None] + [1.0] * 15, 0), (5200, [1.0, 2.0], 0), (5250, [float("inf")] * 16, 0), (5300, [], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame([*data, *odd], "vec_id long, embedding array<float>, label int")
    out = vector_search.search(df, F.col("vec_id") % 50 == 0).collect()
    y = np.float32(x).astype(float)
    hits = 0
    for q in range(0, len(x), 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        s = y @ y[q] / (np.linalg.norm(y, axis=1) * np.linalg.norm(y[q]))
        s[q] = -9
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        for _, i, score in own:
            assert i != q and score == pytest.approx(s[i], abs=1e-12)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(own, own[1:], strict=False))
        best = np.sort(s)[::-1][:5]
        hits += sum(score >= best[4] - 1e-12 for _, _, score in own)
    assert {r.query_id for r in out} == set(range(0, len(x), 50))
    assert hits >= 0.98 * 5 * 18


def test_vectors_of_any_finite_size(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [3e-200, 0.0]), (3, [-1e308, 1e300])], "vec_id long, embedding array<double>")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vector_search.search(df, F.col("vec_id") == 0).collect()}
    assert [out[0, k][0] for k in (1, 2, 3)] == [2, 1, 3]
    assert [out[0, k][1] for k in (1, 2, 3)] == pytest.approx([1.0, 0.5**0.5, -1.0])


def test_passes_and_exact_search(spark, monkeypatch):
    """Several passes find what one finds; looking into all codes is exact."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    out = vector_search.search(df, F.col("vec_id") % 10 == 0, codes=None, per_pass=7).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in out} == {(i, k + 1): int(j) for i in range(0, 400, 10) for k, j in enumerate(np.argsort(-sim[i])[:5])}


def test_queries_that_share_an_id(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [2.0, 0.1]), (2, [0.1, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for per_pass in (1, 100):
        out = vector_search.search(df, F.col("vec_id") == 50, k=2, per_pass=per_pass).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == sorted([(50, 1, 1), (50, 2, 3), (50, 1, 2), (50, 2, 3), (50, 1, 2), (50, 2, 3)])


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_search.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    out = vector_search.search(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 1.0], 0)], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out)] == [(0, 1, 1), (0, 2, 2)]


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(1).normal(size=(800, 12))
    books = vector_search.learn(x, books=4, entries=32)

    def error(codes):
        return ((x - books[np.arange(4), codes].sum(axis=1)) ** 2).sum()

    assert error(vector_search.encode(x, books, beam=8)) <= error(vector_search.encode(x, books, beam=1))
