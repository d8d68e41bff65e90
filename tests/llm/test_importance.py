"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import re
import zlib

from siteloom.llm import importance

from .fixtures import documents, empty, rows

TARGET = ["the of and Time people 42 zebra", None, "", "water long little very after words", "ÜBER café"]


def plain(docs, target, run=1, buckets=importance.BUCKETS, least=importance.LEAST, share=importance.SHARE):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return w, [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, fs = features(text)
        gains = [math.floor(1000 * math.log((t[bucket(f)] + 1) * (n_s + buckets) / ((s[bucket(f)] + 1) * (n_t + buckets)))) for f in fs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: share * len(able) // 100]):
        x[4] = rank + 1
    return sorted(map(tuple, (x[:5] for x in out)), key=str)


def check(spark, data, **more):
    docs = documents(spark, data)
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, doc_id string")
    got = importance.resampled(docs, target, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([(x[0], x[1]) for x in data], TARGET, **more)


def test_equals_plain(spark):
    check(spark, [*rows(), (None, "no id " * 30, "en", "a"), (None, "none either " * 30, "en", "a")])


def test_runs_of_words_and_other_shares(spark):
    check(spark, rows(), run=3, share=60, buckets=97, least=5)


def test_rare_strings_are_shuffled_to_the_same_gains(spark, monkeypatch):
    monkeypatch.setattr(importance, "COMMON", 8)  # almost all strings are rare then
    check(spark, rows(), share=100)


def test_copies_each_have_a_rank(spark):
    check(spark, [(7, "the of and time people water long little very after " * 3, "en", "a")] * 41, share=50)


def test_empty(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(empty(spark), target).collect() == []
    none = spark.createDataFrame([], "text string")
    got = importance.resampled(documents(spark, [(1, "a b", "en", "a"), (2, None, "en", "a")]), none).collect()
    assert sorted((x.doc_id, x.n_features, x["rank"]) for x in got) == [(1, 2, None), (2, 0, None)]
