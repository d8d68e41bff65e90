"""The whole run against plain Python, given the learned language."""

import collections
import hashlib
import struct

import corpus_pipeline
import pytest

from siteloom.llm import bpe, language_id

from .fixtures import rows
from .test_dedup import brute_components
from .test_pii import base


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    data = [(i, t, g, s, len(t or "")) for i, t, g, s in {r[0]: r for r in rows()}.values()]
    data.append((500, "write to me@here.org or +1 (555) 010-7777 soon my dear old friend of mine", "en", "a", 70))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mix", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        now = docs.collect()
        assert docs.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in seen} - {r.doc_id for r in now} == {r.doc_id for r in seen if not any(c.isalpha() for c in r.text or "")}
        if name == "near_dedup":
            c = brute_components([(r.doc_id, r.text) for r in seen])
            assert sorted(r.doc_id for r in now) == sorted(i for i, (_, k) in c.items() if i == k)
        if name == "pii":
            assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in seen) and not any(base(r.text) for r in now)
        if name == "mix":
            n = collections.Counter(r.doc_id for r in now)
            assert set(n) <= {r.doc_id for r in seen} and max(n.values()) <= 2
        seen = now
    own = bpe.Bpe(bpe.vocabulary())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in out) == sorted((r.doc_id, hashlib.sha256(struct.pack(f"<{len(k)}I", *k)).hexdigest()) for r in seen for k in [own.encode(r.text)])


def test_uncertain_language_reaches_the_tokens(spark, sf_dir, monkeypatch):
    """Findings, round 3, F5: neither the language nor how sure it is had an effect on what the pipeline returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sure = {r.doc_id: (r.score, r.lang_pred) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    least = max(x for x, _ in sure.values())
    monkeypatch.setattr(corpus_pipeline, "UNSURE", least)
    named = corpus_pipeline.identify_language(spark, docs, sf_dir)
    langs = collections.Counter((r.doc_id, r.lang) for r in corpus_pipeline.tokenize(spark, named, sf_dir).collect())
    assert langs == collections.Counter((r.doc_id, sure[r.doc_id][1] if sure[r.doc_id][0] >= least else "und") for r in named.collect())
    assert len({g for _, g in langs}) > 1 and any(g == "und" for _, g in langs)
