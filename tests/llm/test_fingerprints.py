import collections
import hashlib

import numpy as np

from siteloom.llm import fingerprints as fp

from .fixtures import documents, edited, empty, prose, rows


def test_documents(spark):
    data = sorted({r[0]: r for r in rows()}.values(), reverse=True)
    out = {r.doc_id: r for r in fp.fingerprint_documents(documents(spark, data)).collect()}
    assert len(out) == len(data)
    by_text = collections.defaultdict(set)
    for k, (i, text, *_) in enumerate(data):
        text, following = text or "", data[(k + 1) % len(data)][1] or ""
        new = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert out[i].n_chars == len(text)
        assert out[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        f, e, g = fp.fingerprints([text, new, following])
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (f.astype(">u2").tobytes().hex(), e.astype(">u2").tobytes().hex())
        assert (out[i].near_edited, out[i].near_next) == ((f == e).mean(), (f == g).mean())
        by_text[text].add(out[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_repeats_nulls_and_nothing(spark):
    assert fp.fingerprint_documents(empty(spark)).collect() == []
    out = fp.fingerprint_documents(documents(spark, [(5, "abc def", None, None)])).collect()
    assert len(out) == 1 and out[0].near_next == 1.0
    out = fp.fingerprint_documents(documents(spark, [(1, "x", None, None), (1, "x", None, None), (None, None, None, None), (2, "", None, None)])).collect()
    assert len(out) == 4


def test_equal_substrings_share_signatures_wherever_they_stand():
    inner = prose(3, 300)
    for lead in ("", "x", "some other start ", prose(4, 7)):
        text = lead + inner
        a, _ = fp.phrase_names(np.array([ord(c) for c in inner]), np.zeros(len(inner), np.int64))
        b, _ = fp.phrase_names(np.array([ord(c) for c in text]), np.zeros(len(text), np.int64))
        assert len(np.intersect1d(a, b)) >= 0.85 * len(a)


def test_likeness_follows_the_share_kept():
    base = prose(8, 400)
    scores = [float((fp.fingerprints([base])[0] == fp.fingerprints([edited(base, 1, share)])[0]).mean()) for share in (0.0, 0.02, 0.2, 1.0)]
    assert scores[0] == 1.0 and scores == sorted(scores, reverse=True) and scores[-1] < 0.2


def test_labels_of_neighbours_differ():
    x = fp.mix(np.random.default_rng(1).integers(0, 9, 3000).astype(np.uint64))
    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    first = np.zeros(len(x), bool)
    first[0] = True
    label = fp._labels(x, first)
    assert label.max() < 6 and (label[1:] != label[:-1]).all()
