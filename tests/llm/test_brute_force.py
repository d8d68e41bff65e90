"""Models and parsing against plain Python: every text by itself, every rule as a loop."""

import math
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from siteloom.llm import fingerprints, language_id, learners, quality, toxicity
from siteloom.llm.textvec import _Q, mix

from .fixtures import prose

ODD = ["", " ", "a", "aaaaaaaaaaaa", "abababababab", "Ünïcode ÀÉ × þ 中文 字", "x\n\ny\nx y\nx y", "1 2 3 !!! ??? $$$ {a} <b>", "same same same same", "\t\r\n", "A" * 40, "a" * 19 + " b", "é", "don't stop"]
TEXTS = [*ODD, *(prose(i, 5 + 37 * i) for i in range(12)), prose(3, 20) + "\n" + prose(3, 20) + "\n" + prose(4, 9).upper()]
MASK = (1 << 64) - 1


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def mixed(x):
    return int(mix(np.array([x & MASK], np.uint64))[0])


def next_level(names, level):
    """One level of parsing: runs become one name, four rounds of coin tossing, phrases start at local maxima."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    x = [v if n == 1 else mixed(v ^ mixed(n + level)) for v, n in runs]
    label = x
    for _ in range(4):
        new = []
        for i, v in enumerate(label):
            width = 64 if label is x else 8
            before = label[i - 1] if i else ~v & ((1 << width) - 1)
            bit = next(b for b in range(width) if (v ^ before) >> b & 1)
            new.append(2 * bit + (v >> bit & 1))
        label = new
    assert all(a != b for a, b in zip(label, label[1:], strict=False))
    starts = [i for i in range(len(x)) if i == 0 or (label[i] > label[i - 1] and (i + 1 == len(x) or label[i] >= label[i + 1]))]
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(x)], strict=True):
        total = sum(mixed(x[i] + level) * pow(int(_Q), i - lo, 1 << 64) for i in range(lo, hi))
        out.append(mixed(total + hi - lo))
    return out


def phrases(text):
    names, found = [mixed(ord(c) + 1) for c in text], []
    for level in range(1, 5):
        names = next_level(names, level) if names else []
        if level in fingerprints.LEVELS:
            found += [mixed(x + level) for x in names]
    return found


def test_phrases():
    points = np.concatenate([np.array([ord(c) for c in t], np.int64) for t in TEXTS])
    owner = np.repeat(np.arange(len(TEXTS)), [len(t) for t in TEXTS])
    names, rows = fingerprints.phrase_names(points, owner)
    for i, text in enumerate(TEXTS):
        assert sorted(int(x) for x in names[rows == i]) == sorted(phrases(text)), text[:40]


def test_likeness_is_near_that_of_the_phrases():
    a = prose(1, 600)
    for share in (0.1, 0.3, 0.6):
        b = a[: int(len(a) * (1 - share))] + prose(2, 600)[: int(len(a) * share)]
        x, y = set(phrases(a)), set(phrases(b))
        f = fingerprints.fingerprints([a, b])
        assert abs((f[0] == f[1]).mean() - len(x & y) / len(x | y)) < 0.2  # 64 coordinates: three deviations


def shape(text):
    raw = text.encode()
    words, lines = raw.split(), [x.split() for x in raw.split(b"\n")]
    lines = [tuple(x) for x in lines if x]
    some, one = max(1, len(words)), max(1, len(raw))
    count = lambda signs: sum(c in signs for c in raw)
    beyond, upper, lower, digit = sum(c > 127 for c in raw), count(range(65, 91)), count(range(97, 123)), count(range(48, 58))
    white, shouts, code, odd, stops = count(b" \t\n\r\x0b\x0c"), count(b"!?"), count(b"|<>{}[]=_/\\"), count(b"#$%&*@^~+"), count(b".,;:'\"()-")
    triples = list(zip(words, words[1:], words[2:], strict=False))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), (len(raw) - white) / some, upper / one, digit / one, beyond / one, shouts / some, code / some, odd / some, stops / some,
        len(set(words)) / some, len(set(triples)) / len(triples) if triples else 1.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, max(Counter(words).values(), default=0) / some,
        len(words) / max(1, len(lines)), len(set(lines)) / len(lines) if lines else 1.0, sum(len(w) > 18 for w in words) / some, (len(raw) - beyond - upper - lower - digit - white) / some,
    ]


def test_quality_features():
    x = quality.features(*packed(TEXTS))
    assert x.shape[1] == len(quality.NAMES)
    for i, text in enumerate(TEXTS):
        assert x[i] == pytest.approx(shape(text)), text[:40]


def test_quality_scores_and_what_its_parts_add():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but a pair tells
    model = quality.Additive(x, y)
    assert (0, 1) in model.pairs
    alone, full = [], []
    for row in x:
        z = model.base + sum(t[bisect_right(list(e), v)] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        alone.append(z)
        for g, (i, j) in zip(model.grids, model.pairs, strict=True):
            z += g[bisect_right(list(model.coarse[i]), row[i]) * (len(model.coarse[j]) + 1) + bisect_right(list(model.coarse[j]), row[j])]
        full.append(z)
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-z)) for z in full])
    assert np.mean((np.array(full) > 0) == y) > 0.9 > 0.8 > np.mean((np.array(alone) > 0) == y)


def grams(text):
    """Hashed counts of one to four bytes, letters only, all else one space."""
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    x = [0.0] * language_id.FEATURES
    for k in range(1, 5):
        for i in range(len(raw) - k + 1):
            x[mixed(int.from_bytes(raw[i : i + k], "big") + (k << 40)) % language_id.FEATURES] += 1
    norm = math.sqrt(sum(x))
    return np.array([math.sqrt(v) / (norm or 1) for v in x])


def duels(x, names, machines):
    if len(names) == 1:
        return names[0], 1.0
    margin = {}
    for (a, b), w in machines.items():
        margin[a, b] = float(x @ w[:-1] + w[-1])
        margin[b, a] = -margin[a, b]
    wins = {a: sum(margin[a, b] > 0 for b in names if b != a) + math.tanh(sum(margin[a, b] for b in names if b != a)) / 4 for a in names}
    best = max(names, key=lambda a: wins[a])
    return best, 1 / (1 + math.exp(-language_id.SLOPE * min(margin[best, b] for b in names if b != best)))


def test_language_duels():
    r = random.Random(4)
    parts = {"aa": ["tha", "ing", "er"], "ab": ["tha", "ung", "er"], "ba": ["eau", "que", "oi"], "bb": ["eau", "ción", "os"], "cc": ["zzk", "wro", "yj"]}
    langs = sorted(parts) * 30
    texts = [" ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 3))) for _ in range(30)) for g in langs]
    model = language_id.Hierarchy(language_id.ngram_features(*packed(texts)), np.array(langs, object))
    assert sorted(g for f in model.families for g in f) == sorted(parts) and 1 < len(model.families) < len(parts)
    asked = [*texts[:20], *TEXTS[2:8], texts[0][:40] + texts[2][:40]]
    got, scores = model.predict(language_id.ngram_features(*packed(asked)))
    for text, lang, score in zip(asked, got, scores, strict=True):
        x = grams(text)
        family, sure = duels(x, list(range(len(model.families))), model.between)
        own, inner = duels(x, model.families[family], model.within[family])
        assert lang == own and score == pytest.approx(sure * inner, abs=1e-4)


def letters(text):
    fold = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}
    return set(re.findall("[a-z\u0080-\U0010ffff]+", text.translate(fold)))


def hashed(word):
    return int(toxicity.text_words(*packed([word]))[0][0])


def test_toxic_words():
    h, rows = toxicity.text_words(*packed(TEXTS))
    for i, text in enumerate(TEXTS):
        assert sorted(int(x) for x in h[rows == i]) == sorted(map(hashed, letters(text))), text[:40]


def test_toxic_chain():
    r = random.Random(6)
    words = [f"{a}{b}lo" for a in "abcdefgh" for b in "klmnop"]
    texts, toxic = [], []
    for i in range(240):
        own = [r.choice(words) for _ in range(25)]
        if i % 4 == 0:
            own += r.sample(["vilx", "grimx", "foulx"], r.randint(1, 3))
        texts.append(" ".join(own))
        toxic.append(float(i % 4 == 0))
    toxic = np.array(toxic)
    h, rows = toxicity.text_words(*packed(texts))
    model = toxicity.Chain(h, rows, toxic)
    place = {int(w): i for i, w in enumerate(model.words)}
    marks = {int(w) for w, on in zip(model.words, model.marks, strict=True) if on}
    assert {hashed(w) for w in ("vilx", "grimx", "foulx")} <= marks

    # The links again, each learned from predictions that no row's own fold took part in.
    x, y = np.zeros((len(texts), len(place)), np.float32), np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        own = [hashed(w) for w in letters(text)]
        for w in own:
            if w in place:
                x[i, place[w]] = model.weight[place[w]]
        hits = sum(w in marks for w in own)
        y[i] = hits >= 1, hits >= 2, toxic[i]
    seen = x
    for c in range(3):
        assert model.links[c] == pytest.approx(learners.logistic(seen, y[:, c]), abs=1e-3)
        out = np.zeros(len(texts))
        for k in range(toxicity.FOLDS):
            others = [i for i in range(len(texts)) if i % toxicity.FOLDS != k]
            w = learners.logistic(seen[others], y[others, c])
            for i in range(k, len(texts), toxicity.FOLDS):
                out[i] = 1 / (1 + math.exp(-float(seen[i] @ w[:-1] + w[-1])))
        seen = np.column_stack([seen, 2 * out]).astype(np.float32)

    # And what the chain gives, a text at a time.
    asked = [*texts[:12], "vilx", "VILX grimx, nothing", "", "12"]
    got = model.probabilities(*toxicity.text_words(*packed(asked)), len(asked))
    for text, p in zip(asked, got, strict=True):
        own = [hashed(w) for w in letters(text)]
        before = []
        for w in model.links:
            z = sum(float(w[place[v]]) * float(model.weight[place[v]]) for v in own if v in place) + sum(2 * q * float(w[len(place) + i]) for i, q in enumerate(before)) + float(w[-1])
            before.append(1 / (1 + math.exp(-z)))
        assert p == pytest.approx(before if own else [0, 0, 0], abs=1e-4)
