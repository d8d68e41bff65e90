import collections
import hashlib
import random
import re

from siteloom.llm import pii

from .fixtures import documents, empty

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PARTS = ["a@b.c", "_d@e.f", ".", "1.2.3.4", "256.1.1.1", "0004.1.2.3", " ", "-", "+1 (22) 333-4444", "4111 1111 1111 1111", "4111111111111111", "55", "@", "é", "\n", "x", "..", ".5", "+", "(2)", "1234567890123456789012"]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", "z" * 200_000, "1" * 50_000, "+" + "1 " * 20_000] + ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(300)]
    out = {x.doc_id: x for x in pii.spans_of_documents(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest(), t
        count = collections.Counter(s[0] for s in want)
        assert [out[i][f"n_{k}"] for k in PATTERNS] == [count[k] for k in PATTERNS]
        kept = [s for s in out[i].spans.split(",") if s and not s.startswith("term")]
        assert kept == ["%s:%d:%d" % s for s in want]


def corpus():
    data = [(i, f"plain words today, please, about nothing number {i}", None, None) for i in range(60)]
    data += [(100 + i, f"note {i} please ask Zebulon at zeb@corp.example today", None, None) for i in range(3)]
    data += [(200, "please note today", None, None), (201, "call +1 (555) 010-9999 now, please", None, None)]
    return data


def test_terms_that_reveal_an_entity_are_spans_and_common_ones_are_not(spark):
    out = {r.doc_id: r for r in pii.spans_of_documents(documents(spark, corpus())).collect()}
    text = dict((i, t) for i, t, *_ in corpus())
    terms = {text[100][int(a) : int(b)] for k, a, b in (s.split(":") for s in out[100].spans.split(",")) if k == "term"}
    assert "Zebulon" in terms and "please" not in terms and "today" not in terms
    assert out[200].spans == "term:7:11" and out[0].spans == ""  # note stands in four documents, three of them with the address


def brute_terms(data):
    """Term spans of a corpus whose only personal data are e-mail addresses: what brute_redact replaces, by place."""
    chosen = brute_redact([(i, t or "", None, None) for i, t, *_ in data])[1]
    out = collections.defaultdict(set)
    for i, t, *_ in data:
        bare = re.sub(PATTERNS["email"], lambda m: " " * len(m[0]), t or "")
        out[i] |= {(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", bare) if m[0].lower() in chosen}
    return out


def test_terms_equal_brute_force(spark):
    r = random.Random(9)
    people = [("Zeno", "zeno@a.example"), ("Ida", "ida@b.example"), ("Kim", "kim@c.example")]
    words = "please note today call about the old house in town and write again soon thanks".split()
    data = []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randint(3, 25))]
        for _ in range(r.choice([0, 0, 1, 2])):
            name, mail = r.choice(people)
            at = r.randrange(len(w) + 1)
            w[at:at] = [name, "at", mail] if r.random() < 0.8 else [mail]
        data.append((i, " ".join(w), None, None))
    want = brute_terms(data)
    assert any(want.values())
    for row in pii.spans_of_documents(documents(spark, data)).collect():
        got = {(int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s) if k == "term"}
        assert got == want.get(row.doc_id, set()), row.doc_id


def test_terms_of_rows_without_an_id(spark):
    named = corpus()
    bare = [(None if i in (100, 101, 102) else i, t, g, s) for i, t, g, s in named]
    spans = lambda data: sorted(r.spans for r in pii.spans_of_documents(documents(spark, data)).collect())
    assert spans(bare) == spans(named) and any("term" in s for s in spans(bare))


def test_redaction(spark):
    docs = documents(spark, corpus() + [(300, None, None, None), (None, "mail q@r.st", None, None)])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert "zeb@corp.example" not in got[101].text and "[EMAIL]" in got[101].text and "[NAME]" in got[101].text
    assert got[201].text == "call [PHONE] now, please" and got[0].text == corpus()[0][1]
    assert got[300].text is None and got[None].text == "mail [EMAIL]"
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.values() if r.doc_id != 300)


def test_redaction_finds_terms_far_from_the_address_and_without_it(spark):
    far = "and then we had a long talk about the old house in the town by the river "
    data = [(i, f"{far}{far}number {i}", None, None) for i in range(60)]
    data += [(100 + i, f"Zebulon said {far}{far}write {i} to zeb@corp.example", None, None) for i in range(3)]
    data += [(200, f"{far}ZEBULON, says corp.", None, None)]
    got = {r.doc_id: r.text for r in pii.redact(documents(spark, data)).collect()}
    assert got[101] == f"[NAME]  {far}{far} 1 to [EMAIL]"  # said and write stand in these documents only
    assert got[200] == f"{far}[NAME], says corp."  # corp is part of the address alone, not a term beside it
    assert got[7] == f"{far}{far}number 7"


def brute_redact(data):
    """Redaction of a corpus whose only personal data are e-mail addresses; equal texts are one where an address is counted."""
    import math

    own = {t: i for i, t, *_ in data}.values()

    parts = {i: re.split(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", t) for i, t, *_ in data}
    terms = {i: {w.lower() for g in p[::2] for w in re.findall(r"[^\W_]+", g) if len(w) >= 3} for i, p in parts.items()}
    with_term, with_entity, both = collections.Counter(), collections.Counter(), collections.Counter()
    for i, p in parts.items():
        mails = {m.lower() for m in p[1::2]}
        with_term.update(terms[i])
        if i in own:
            with_entity.update(mails)
            both.update((t, m) for t in terms[i] for m in mails)
    n = len(data)
    chosen = {t for (t, m), k in both.items() if k >= pii.SUPPORT and k >= pii.SURE * with_term[t] and math.log2(n * k / (with_term[t] * with_entity[m])) >= pii.THRESHOLD * math.log2(n / with_entity[m])}

    def shape(w):
        if w[0].lower() not in chosen:
            return w[0]
        return "[NUMBER]" if w[0][0] in "0123456789" else "[NAME]" if w[0][0].isupper() else ""

    return {i: "".join("[EMAIL]" if k % 2 else re.sub(r"[^\W_]+", shape, g) for k, g in enumerate(p)) for i, p in parts.items()}, chosen


def test_redaction_equals_brute_force_over_whole_documents(spark):
    r = random.Random(5)
    people = [(f"Name{i}", f"name{i}@a{i % 3}.example") for i in range(6)]
    words = "please note today call about the old house in town and write again soon thanks".split()
    data = []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randint(3, 60))]
        for _ in range(r.choice([0, 0, 1, 2])):
            for x in r.choice(people):
                if r.random() < 0.8:
                    w.insert(r.randrange(len(w) + 1), x)
        if r.random() < 0.1:
            w.insert(0, "name1")
        data.append((i, " ".join(w), None, None))
    want, chosen = brute_redact(data)
    assert any(t.startswith("name") for t in chosen) and "please" not in chosen
    assert {x.doc_id: x.text for x in pii.redact(documents(spark, data)).collect()} == want


def test_copies_of_one_text_are_no_evidence(spark):
    data = [(i, f"plain words today about nothing number {i}", None, None) for i in range(60)]
    data += [(100 + i, "Zebulon Quibble wrote from zeb@corp.example", None, None) for i in range(5)] + [(110, "so Quibble went", None, None)]
    out = {r.doc_id: r for r in pii.spans_of_documents(documents(spark, data)).collect()}
    assert out[100].spans == "email:27:43" and out[110].spans == ""
    assert {r.doc_id: r.text for r in pii.redact(documents(spark, data)).collect()} == brute_redact(data)[0]


def test_columns_with_the_operators_own_names(spark):
    names = ["siteloom_spans", "siteloom_hs", "siteloom_text", "siteloom_own", "siteloom_id", "siteloom_th", "spans", "hs", "th", "rows"]
    data = spark.createDataFrame([(100 + i, f"note {i} ask Zebulon at zeb@corp.example", *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = pii.redact(data)
    assert out.columns == data.columns
    assert all([r[c] for c in names] == names and "[EMAIL]" in r.text for r in out.collect())
    assert pii.spans_of_documents(data).count() == 3


def test_nothing_and_repeats(spark):
    assert pii.spans_of_documents(empty(spark)).collect() == []
    out = pii.spans_of_documents(documents(spark, [(1, "a@b.cd", None, None)] * 2)).collect()
    assert [(r.n_email, r.spans) for r in out] == [(1, "email:0:6")] * 2
