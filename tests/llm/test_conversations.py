"""Conversation repair against a plain search over whole conversations, with pieces of four rows and of the usual size."""

import hashlib
import random
import re
import zlib

import pytest

from siteloom.llm import conversations

EDGES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id long, turn long, role string, text string, g string, id string, n string, siteloom_copy string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        x = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        role = "user" if x == 4 else role
        out += [(conv, turn, role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return out


def repair(rows):
    """(cost, audit, messages) by dynamic programming that keeps whole messages; any number of insertions anywhere."""

    def inserted(best):
        for _ in range(3):
            for (src, c), dst in EDGES.items():
                if src in best and c != "s":
                    cost, audit, said = best[src]
                    new = (cost + 5, audit + "I", [*said, (dict(u="user", a="assistant")[c], "")])
                    if dst not in best or new[:2] < best[dst][:2]:
                        best[dst] = new
        return best

    best, seen = {0: (0, "", [])}, set()
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        after = {}
        for src, (cost, audit, said) in inserted(dict(best)).items():
            options = [(src, cost + 2, "D", None)]
            if not blank and not again:
                more = 5 if cut else 0
                options += [(EDGES[src, role[:1]], cost + more, "K", role)] if (src, role[:1]) in EDGES else []
                options += [(dst, cost + 1 + more, "R", {"u": "user", "a": "assistant"}[c]) for (s, c), dst in EDGES.items() if s == src and c != "s"]
            for dst, total, letter, spoken in options:
                new = (total, audit + letter, said if spoken is None else [*said, (spoken, text)])
                if dst not in after or new[:2] < after[dst][:2]:
                    after[dst] = new
        best = after
    ends = inserted(dict(best))
    return min((ends[s] for s in (0, 3) if s in ends), key=lambda x: x[:2])


def expected(rows):
    by = {}
    for conv, *_ in rows:
        by.setdefault(conv, [])
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        known = [t for has, t, *_ in turns if has]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        blank = duplicate = truncated = 0
        seen = set()
        for _, _, role, text in turns:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                blank += 1
            elif (role, text) in seen:
                duplicate += 1
            elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
                truncated += 1
            seen.add((role, text))
        c = [role[:1] for _, _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(c, c[1:], strict=False))
        cost, audit, said = repair([x[2:] for x in turns])
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def rows():
    r = random.Random(7)
    texts = ["Well. ", "so", "Yes!", "no?\n", "", " \t", "é.", "a" * 3000 + "."]
    out = [(None, 1, "user", "A."), (None, None, "assistant", None), (None, 2, None, "B!"), (1, 5, "", "x."), (2, None, "user", "p."), (2, None, "user", "q."), (2, None, "assistant", "q.")]
    out += [(3, t, "user", "same.") for t in range(60)]  # one row over and over, at other turns
    out += [(4, 7, "user", "same.")] * 40  # and at one turn
    for conv in range(10, 60):
        out += [(conv, t * r.choice([1, 1, 1, 2]), r.choice(["system"] if t == 0 and r.random() < 0.5 else ["user", "assistant", "user", "assistant", "system", "usher", "Bot"]), r.choice(texts) if r.random() < 0.4 else f"m{t}.") for t in range(r.randrange(1, 14))]
    for conv, n in ((60, 300), (61, 700)):
        out += [(conv, t, r.choice(["user", "assistant"]), f"m{r.randrange(n)}" + r.choice([".", ".", ""])) for t in range(n)]
    return out


@pytest.mark.parametrize("piece", [4, 128])
def test_report_equals_a_plain_search(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    data = rows()
    got = conversations.report(spark.createDataFrame([(*x, "g", "id", "n", "c") for x in data], SCHEMA)).collect()
    want = expected(data)
    assert len(got) == len(want)
    assert {x.conv_id: tuple(x[1:]) for x in got} == want


def test_messages(spark):
    data = [(1, 0, "assistant", "b."), (1, 1, "user", "c."), (2, 0, "user", "a."), (2, 1, "assistant", "b."), (3, 0, "x", "")]
    got = conversations.repaired(spark.createDataFrame([(*x, "g", "id", "n", "c") for x in data], SCHEMA)).collect()
    plain = {c: repair([(r, t) for k, _, r, t in data if k == c])[2] for c in (1, 2, 3)}
    said = {c: [(x.role, x.text) for x in sorted(got, key=lambda x: x.place) if x.conv_id == c] for c in (1, 2, 3)}
    assert said == plain and said[2] == [("user", "a."), ("assistant", "b.")] and said[3] == []


def test_empty(spark):
    out = conversations.report(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and not out.collect()
