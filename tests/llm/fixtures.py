"""Small tables with the cases every operator must define: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def rows() -> list[tuple]:
    """(doc_id, text, lang, source)"""
    base, shared = prose(1, 300), prose(2, 80)
    out = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # an exact copy
        (3, base.upper(), "en", "b"),  # equal after lower-casing
        (4, edited(base, 3, 0.01), "en", "b"),  # a near copy
        (5, edited(base, 4, 0.02), None, None),
        (6, edited(base, 5, 0.2), "en", "c"),  # too far away
        (7, prose(6, 200) + " " + shared + " " + prose(7, 20), "en", "c"),
        (8, shared + " " + prose(8, 100), "en", "a"),
        (9, prose(9, 10) + "\t" + shared.replace(" ", "\n"), "en", "a"),
        (10, None, None, None),
        (11, "", "en", "a"),
        (12, " \t\n ", "en", "b"),
        (13, "one two three", "en", "b"),
        (14, "one two three", "en", "c"),
        (15, "1234 567", "en", "c"),
        (16, "x" * 5000 + " " + "ab" * 3000, "en", "d"),
        (17, prose(10, 4000), "en", "d"),
        (19, "z " * 120, "en", "e"),
        (20, "z " * 120, "en", "e"),
        (21, "café naïve ÜBER 中文 字 \U0001f642 \x85 end", "fr", "e"),
    ]
    out += [(100 + i, prose(100 + i, 60 + i), "en", f"s{i % 7}") for i in range(40)]
    return out + [out[3], out[12]]  # rows that repeat


#: Columns beyond those of documents, with names that operators use inside.
CLASHING = ["h", "key", "rank", "component_id", "score", "id", "g", "k", "t", "n", "a", "d", "size", "spans", "letter", "siteloom_letter", "siteloom_copy", "siteloom_t", "siteloom_spans", "siteloom_hs", "siteloom_text", "siteloom_own", "siteloom_id", "siteloom_th", "place", "copies", "feature"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def documents(spark, only=None):
    """As ``documents``, with columns whose names the operators use inside."""
    data = [(i, t, g, s, len(t or ""), *CLASHING) for i, t, g, s in (rows() if only is None else only)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
