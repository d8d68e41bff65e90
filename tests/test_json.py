"""JSON-LD walked as variants against the mending parser, on well-formed, odd and broken blocks."""

import json
import random

from pyspark.sql import functions as F

from siteloom.operators import structured


def value(r, depth):
    k = r.random()
    if depth > 4 or k < 0.3:
        return r.choice([None, True, 3, 2.5, "x", "a </b> c", "é\n", "[1]", ""])
    if k < 0.5:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    out = {r.choice(["name", "url", "nested", "ünï", "a b", "offers"]): value(r, depth + 1) for _ in range(r.randint(0, 4))}
    if r.random() < 0.7:
        out["@type"] = r.choice(["Product", "http://schema.org/Offer", ["Thing", "https://schema.org/Place"], "", [], "x/Y", None, 5])
    if r.random() < 0.4:
        out["@id"] = r.choice(["#a", 7, "http://x/#b"])
    return out


def pages():
    r = random.Random(4)
    out = []
    for i in range(150):
        blocks = []
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            body = json.dumps(value(r, 0), ensure_ascii=r.random() < 0.5)
            body = r.choice([body, body, body, f" \n{body} ", f"// <![CDATA[\n{body}\n// ]]>", f"<!-- {body} -->", body[:-1], body + ";", body.replace('"', "&quot;"), "", "var x"])
            blocks.append(f'<script type="application/ld+json">{body}</script>')
        out.append((i, "<p>text</p>".join(blocks) + r.choice(["", "<script>var t='</p>'</script>", '<script type="application/ld+json">{"@type":"Cut'])))
    deep = '{"a":' * 60 + '{"@type":"Deep"}' + "}" * 60
    return out + [(900, None), (901, ""), (902, f"<SCRIPT type='application/LD+JSON'>{deep}</SCRIPT>"), (903, '<script type="application/ld+json">{"a":1,"a":{"@type":"Twice"}}</script>')]


def rows(df):
    return sorted((r.page_id, r.block, r.n, r.error is None, r.id, tuple(r.types) if r.types is not None else None, json.dumps(json.loads(r.props), sort_keys=True) if r.props else None) for r in df.collect())


def test_variants_equal_the_parser(spark):
    df = spark.createDataFrame(pages(), "page_id long, html string")
    got, want = rows(structured.nodes(df)), rows(structured.nodes_in_python(df))
    assert [x for x in got if x not in want] == [] and got == want
    assert any(x[0] == 902 and x[5] == ("Deep",) for x in got)


def test_objects_of_well_formed_blocks(spark):
    df = spark.range(5).select(F.col("id").alias("page_id"), F.lit('<script type="application/ld+json">{"@type":"Product","offers":[{"@type":"Offer"}]}</script>').alias("html"))
    assert structured.nodes(df).where("n >= 0").count() == 10
    split = structured.nodes(df)
    assert split.where("error is not null").count() == 0
