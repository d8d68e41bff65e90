"""Queries over structured data: each page of ``pages`` carries one of the blocks below, in turn, before its own markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structured as S
from .registry import dealt, literal, query, seed_sql, spread

_PROSE = "Alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu"


def _ld(*blocks: str) -> str:
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


PAGES = [
    (
        1,
        _ld('{"@context":"https://schema.org","@graph":[{"@type":"Organization","@id":"#org","name":"Acme","url":"https://a.com","telephone":"+1 (555) 010-9999","address":{"streetAddress":"12 Unknown Road","addressLocality":"Nowhere Springs"}},{"@type":["Product","Thing"],"name":"Anvil","description":"short","offers":{"@id":"#o"}},{"@id":"#o","@type":"Offer","price":"19.90","availability":"https://schema.org/InStock"}]}')
        + f"<p>{_PROSE}. Call 555 010 1234.</p>",
    ),
    (2, _ld('{"@type":"BreadcrumbList","itemListElement":[]}', '{"@type": "Article", broken')),
    (3, _ld('{&quot;@type&quot;:&quot;NewsArticle&quot;,&quot;headline&quot;:&quot;H&quot;,&quot;author&quot;:{&quot;name&quot;:&quot;Admin&quot;}}', '{"@type":"Recipe","name":"Soup\nof the day","recipeIngredient":["salt"]}')),
    (4, _ld('{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q1","acceptedAnswer":{"@type":"Answer","text":"Alpha bravo charlie delta"}},{"@type":"Question","name":"Q2","acceptedAnswer":{"text":"zebra giraffe elephant rhinoceros"}},{"@type":"Question","name":"Q3"}]}') + f"<p>{_PROSE}</p>"),
    (5, _ld('{"@type":"http://schema.org/WidgetThing","name":"x","nested":{"@type":"Person","name":"Ann Lee","description":"A person whose description is long enough."}}', '{"@type":"BlogPosting","name":"t","author":["Ann Lee",{"name":"guest"}],"datePublished":"2024-01-01","image":"i"}')),
    (6, "<p>no data</p>"),
    (7, _ld('// <![CDATA[\n{"@type":"VideoObject","name":"a }</script> b","thumbnailUrl":"t"}\n// ]]>')),
    (8, _ld('{"@type":"Product","name":"P","offers":[{"priceSpecification":{"price":5}},{"lowPrice":"7","availability":"x"}]}')),
]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, spark.createDataFrame(PAGES, "page_id long, html string"), "page_id", mixed="html")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(literal, values)) + "]"


#: The blocks of the seeded pages, mended as far as their faults go, and every typed object in those that parse.
_NODES = f"""split as (select page_id, string_split(string_split(html, '<!DOCTYPE')[1], '<script type="application/ld+json">')[2:] as parts from {dealt(seed_sql(PAGES, 'page_id, html'), 'page_id', mixed='html')}),
    blocks as (select page_id, cast(generate_subscripts(parts, 1) - 1 as int) as block, unnest(parts) as raw from split),
    mended as (select page_id, block, replace(replace(regexp_replace(regexp_extract(raw, '^([\\s\\S]*)</script>', 1), '(?m)^//.*$', '', 'g'), '&quot;', '"'), chr(10), ' ') as j from blocks),
    objects as (select m.page_id, m.block, t.id as n, t.value as node, t.value->'$."@type"' as declared from (select * from mended where json_valid(j)) m, json_tree(m.j) t where t.type = 'OBJECT'),
    nodes as (select page_id, block, n, node, list_transform(case json_type(declared) when 'ARRAY' then from_json(declared, '["VARCHAR"]') else [declared->>'$'] end, lambda x: regexp_replace(x, '^https?://schema.org/', '')) as types from objects where declared is not null)"""


def _said(path: str) -> str:
    return " or ".join(f"""trim(coalesce(node->>'$."{p}"', '')) not in ('', '[]', '{{}}', 'false', '0', 'null')""" for p in path.split("|"))


_LACKS = " union all ".join(
    f"select page_id, block, n, {literal(kind)} as kind, list_filter([{', '.join(f'case when not ({_said(w)}) then {literal(w.split(chr(124))[0])} end' for w in wanted)}], lambda x: x is not null) as missing from nodes where list_has_any(types, {_list(types)})" for kind, (types, wanted) in S.COMPLETE.items()
)
_ROLES = f"""roles as (select page_id, types, case when list_has_any(types, {_list(S.IDENTITY)}) then 'identity' when list_has_any(types, {_list(S.SUBJECT)}) then 'subject' when len(list_filter(types, lambda t: not list_contains({_list(S.STRUCTURAL)}, t))) = 0 then 'structural' else 'unclassified' end as role from nodes)"""


def _of_role(role: str, only: list[str] | None) -> str:
    own = "types" if only is None else f"list_filter(types, lambda t: list_contains({_list(only)}, t))"
    return f"array_to_string(list_sort(list_distinct(flatten(coalesce(list({own}) filter (role = '{role}'), [])))), ',') as {role}"


@query("jsonld_blocks", f"with {_NODES} select page_id, count(*) as blocks, count(*) filter (json_valid(j)) as parsed from mended group by page_id")
def jsonld_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.nodes(_pages(spark, sf_dir)).where("n = -1")
    return b.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("error").isNull()).alias("parsed"))


@query("jsonld_entities", f"with {_NODES} select page_id, block, array_to_string(types, ',') as types from nodes")
def jsonld_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.entities(S.nodes(_pages(spark, sf_dir))).select("page_id", "block", F.array_join("types", ",").alias("types"))


@query("entity_completeness", f"with {_NODES} select page_id, kind, array_to_string(missing, ',') as missing from ({_LACKS})")
def entity_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.completeness(S.entities(S.nodes(_pages(spark, sf_dir)))).select("page_id", "kind", F.array_join("missing", ",").alias("missing"))


@query("completeness_by_kind", f"with {_NODES} select kind, count(*) as entities, array_to_string(list_sort(list_distinct(flatten(list(missing)))), ',') as missing from ({_LACKS}) group by kind")
def completeness_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.completeness(S.entities(S.nodes(_pages(spark, sf_dir))))
    return c.groupBy("kind").agg(F.count("*").alias("entities"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))), ",").alias("missing"))


@query(
    "product_offers",
    f"""with {_NODES}, products as (select *, case json_type(node->'offers') when 'ARRAY' then from_json(node->'offers', '["JSON"]') when 'OBJECT' then [node->'offers'] end as listed from nodes where list_has_any(types, ['Product', 'IndividualProduct', 'SomeProducts'])),
    each as (select page_id, block, n, generate_subscripts(listed, 1) as pos, unnest(listed) as offer from products),
    aims as (select page_id, node->>'$."@id"' as id, node from nodes), whole as (select e.*, coalesce(a.node, '{{}}'::json) as aim from each e left join aims a on a.page_id = e.page_id and a.id = e.offer->>'$."@id"' and json_array_length(json_keys(e.offer)::json) = 1),
    said as (select *, coalesce(offer->'priceSpecification'->>'price', aim->'priceSpecification'->>'price', offer->>'price', aim->>'price', offer->>'lowPrice', aim->>'lowPrice', offer->>'highPrice', aim->>'highPrice') as price, coalesce(offer->>'availability', aim->>'availability') as availability from whole)
    select p.page_id, coalesce(p.node->>'name', '') <> '' as has_name, p.listed is not null as has_offers, (select arg_min(price, pos) from said s where s.page_id = p.page_id and s.block = p.block and s.n = p.n and price is not null) as price,
    (select arg_min(availability, pos) from said s where s.page_id = p.page_id and s.block = p.block and s.n = p.n and availability is not null) as availability from products p""",
)
def product_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.nodes(_pages(spark, sf_dir))
    return S.offers(S.entities(n), n).select("page_id", "has_name", "has_offers", "price", "availability")


@query(
    "entity_grounding",
    f"""with {_NODES}, {_ROLES}, g as (select page_id, {_of_role('identity', S.IDENTITY)}, {_of_role('subject', S.SUBJECT)}, {_of_role('structural', None)}, {_of_role('unclassified', None)} from roles group by page_id)
    select *, identity = '' and subject = '' and unclassified = '' as structural_only from g""",
)
def entity_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.grounding(S.entities(S.nodes(_pages(spark, sf_dir))))
    return g.select("page_id", *[F.array_join(c, ",").alias(c) for c in ("identity", "subject", "structural", "unclassified")], "structural_only")


@query(
    "entity_descriptions",
    f"""with {_NODES}, d as (select page_id, types[1] as type, length(trim(regexp_replace(coalesce(case json_type(node->'description') when 'OBJECT' then coalesce(node->'description'->>'@value', node->'description'->>'name') when 'ARRAY' then node->'description'->>0 else node->>'description' end, ''), '\\s+', ' ', 'g'))) as n
        from nodes where list_has_any(types, {_list([t for t in [*S.IDENTITY, *S.SUBJECT] if t not in S.NOT_DESCRIBABLE])}))
    select page_id, count(*) as describable, count(*) filter (n >= {S.DESCRIPTION_MIN}) as described, count(*) filter (n > 0 and n < {S.DESCRIPTION_MIN}) as short, coalesce(string_agg(distinct type, ',' order by type) filter (n = 0), '') as missing from d group by page_id""",
)
def entity_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.descriptions(S.entities(S.nodes(_pages(spark, sf_dir))))


def _topic(text: str) -> str:
    """The distinct words of a text that may carry its topic."""
    return f"list_filter(list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z'']+'), lambda w: length(w) > 2)), lambda w: not list_contains({_list(S.STOPWORDS)}, w))"


_ROUGH = "html"
for _tag in ("script", "style", "noscript"):
    _ROUGH = f"regexp_replace({_ROUGH}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_ROUGH = f"regexp_replace(regexp_replace({_ROUGH}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_SHOWN = f"rough as (select page_id, {_ROUGH} as text from {dealt(seed_sql(PAGES, 'page_id, html'), 'page_id', mixed='html')}), shown as (select page_id, text, {_topic('text')} as own from rough)"
_QUESTIONS = "questions as (select page_id, unnest(from_json(node->'mainEntity', '[\"JSON\"]')) as q from nodes where list_contains(types, 'FAQPage'))"


@query("faq_pairs", f"with {_NODES}, {_QUESTIONS} select page_id, q->>'name' as question, (q->'acceptedAnswer'->>'text') is not null as complete from questions")
def faq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.nodes(_pages(spark, sf_dir))
    return S.faq_pairs(S.entities(n), n).select("page_id", "question", F.col("answer").isNotNull().alias("complete"))


@query(
    "faq_not_shown",
    f"""with {_NODES}, {_QUESTIONS}, {_SHOWN}, pairs as (select page_id, q->>'name' as question, {_topic("(q->'acceptedAnswer'->>'text')")} as own from questions where (q->'acceptedAnswer'->>'text') is not null),
    r as (select p.page_id, p.question, round_even(len(list_intersect(p.own, s.own)) / len(p.own)::double, 3) as ratio from pairs p join shown s using (page_id) where len(p.own) >= 4 and len(s.own) >= 20) select * from r where ratio < 0.25""",
)
def faq_not_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.nodes(_pages(spark, sf_dir))
    return S.faq_overlap(S.faq_pairs(S.entities(n), n), _pages(spark, sf_dir))


@query(
    "contact_mismatches",
    f"""with {_NODES}, {_SHOWN}, orgs as (select page_id, node->>'telephone' as telephone, array_to_string(list_filter([node->'address'->>'streetAddress', node->'address'->>'addressLocality', node->'address'->>'addressRegion', node->'address'->>'postalCode', node->'address'->>'addressCountry'], lambda x: x is not null), ' ') as address
        from nodes where list_has_any(types, {_list(S.COMPLETE['organization'][0])})),
    met as (select o.*, s.own, list_filter(list_transform(regexp_extract_all(s.text, '[+(]?\\d[\\d\\-.()\\s]{{6,}}\\d'), lambda x: regexp_replace(x, '\\D', '', 'g')), lambda x: length(x) >= 7) as numbers, regexp_replace(coalesce(telephone, ''), '\\D', '', 'g') as digits from orgs o join shown s using (page_id) where len(s.own) >= 20)
    select page_id, 'telephone' as field, telephone as value from met where length(digits) >= 7 and len(list_filter(numbers, lambda x: contains(x, digits) or contains(digits, x))) = 0
    union all select page_id, 'address', address from (select *, {_topic("address")} as words from met) where len(words) >= 3 and len(list_intersect(words, own)) / len(words)::double < 0.3""",
)
def contact_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contact_mismatches(S.entities(S.nodes(_pages(spark, sf_dir))), _pages(spark, sf_dir))


@query(
    "article_authors",
    f"""with {_NODES}, a as (select page_id, block, n, case json_type(node->'author') when 'ARRAY' then from_json(node->'author', '["JSON"]') else [node->'author'] end as listed from nodes where list_has_any(types, {_list(S.COMPLETE['article'][0])})),
    k as (select page_id, list_filter(list_transform(listed, lambda x: trim(case json_type(x) when 'OBJECT' then x->>'name' else x->>'$' end)), lambda x: coalesce(x, '') <> '') as names from a)
    select page_id, array_to_string(names, ',') as names, len(names) > 0 and len(list_filter(names, lambda x: not list_contains({_list(sorted(S.PLACEHOLDER_AUTHORS))}, lower(x)))) = 0 as placeholder from k""",
)
def article_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.authors(S.entities(S.nodes(_pages(spark, sf_dir)))).select("page_id", F.array_join("names", ",").alias("names"), "placeholder")


@query("empty_breadcrumbs", f"with {_NODES} select page_id, cast(coalesce(json_array_length(node->'itemListElement'), 0) as bigint) as items from nodes where list_contains(types, 'BreadcrumbList')")
def empty_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.entities(S.nodes(_pages(spark, sf_dir))).where(S.is_a(["BreadcrumbList"]))
    items = S.prop("itemListElement")
    return e.select("page_id", F.when(F.startswith(items, F.lit("[")), F.size(F.from_json(items, "array<string>"))).otherwise(0).cast("long").alias("items"))


_PRICES = "(values (1, '1.234,50'), (2, '1,234.50'), (3, '$ 19.90'), (4, 'free'), (5, '99')) as t(page_id, raw)"


@query(
    "price_values",
    f"""with d as (select page_id, raw, regexp_extract(raw, '[0-9][0-9.,]*') as s from {dealt(_PRICES, 'page_id')})
    select page_id, raw, try_cast(case when contains(s, '.') and contains(s, ',') then case when strpos(reverse(s), ',') < strpos(reverse(s), '.') then replace(replace(s, '.', ''), ',', '.') else replace(s, ',', '') end else s end as double) as price from d""",
)
def price_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _PRICES, "page_id").select("page_id", "raw", S.price_value(F.col("raw")).alias("price"))


_FACTS = """(values (1, 'InStock', 'Ships today, in stock'), (1, '19.90', 'only $19.90'), (1, 'Blue Suede Shoe', 'blue shoe of suede'), (2, 'OutOfStock', 'in stock'), (2, 'Acme Deluxe', 'other things'), (2, 'Nobody', 'x'), (2, '2024', 'in 2024'), (3, null, 'x'), (3, 'pre_order', 'Pre order now')) as t(page_id, value, text)"""


def _words_of(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'))"


@query(
    "fact_consistency",
    f"""with f as (select page_id, lower(trim(value)) as v, lower(text) as t, case lower(trim(value)) {" ".join(f"when {literal(k)} then {literal(v)}" for k, v in S.AVAILABILITY.items())} end as wording, regexp_extract(lower(trim(value)), '[0-9]+(?:\\.[0-9]+)?') as number,
        list_filter({_words_of("lower(trim(value))")}, lambda w: not list_contains({_list(S.FACT_STOPWORDS)}, w)) as words, {_words_of("lower(text)")} as has from {dealt(_FACTS, 'page_id', mixed='text')} where value is not null),
    s as (select page_id, coalesce(v <> '' and t <> '' and (coalesce(contains(t, wording), false) or contains(t, v) or contains(t, replace(v, '_', ' ')) or (number <> '' and contains(t, number)) or (len(words) > 0 and len(list_intersect(words, has)) >= 0.7::double * len(words))), false) as shown from f),
    c as (select page_id, count(*) as evaluated, count(*) filter (shown) as verified from s group by page_id) select *, round_even(verified / evaluated::double, 2) as ratio, evaluated >= 3 and round_even(verified / evaluated::double, 2) < 0.5 as inconsistent from c""",
)
def fact_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.consistency(spread(spark, sf_dir, _FACTS, "page_id", mixed="text"))


_TYPED = [(i, _ld(*[f'{{"@type":"{t}"}}' for t in a]), _ld(*[f'{{"@type":"{t}"}}' for t in b]) if has else None) for i, a, b, has in [(1, ["A"], ["A", "B"], True), (2, ["A"], ["A"], True), (3, [], ["C"], True), (4, ["A"], [], False)]]


@query(
    "schema_after_js",
    f"""with t as (select page_id, list_sort(list_distinct(regexp_extract_all(raw, '"@type":"([^"]+)"', 1))) as a, list_sort(list_distinct(regexp_extract_all(rendered, '"@type":"([^"]+)"', 1))) as b from {dealt(seed_sql(_TYPED, 'page_id, raw, rendered'), 'page_id', mixed='raw')}),
    x as (select *, list_filter(b, lambda k: not list_contains(a, k)) as c from t) select page_id, array_to_string(a, ',') as raw_types, array_to_string(b, ',') as rendered_types, array_to_string(c, ',') as trapped, len(c) > 0 as barrier from x""",
)
def schema_after_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that only the rendered page has; unknown without one."""
    p = spread(spark, sf_dir, spark.createDataFrame(_TYPED, "page_id long, raw string, rendered string"), "page_id", mixed="raw")

    def types(column: str) -> DataFrame:
        e = S.entities(S.nodes(p, html=column)).select("page_id", F.explode("types").alias("t"))
        return e.groupBy("page_id").agg(F.array_sort(F.collect_set("t")).alias(f"{column}_t"))

    none = F.array().cast("array<string>")
    j = p.join(types("raw"), "page_id", "left").join(types("rendered"), "page_id", "left")
    a, b = F.coalesce("raw_t", none), F.when(F.col("rendered").isNotNull(), F.coalesce("rendered_t", none))
    return j.select("page_id", F.array_join(a, ",").alias("raw_types"), F.array_join(b, ",").alias("rendered_types"), F.array_join(F.array_except(b, a), ",").alias("trapped"), (F.size(F.array_except(b, a)) > 0).alias("barrier"))
