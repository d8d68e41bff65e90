"""Queries for the operators in ``evidence``: cases of each kind, dealt out over the pages and hosts of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content as C
from ..operators import evidence as G
from ..operators import html_events as H
from ..operators import structured as S
from .content_queries import _of_cases
from .page_queries import _INTENT_CASES, thin
from .registry import dealt, literal, query, seed_sql, spread

_LISTS = [
    (1, '<article><footer><time datetime="2024-05-01T10:00">May</time></footer></article><time>March 3, 2023</time><footer><time datetime="2025-01-01">x</time> 2025</footer>'),
    (2, "<p>Posted 11 March 2022</p><p>Copyright 2024</p><p>no year</p>"),
    (3, "<time>2 days ago</time><p>2019</p>"),
    (4, "<script>var y = 2024</script><p>none</p>"),
]


@query("listing_dates", _of_cases("page_id", "page_id, raw, relative, structured", "(1::bigint, '2024-05-01T10:00', false, true)", "(1, 'March 3, 2023', false, true)", "(2, 'Posted 11 March 2022', false, false)", "(3, '2 days ago', true, true)", "(3, '2019', false, false)", keys=[1, 2, 3, 4]))
def listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.listing_dates(H.events(spread(spark, sf_dir, spark.createDataFrame(_LISTS, "page_id long, html string"), "page_id")))


_INTENTS = [
    (1, "https://a.com/x/y", ["WebSite", "Product"], None, None, None, False),
    (2, "https://a.com/", ["WebSite"], "article", None, None, False),
    (3, "https://a.com/deep/page", ["Organization"], "website", "article", None, False),
    (4, "https://a.com/blog/x", [], "product.item", None, None, False),
    (5, "https://a.com/flat.htm", None, None, None, "service", False),
    (6, "https://a.com/flat.htm", None, None, None, "unknown", True),
    (7, "https://a.com/pricing", None, "profile", None, None, True),
    (8, "https://a.com/v", None, "video.other", None, None, False),
]


_INTENTS_FLAT = [(i, u, ",".join(t) if t is not None else None, *rest) for i, u, t, *rest in _INTENTS]


def _named(key: str, table: dict[str, str]) -> str:
    return "case " + " ".join(f"when {key} in ({', '.join(map(literal, names.split()))}) then {literal(intent)}" for intent, names in table.items()) + " end"


_SITE = ", ".join(map(literal, G.SITE_TYPES))


@query(
    "page_intent",
    f"""with d as (select *, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) as p, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as segs, lower(trim(og_type)) as og_key from {dealt(seed_sql(_INTENTS_FLAT, 'page_id, url, types, og_type, layout, hint, form_page'), 'page_id')}),
    r as (select *, len(segs) = 0 or (len(segs) = 1 and length(segs[1]) <= 5) as root from d),
    k as (select *, list_filter(list_transform(string_split(lower(coalesce(types, '')), ','), lambda t: case when not (t in ({_SITE}) and not root) then {_named('t', G.TYPE_INTENT)} end), lambda x: x is not null)[1] as schema, coalesce({_named('og_key', G.OG_INTENT)}, {_named("string_split(og_key, ':')[1]", G.OG_INTENT)}) as og_all from r),
    o as (select *, case when not (og_all = 'homepage' and not root) then og_all end as og, case when p in ('', '/') then 'homepage' {_INTENT_CASES} end as by_path, case when hint in ('product', 'service', 'article', 'homepage', 'category', 'content', 'utility', 'app', 'media') then hint end as hinted from k),
    i as (select *, coalesce(schema, og, by_path, layout, hinted, 'content') as found from o)
    select page_id, case when form_page and found in ('homepage', 'category', 'content') then 'utility' else found end as intent, case when coalesce(schema, og) is not null then 'schema_or_og' else 'url_path_or_layout_or_default' end as basis from i""",
)
def page_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_intent(spread(spark, sf_dir, spark.createDataFrame(_INTENTS, "page_id int, url string, types array<string>, og_type string, layout string, hint string, form_page boolean"), "page_id"))


_SAME = '<script type="application/ld+json">{"@type":"Dentist","sameAs":["https://x.com/A/","https://X.com/A","",{"@id":"https://ror.org/1"}],"member":{"@type":"Person","sameAs":"https://orcid.org/2"},"part":{"@type":"WebPage","sameAs":"https://no.org"}}</script>'


@query("same_as_links", _of_cases("page_id", "page_id, n, url", "(1::bigint, 1, 'https://x.com/A/')", "(1, 2, 'https://ror.org/1')", "(1, 3, 'https://orcid.org/2')", keys=[1, 2]))
def same_as_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.same_as(S.nodes(spread(spark, sf_dir, spark.createDataFrame([(1, _SAME), (2, "<p>no data</p>")], "page_id long, html string"), "page_id", mixed="html")))


_CALLED = "(values (1, 'Acme', 'Site', 'T | Other', null, 'we make very good anvils', null, null, null), (2, null, 'Site', 'T', null, 'short', 'an organisation that makes things', null, null), (3, null, null, 'Anvils — Acme Co', null, null, null, 'six words are what it takes', null), (4, null, null, 'Plain', 'Acme logo', null, null, 'five words only here now', 'open graph has four words'), (5, '', '', '', null, '', '', '', '')) as t(page_id, org_name, og_site, title, logo_alt, meta, org_description, subhead, og_description)"


def _count(text: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda x: x <> ''))"


_TAIL = "trim(regexp_extract(title, '^.*\\s[|–—-]\\s(.*)$', 1))"
_BRAND = f"case when trim(coalesce(org_name, '')) <> '' then ('jsonld_organization', org_name) when trim(coalesce(og_site, '')) <> '' then ('og:site_name', og_site) when {_TAIL} <> '' and {_count(_TAIL)} between 1 and 5 then ('title_suffix', {_TAIL}) when {_count('logo_alt')} between 1 and 6 then ('logo_alt', logo_alt) end"
_SAYS = f"case when {_count('meta')} >= 4 then ('meta_description', meta) when {_count('org_description')} >= 4 then ('jsonld_description', org_description) when {_count('subhead')} >= 6 then ('subhead_paragraph', subhead) when {_count('og_description')} >= 4 then ('og:description', og_description) end"


@query("brand_candidates", f"with c as (select page_id, {_BRAND} as b, {_SAYS} as d from {dealt(_CALLED, 'page_id')}) select page_id, b[2] as brand, b[1] as brand_source, d[2] as description, d[1] as description_source from c")
def brand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.brand_candidates(spread(spark, sf_dir, _CALLED, "page_id"))


_FETCHED = "(values ('u1', false), ('u1', false), ('u2', false), ('u3', true), ('u4', true), ('u5', true)) as f(url, allowed)"
_DECIDED = "(values ('u1', false, 'disallow', 'Disallow: /x'), ('u2', true, 'allow', null), ('u3', true, 'allow', null), ('u4', false, 'unreachable', null), ('u5', true, 'allow', null)) as d(url, allowed, source, rule)"


@query("refused_fetches", f"with d as (select * from {dealt(_DECIDED, 'url', 'url')}), f as (select * from {dealt(_FETCHED, 'url', 'url')}) select url, source as reason, rule from d where not allowed union select url, 'disallowed', null from f where not allowed and url not in (select url from d where not allowed)")
def refused_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.refused(spread(spark, sf_dir, _FETCHED, "url", "url"), spread(spark, sf_dir, _DECIDED, "url", "url"))


_SEEN, _ALSO = "(values ('a', 'u1'), ('a', 'u2'), ('b', null)) as t(site, url)", "(values ('a', 'u1'), ('a', 'u1'), ('b', null)) as t(site, url)"


@query("audited_pages", f"select site, greatest(count(distinct url), 1) as pages from (select * from {dealt(_SEEN, 'site', 'host')} union all select * from {dealt(_ALSO, 'site', 'host')}) group by site")
def audited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audited_pages(spread(spark, sf_dir, _SEEN, "site", "host"), spread(spark, sf_dir, _ALSO, "site", "host"))


_RES = "(values (1, 1, 'a', 100, null), (1, 2, 'b', null, 'timeout'), (1, 16, 'c', 5, null), (2, 1, 'd', 7, null)) as t(page_id, pos, url, length, error)"


@query("measured_resources", f"select page_id, count(*) as found, count(*) filter (pos <= 15) as measured, cast(coalesce(sum(length) filter (pos <= 15), 0) as bigint) as bytes, count(*) filter (pos <= 15 and length is null) as errors from {dealt(_RES, 'page_id')} group by page_id")
def measured_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.measured_resources(spread(spark, sf_dir, _RES, "page_id"))


_ELEMENTS = list(enumerate(['<img src="a" alt="b">', f'<img src="{"x" * 70}">', "<p>", f'<a href="{"y" * 70}" class="{"z" * 60}">'], 1))


@query(
    "element_snippets",
    f"""with e as (select page_id, regexp_extract(html, '^<([a-z]+)', 1) as tag, regexp_extract_all(html, '([a-z]+)="[^"]*"', 1) as names, regexp_extract_all(html, '[a-z]+="([^"]*)"', 1) as vals from {dealt(seed_sql(_ELEMENTS, 'page_id, html'), 'page_id')}),
    f as (select page_id, '<' || tag || array_to_string(list_transform(range(1, len(names) + 1), lambda i: ' ' || names[i] || '="' || case when length(vals[i]) > 60 then substr(vals[i], 1, 60) || '…' else vals[i] end || '"'), '') || '>' as whole from e)
    select page_id, case when length(whole) > 120 then substr(whole, 1, 120) || '…' else whole end as snippet from f""",
)
def element_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = H.events(spread(spark, sf_dir, spark.createDataFrame(_ELEMENTS, "page_id long, html string"), "page_id")).where("kind = 'start'")
    return ev.select("page_id", G.snippet(F.col("tag"), F.col("attrs")).alias("snippet"))


_WALLS = [(1, '<nav>menu</nav><form><input type="password"></form>', 200), (2, f'<form><input type="PASSWORD"></form><p>{"long text " * 20}</p>', 200), (3, "<form><input></form>", 404), (4, f"<header>{'menu ' * 200}</header><p>{'word ' * 20}</p>", 200)]


_JOINED = "coalesce(array_to_string(list_filter(list_transform(regexp_extract_all({}, '>([^<]*)', 1), lambda x: trim(x)), lambda x: x <> ''), ' '), '')"


@query(
    "login_walls",
    f"""with p as (select *, length({_JOINED.format("regexp_replace(html, '<(nav|header)>.*?</(nav|header)>', '>', 'g')")}) as main_chars, length({_JOINED.format('html')}) as chars from {dealt(seed_sql(_WALLS, 'page_id, html, status'), 'page_id')}),
    t as (select *, main_chars < 80 or (chars >= 200 and main_chars / chars::double < 0.15) as thin from p)
    select page_id, main_chars, thin, thin and contains(html, '<form') and regexp_matches(html, '(?i)<input type="password"') as login_wall, status between 200 and 299 as scanned from t""",
)
def login_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form with a password on a page with hardly any text; pages that did not load are not judged by their text."""
    p = spread(spark, sf_dir, spark.createDataFrame(_WALLS, "page_id long, html string, status int"), "page_id")
    ev = H.events(p)
    main = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "text") & ~F.col("unshown") & ~F.col("chrome") & (F.trim("text") != ""), F.struct("seq", F.trim("text").alias("t"))))), lambda x: x["t"]), " ")
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "text") & ~F.col("unshown") & (F.trim("text") != ""), F.struct("seq", F.trim("text").alias("t"))))), lambda x: x["t"]), " ")
    start = F.col("kind") == "start"
    g = ev.groupBy("page_id").agg(F.length(main).cast("long").alias("main_chars"), F.length(every).cast("long").alias("chars"), F.bool_or(start & (F.col("tag") == "form")).alias("form"), F.bool_or(start & (F.col("tag") == "input") & (F.lower(F.coalesce(F.col("attrs")["type"], F.lit(""))) == "password")).alias("password"))
    t = thin(F.col("main_chars"), F.col("chars"))
    return g.join(p, "page_id").select("page_id", "main_chars", t.alias("thin"), (t & F.col("form") & F.col("password")).alias("login_wall"), F.col("status").between(200, 299).alias("scanned"))


_RAISED = "(values ('a', 'landing_dead_end', 2), ('a', 'landing_dead_end', 3), ('a', 'title_default', 1), ('b', 'title_default', 5), ('b', 'title_default', 9)) as t(site, slug, page_id)"


@query("first_per_site", f"select site, slug, min(page_id) as page_id from {dealt(_RAISED, 'site', 'host')} group by site, slug")
def first_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a site has once, on the first page that raises them."""
    return spread(spark, sf_dir, _RAISED, "site", "host").groupBy("site", "slug").agg(F.min("page_id").alias("page_id"))


_NAMES = "(values (1, '/a/IMG_0042.jpg?x=1'), (2, '/a/red-fox.png'), (3, 'deadbeefcafe.webp'), (4, '/x/'), (5, 'screen shot 3.png')) as t(page_id, src)"


@query("autogenerated_names", f"with s as (select page_id, src, regexp_replace(regexp_extract(regexp_replace(src, '[?#].*$', ''), '([^/]*)/?$', 1), '\\.[^.]*$', '') as stem from {dealt(_NAMES, 'page_id')}) select page_id, src, stem, length(stem) >= 3 and regexp_matches(stem, {literal(C.GENERATED)}) as generated from s")
def autogenerated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark, sf_dir, _NAMES, "page_id")
    s = C.U.stem(F.col("src"))
    return d.select("page_id", "src", s.alias("stem"), ((F.length(s) >= 3) & s.rlike(C.GENERATED)).alias("generated"))
