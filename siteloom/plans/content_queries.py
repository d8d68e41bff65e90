"""Queries over texts, search results, markup and scripts: cases of each kind, dealt out over the pages and hosts of ``pages``."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content as C
from ..operators import html_events as H
from .registry import cases_sql, dealt, literal, pages, query, seed_sql, spread

def _today() -> F.Column:
    return F.lit("2025-01-01").cast("date")


def _table(cols: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) as t({cols})"


def _of_cases(key: str, cols: str, *rows: str, to: str = "page", keys: list | None = None) -> str:
    """SQL of what must be found in each case, for cases that are dealt out over the pages."""
    return f"select * from {dealt(f'(select * from (values {", ".join(rows)}) as t({cols}))', key, to, keys=keys)} where true"


_TEXTS = [
    (1, "Posted September 11, 2024. Updated in 2024. (c) 11th Mar 2023 and 2022-02-30, 2022-02-28"),
    (2, "Copyright 2019-2021 Acme. Call 12/11/2024"),
    (3, "December 25, 2030 party; as of 2023 we ship; last updated on March 2024; Sept 1 1985"),
    (4, "nothing"),
    (5, "© Foo Inc 2018; &copy; 1980"),
]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, spark.createDataFrame(_TEXTS, "page_id int, text string"), "page_id", mixed="text")


_MONTHS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DATES = f"""m as (select page_id, unnest(list_concat(
        list_transform(regexp_extract_all(text, '(?i)\\b{_MONTHS}\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+(?:19|20)[0-9]{{2}}\\b'), lambda x: try_strptime(regexp_replace(x, '^([A-Za-z]{{3}})[a-z]*\\s+([0-9]+)[a-z]*,?\\s+', '\\1 \\2 '), '%b %d %Y')),
        list_transform(regexp_extract_all(text, '(?i)\\b[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+{_MONTHS},?\\s+(?:19|20)[0-9]{{2}}\\b'), lambda x: try_strptime(regexp_replace(x, '^([0-9]+)[a-z]*\\s+([A-Za-z]{{3}})[a-z]*,?\\s+', '\\2 \\1 '), '%b %d %Y')),
        list_transform(regexp_extract_all(text, '\\b(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}\\b'), lambda x: try_strptime(x, '%Y-%m-%d')))) as d from t)"""


@query("visible_dates", f"with t as {dealt(seed_sql(_TEXTS, 'page_id, text'), 'page_id', mixed='text')}, {_DATES}, k as (select distinct page_id, cast(d as date) as d from m where d between date '1990-01-01' and date '2025-01-02') select page_id, coalesce(string_agg(cast(d as varchar), ',' order by d desc), '') as dates from t left join k using (page_id) group by page_id")
def visible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("page_id", F.array_join(F.transform(C.visible_dates(F.col("text"), _today()), lambda d: d.cast("string")), ",").alias("dates"))


@query("temporal_anchors", "select page_id, array_to_string(flatten([" + ", ".join(f"regexp_extract_all(text, {literal('(?i)' + rx)})" for rx in C.ANCHORS) + f"]), ',') as anchors from {dealt(seed_sql(_TEXTS, 'page_id, text'), 'page_id', mixed='text')}")
def temporal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("page_id", F.array_join(C.anchors(F.col("text")), ",").alias("anchors"))


@query(
    "copyright_years",
    f"""with t as {dealt(seed_sql(_TEXTS, 'page_id, text'), 'page_id', mixed='text')}, l as (select page_id, unnest(regexp_extract_all(text, '(?i)(?:copyright|©|\\bcopr\\b|&copy;)\\s*([^.;<\\n]{{1,120}})', 1)) as line from t),
    y as (select distinct page_id, cast(unnest(regexp_extract_all(line, '\\b(?:19|20)[0-9]{{2}}\\b')) as int) as y from l)
    select page_id, coalesce(string_agg(cast(y as varchar), ',' order by y), '') as years, max(y) as latest from t left join (select * from y where y between 1990 and 2026) using (page_id) group by page_id""",
)
def copyright_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = C.copyright_years(F.col("text"), _today())
    return _texts(spark, sf_dir).select("page_id", F.array_join(F.transform(y, lambda v: v.cast("string")), ",").alias("years"), F.array_max(y).alias("latest"))


@query("page_years", "select page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\b(?:19|20)[0-9]{2}\\b')) > 0 as has_year from pages")
def page_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page shows a year at all: those in scripts do not count."""
    t = H.shown_text(H.events(pages(spark, sf_dir))).groupBy("page_id").agg(F.bool_or(F.col("text").rlike(r"\b(?:19|20)[0-9]{2}\b")).alias("has_year"))
    return t


_DECLARED = [(1, "2024-01-01", "2023-12-31T10:00:00Z", None), (2, "soon", None, None), (3, "2024-06-01T23:00:00+0200", None, "2020-01-01"), (4, None, None, "2024-12-01"), (5, None, "2026-01-01", None), (6, None, None, None)]


_MOMENT = "try_strptime(regexp_replace(regexp_replace(coalesce({0}, ''), 'T?([0-9:]*)Z$', ' \\1 +0000'), '([+-][0-9]{{4}})$', ' \\1'), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S %z', '%Y-%m-%dT%H:%M:%S %z'])"


@query(
    "date_facts",
    f"""with d as (select *, cast({_MOMENT.format('published')} as timestamp) as p, cast({_MOMENT.format('modified')} as timestamp) as m, date_diff('day', cast(seen as date), date '2025-01-01') as visible, timestamp '2025-01-01' as now from {dealt(seed_sql(_DECLARED, 'page_id, published, modified, seen'), 'page_id')})
    select page_id, coalesce(cast(floor(epoch(now - coalesce(m, p)) / 86400) as bigint), visible) as age_days, case when m is not null then 'dateModified' when p is not null then 'datePublished' when seen is not null then 'latest_visible_date' end as source,
    case when published <> '' and p is null then 'published is no date' when modified <> '' and m is null then 'modified is no date' when m < p then 'modified before published' when m > now then 'modified in the future' when p > now then 'published in the future' end as issue from d""",
)
def date_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark, sf_dir, spark.createDataFrame(_DECLARED, "page_id int, published string, modified string, seen string"), "page_id")
    return d.select("page_id", *[c.alias(n) for n, c in C.date_facts(F.col("published"), F.col("modified"), F.to_date("seen"), _today().cast("timestamp")).items()])


_LISTED = [(1, "2024-05-01", False), (1, "March 3, 2023", False), (2, "Roadmap 2031", False), (2, "2022", False), (3, "2 days ago", True), (3, "2020-01-01", False), (4, "5 mai 2023", False), (5, "3 June 2022", False)]


_MONTH_NAMES = ", ".join(f"'{m}'" for m in "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split())
_MONTH_NO = "case " + " ".join(f"when lower({{0}}[:3]) = '{m}' then {n}" for n, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)) + " else 0 end"
_YEAR_SQL = "(?:20|19)[0-9]{2}"


@query(
    "listing_recency",
    f"""with l as (select * from {dealt(seed_sql(_LISTED, 'page_id, raw, relative'), 'page_id')}),
    x as (select *, regexp_extract(raw, '\\b({_YEAR_SQL})[-/](0[1-9]|1[0-2])[-/]([0-9]{{2}})\\b', ['y', 'm', 'd']) as iso, regexp_extract(raw, '\\b([a-zA-Z]+)\\s+([0-3]?[0-9]),\\s*({_YEAR_SQL})\\b', ['m', 'd', 'y']) as a, regexp_extract(raw, '\\b([0-3]?[0-9])\\s+([a-zA-Z]+)\\s+({_YEAR_SQL})\\b', ['d', 'm', 'y']) as b, regexp_extract(raw, '\\b({_YEAR_SQL})\\b', 1) as y from l),
    c as (select page_id, relative, case when iso.y <> '' then (try_cast(iso.y as int), try_cast(iso.m as int), try_cast(iso.d as int)) when a.y <> '' and {_MONTH_NO.format('a.m')} > 0 and lower(a.m) in ({_MONTH_NAMES}) then (try_cast(a.y as int), {_MONTH_NO.format('a.m')}, try_cast(a.d as int)) when b.y <> '' and lower(b.m) in ({_MONTH_NAMES}) then (try_cast(b.y as int), {_MONTH_NO.format('b.m')}, try_cast(b.d as int)) when y <> '' then (try_cast(y as int), 0, 0) else (0, 0, 0) end as c from x),
    k as (select page_id, bool_or(relative) as relative, max(case when not relative then (c[2] > 0, c[1], c[2], c[3]) end) as b from c where relative or c[1] <= 2026 group by page_id),
    d as (select *, case when b[1] then make_date(b[2], b[3], b[4]) when b[2] > 0 then least(make_date(b[2], 12, 31), date '2025-01-01') end as day from k)
    select page_id, case when not relative then cast(day as varchar) end as newest, case when relative then 'relative_recent' when b[1] then 'day' when b[2] > 0 then 'year_only' end as precision, case when relative then 0 else date_diff('day', day, date '2025-01-01') end as days, coalesce(case when relative then 0 else date_diff('day', day, date '2025-01-01') end > {C.DECAY_DAYS}, false) as decayed from d""",
)
def listing_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.listing_recency(spread(spark, sf_dir, spark.createDataFrame(_LISTED, "page_id int, raw string, relative boolean"), "page_id"), _today()).withColumn("newest", F.col("newest").cast("string"))


_CITED = [
    ("a", "founding_year", "2018", "https://x.com/1", "Acme", "Founded in 2018 by"),
    ("a", "founding_year", "2018", "https://www.y.org/2", "Acme", "Acme, established 2016, makes"),
    ("a", "founding_year", "2018", "https://z.net", "Acme", "raised money in 2023"),
    ("b", "headquarters", "Berlin, Germany", "https://x.com", "B", "headquartered in Berlin. More"),
    ("b", "headquarters", "Berlin, Germany", "https://y.com", "B", "based in Munich and"),
    ("c", "founding_year", " ", "https://x.com", "C", "founded in 2001"),
]


_NORM = "regexp_replace(lower(trim({})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


@query(
    "citation_consistency",
    f"""with c as (select site, fact, on_site, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') as host, trim(concat_ws(' ', title, snippet)) as text from {dealt(seed_sql(_CITED, 'site, fact, on_site, url, title, snippet'), 'site', 'host')} where trim(on_site) <> ''),
    l as (select *, case fact when 'founding_year' then nullif(regexp_extract(text, {literal(C.FOUNDED)}, 1), '') when 'headquarters' then nullif(trim(regexp_extract(text, '(?i)\\b(?:headquartered|headquarters|based|located|hq)\\s+in\\s+([A-Za-z\\s,.]+?)(?:\\.|;|,|$|\\s+and)', 1)), '') end as labelled from c),
    n as (select site, fact, host, {_NORM.format('on_site')} as own, {_NORM.format('labelled')} as ext, labelled is null and fact <> 'headquarters' and regexp_matches(text, '\\b(?:20|19)[0-9]{{2}}\\b') as weak from l),
    k as (select site, fact, count(distinct host) filter (ext is not null and (contains(own, ext) or contains(ext, own))) as corroborating, count(distinct host) filter (ext is not null and not (contains(own, ext) or contains(ext, own))) as conflicting, count(*) filter (weak) as weak from n group by site, fact)
    select *, fact = 'founding_year' and conflicting > 0 as contradicts from k""",
)
def citation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.citations(spread(spark, sf_dir, spark.createDataFrame(_CITED, "site string, fact string, on_site string, url string, title string, snippet string"), "site", "host"))


_FOUND = [
    ("acme", 1, "https://en.wikipedia.org/wiki/Acme_(disambiguation)", "Acme (disambiguation) - Wikipedia", ""),
    ("acme", 2, "https://en.wikipedia.org/wiki/Acme.io", "Acme.io - Wikipedia", "a firm"),
    ("acme", 3, "https://en.wikipedia.org/wiki/Category:Acme", "Category:Acme - Wikipedia", ""),
    ("acme", 4, "https://www.acme.io/", "Acme", ""),
    ("acme", 5, "https://www.wikidata.org/wiki/Q1", "Acme - Wikidata", ""),
    ("blue sky", 1, "https://bluesky.com", "Blue Sky", ""),
    ("blue sky", 2, "https://en.wikipedia.org/wiki/Blue_sky_(film)", "Blue Sky (film) — Wikipedia", ""),
    ("blue sky", 3, "https://www.linkedin.com/company/x", "x", ""),
    ("lone", 1, "https://other.com", "Lone star", ""),
]
_BRANDS = [("acme", "Acme", "acme.io"), ("blue sky", "Blue Sky", "bluesky.com"), ("lone", "Lone", "lone.dev")]


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, brands = spark.createDataFrame(_FOUND, "site string, rank int, url string, title string, snippet string"), spark.createDataFrame(_BRANDS, "site string, brand string, domain string")
    return spread(spark, sf_dir, found, "site", "host"), spread(spark, sf_dir, brands, "site", "host")


@query("entity_match", _of_cases("site", "site, host, url, score", "('acme', 'wikipedia.org', 'https://en.wikipedia.org/wiki/Acme.io', 3)", "('acme', 'wikidata.org', 'https://www.wikidata.org/wiki/Q1', 2)", "('blue sky', 'wikipedia.org', 'https://en.wikipedia.org/wiki/Blue_sky_(film)', 2)", to="host", keys=["acme", "blue sky", "lone"]))
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, b = _results(spark, sf_dir)
    parts = [C.entity_match(r, b, h).select("site", F.lit(h).alias("host"), "url", "score") for h in ("wikipedia.org", "wikidata.org")]
    return parts[0].unionByName(parts[1])


@query("name_ambiguity", _of_cases("site", "site, rank, hosts, platforms, disambiguation, signals, risk", "('acme', 4::bigint, 3::bigint, 2::bigint, true, 3::bigint, 'elevated')", "('blue sky', 1, 3, 2, false, 0, 'low')", "('lone', null, 1, 0, false, 2, 'elevated')", to="host"))
def name_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ambiguity(*_results(spark, sf_dir))


_SAME = "(values ('a', 'https://github.com/a'), ('a', 'https://x.com/a'), ('b', 'https://notgithub.com.evil.net/'), ('b', 'https://de.wikipedia.org/wiki/B'), ('c', 'https://hub.docker.com/u/c')) as t(site, url)"


@query("sameas_registry", f"select site, url, list_filter({C.REGISTRIES}, lambda k: regexp_extract(url, '://(?:www\\.)?([^/]*)', 1) = k or ends_with(regexp_extract(url, '://([^/]*)', 1), '.' || k))[1] as registry from {dealt(_SAME, 'site', 'host')}")
def sameas_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _SAME, "site", "host").select("site", "url", C.first_host(C.U.host(F.col("url")), C.REGISTRIES).alias("registry"))


_BUDGETS = "(values ('a', 6, 1), ('b', 0, 1), ('c', null, 2)) as t(site, remaining_before, consumed)"


@query("search_budget", f"select *, remaining_before - consumed as remaining_after, coalesce(remaining_before < consumed, false) as over_budget from {dealt(_BUDGETS, 'site', 'host')}")
def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spread(spark, sf_dir, _BUDGETS, "site", "host")
    return b.withColumn("remaining_after", F.col("remaining_before") - F.col("consumed")).withColumn("over_budget", F.coalesce(F.col("remaining_before") < F.col("consumed"), F.lit(False)))


_SCRIPTS = "(values (1, '/_next/static/x.js', 'ReactDOM.createRoot(e)'), (2, '/reactions-widget.js', 'var x'), (3, '/vue.global.prod.js', 'new Vue({'), (4, '/static/js/main.1.js', 'window.__NEXT_DATA__ = 1; Svelte.mount(')) as t(page_id, src, body)"


@query("frameworks", f"select page_id, src, {cases_sql('src', C.FRAMEWORK_SOURCES)}[1] as by_source, array_to_string({cases_sql('body', C.FRAMEWORK_TEXTS)}, ',') as by_text from {dealt(_SCRIPTS, 'page_id', mixed='body')}")
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _SCRIPTS, "page_id", mixed="body").select("page_id", "src", C.first_label(F.col("src"), C.FRAMEWORK_SOURCES).alias("by_source"), F.array_join(C.labels(F.col("body"), C.FRAMEWORK_TEXTS), ",").alias("by_text"))


_MEASURED = "struct<words:int,headings:int,jsonld:int,paragraphs:int,items:int>"
_PAIRS = [(1, (10, 0, 0, 0, 0), (400, 5, 1, 10, 0)), (2, (300, 5, 1, 20, 3), (310, 5, 1, 20, 3)), (3, (100, 2, 0, 5, 0), (150, 4, 0, 6, 0)), (4, (20, 1, 0, 1, 0), (151, 1, 0, 1, 0)), (5, (10, 0, 0, 0, 0), None)]


_FLAT = [(i, *a, *(b or [None] * 5)) for i, a, b in _PAIRS]


@query(
    "hydration",
    f"""with p as (select * from {dealt(seed_sql(_FLAT, 'page_id, w, h, j, p, l, w2, h2, j2, p2, l2'), 'page_id')}),
    n as (select page_id, w2, cast(w2 >= 2 * greatest(w, 1) and w < {C.WORD_FLOOR} as int) + cast(h2 - h >= 2 as int) + cast(j2 - j >= 1 as int) + cast(p2 - p >= 3 as int) + cast(l2 - l >= 6 as int) as differ, w < {C.NEAR_EMPTY} and w2 > 150 as shell from p)
    select page_id, case when w2 is not null then differ >= 2 or shell end as hydrates from n""",
)
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, spark.createDataFrame(_PAIRS, f"page_id int, raw {_MEASURED}, rendered {_MEASURED}"), "page_id").select("page_id", C.hydration().alias("hydrates"))


_BARRIERS = [
    (1, 5, 0, 0, 0, 0, 0, 60000, True, [], False, 0, None, False, False, False),
    (2, 500, 10, 5, 10, 5, 5, 9000, False, ["React"], False, 0, False, False, False, False),
    (3, 40, 10, 5, 10, 5, 5, 900, False, [], False, 3, None, True, True, False),
    (4, 20, 1, 1, 1, 1, 0, 900, False, ["Vue"], False, 3, True, False, False, True),
]


_BARRIER_COLUMNS = "page_id, words, paragraphs, headings, paragraphs_main, headings_main, items_main, bytes, mounts, frameworks, islands, custom, hydrates, waf, js_required, skeleton"
_BARRIERS_FLAT = [tuple(len(v) if isinstance(v, list) else v for v in r) for r in _BARRIERS]


@query(
    "rendering_barriers",
    f"""with b as (select *, paragraphs_main + headings_main + items_main as blocks from {dealt(seed_sql(_BARRIERS_FLAT, _BARRIER_COLUMNS), 'page_id')})
    select page_id, array_to_string(list_filter([case when coalesce(hydrates, false) then 'hydration gap' end, case when waf then 'challenge page' end, case when js_required then 'javascript required' end, case when paragraphs = 0 and headings = 0 and bytes >= 51200 then 'structurally empty' end,
    case when blocks >= 20 and words < 3 * blocks then 'empty blocks' end, case when (mounts or frameworks > 0 or islands) and words < {C.WORD_FLOOR} then 'client bootstrap' end, case when custom >= 3 and words < {C.NEAR_EMPTY} then 'custom element shell' end, case when skeleton then 'skeleton' end], lambda x: x is not null), ',') as reasons from b""",
)
def rendering_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = "page_id int, words int, paragraphs int, headings int, paragraphs_main int, headings_main int, items_main int, bytes int, mounts boolean, frameworks array<string>, islands boolean, custom int, hydrates boolean, waf boolean, js_required boolean, skeleton boolean"
    d = spread(spark, sf_dir, spark.createDataFrame(_BARRIERS, cols), "page_id")
    return d.select("page_id", F.array_join(C.barriers(F.struct(*[c for c in d.columns if c != "page_id"])), ",").alias("reasons"))


_SKELETONS = [(1, 50, False, ["a", "a", "a", "b"], False, False, 50, "Please enable JavaScript", 50), (2, 500, True, [], True, False, 20, "ok", 200), (3, 20, True, ["x"], False, True, 20, None, 20), (4, 60, False, ["a", "b", "c", "d"], True, False, 60, "This site requires javascript", 60)]
_SKELETONS_FLAT = [(i, w, m, ",".join(h), ids, inline, main, no, total) for i, w, m, h, ids, inline, main, no, total in _SKELETONS]


@query(
    "skeleton_screens",
    f"""with d as (select *, list_filter(string_split(headings, ','), lambda h: h <> '') as hs from {dealt(seed_sql(_SKELETONS_FLAT, 'page_id, words, markers, headings, ids, inline, main, noscript, total'), 'page_id')}),
    k as (select *, len(hs) as n, coalesce(list_max(list_transform(hs, lambda h: len(list_filter(hs, lambda x: x = h)))), 0) as top from d)
    select page_id, words < {C.WORD_FLOOR} and (markers or (n >= 4 and top > 0.5 * n) or (n >= 6 and words > 0 and words < 5 * n)) as skeleton, inline or cast(ids as int) + cast(inline as int) + cast(main < 30 and total > 100 as int) >= 2 as waf, coalesce(regexp_matches(noscript, {literal(C.JS_REQUIRED)}), false) as js_required from k""",
)
def skeleton_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark, sf_dir, spark.createDataFrame(_SKELETONS, "page_id int, words int, markers boolean, headings array<string>, ids boolean, inline boolean, main int, noscript string, total int"), "page_id")
    total = F.col("total")
    return d.select("page_id", C.skeleton(F.col("words"), F.col("markers"), F.col("headings")).alias("skeleton"), C.waf(F.col("ids"), F.col("inline"), F.lit(False), F.col("main"), total).alias("waf"), F.coalesce(F.col("noscript").rlike(C.JS_REQUIRED), F.lit(False)).alias("js_required"))


def _matchable(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^0-9a-z]+', ' ', 'g'))"


_PARITY = [(1, "The quick brown fox jumps over it. Menu", "The quick brown fox jumps over it. A second sentence appears only later here."), (2, "It&rsquo;s a fine day to write some text. ok", "x"), (3, "a", None), (4, "", "function foo() { return it; } is code here\nshort")]


@query(
    "sentence_parity",
    rf"""with p as (select * from {dealt(seed_sql(_PARITY, 'page_id, raw, rendered'), 'page_id', mixed='raw')} where rendered is not null),
    cut as (select page_id, raw, unnest(string_split_regex(regexp_replace(rendered, '([.!?])\s+', '\1' || chr(2), 'g'), '[\x02\n]+')) as s from p),
    kept as (select page_id, raw, s from (select page_id, raw, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from cut) where length(s) >= 25 and len(string_split(s, ' ')) >= 4 and not regexp_matches(s, '[{{}}<>|\\]|\)\s*;|=>|function\s*\(')),
    probe as (select page_id, {_matchable('raw')} as raw, array_to_string(string_split({_matchable('s')}, ' ')[1:7], ' ') as probe from kept),
    n as (select p.page_id, count(k.page_id) as sentences, count(*) filter (k.probe <> '' and not contains(k.raw, k.probe)) as missing from p left join probe k using (page_id) group by p.page_id)
    select page_id, sentences, missing, case when sentences = 0 then 100.0::double else round_even((1 - missing / sentences::double) * 100, 1) end as parity from n""",
)
def sentence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence_parity(spread(spark, sf_dir, spark.createDataFrame(_PARITY, "page_id int, raw string, rendered string"), "page_id", mixed="raw"))


_LINKS_RAW, _LINKS_DONE = [(1, "/a"), (1, "/a"), (2, "/z")], [(1, "/a"), (1, "/b"), (1, "/b"), (2, "/c")]


@query("links_after_js", f"select * from {dealt(seed_sql(_LINKS_DONE, 'page_id, url'), 'page_id')} except select * from {dealt(seed_sql(_LINKS_RAW, 'page_id, url'), 'page_id')}")
def links_after_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, done = (spread(spark, sf_dir, spark.createDataFrame(x, "page_id int, url string"), "page_id") for x in (_LINKS_RAW, _LINKS_DONE))
    return C.only_rendered(raw, done)


_RAW, _DONE = [(1, "<h1>One</h1>"), (2, "<h1>Same</h1>")], [(1, "<h1>ONE</h1><h2>Two</h2>"), (2, "<h1>same</h1><h3>More of it</h3>")]
_HEADS = "select page_id, lower(unnest(regexp_extract_all(html, '<h[1-6]>([^<]+)', 1))) as text from "


@query("headings_after_js", f"{_HEADS}{dealt(seed_sql(_DONE, 'page_id, html'), 'page_id')} except all {_HEADS}{dealt(seed_sql(_RAW, 'page_id, html'), 'page_id')}")
def headings_after_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, done = (spread(spark, sf_dir, spark.createDataFrame(x, "page_id long, html string"), "page_id") for x in (_RAW, _DONE))
    low = lambda d: H.headings(H.events(d)).select("page_id", F.lower("text").alias("text"))
    return low(done).join(low(raw), ["page_id", "text"], "left_anti")


_ALTS = [(None, "a.jpg"), ("", "a.jpg"), ("Image 2", "x"), ("IMG_2041", "y"), ("photo.jpg", ""), ("Canva", "/canva.png"), ("team_photo_02", "/team_photo_02.jpg"), ("coca-cola", "coca-cola.png"), ("hero-banner-final", "hero-banner-final.png"), ("A red fox", "fox.png"), ("placeholder", None)]


_ALT_CASES = [(i, *a) for i, a in enumerate(_ALTS, 1)]
_SLUGS = rf"(?i)^(?:{C._FILES}|screen)$"


@query(
    "alt_classes",
    f"""with a as (select page_id, alt, trim(alt) as s, regexp_replace(trim(alt), {literal(C._EXTENSION)}, '') as bare, lower(regexp_replace(regexp_extract(regexp_replace(coalesce(src, ''), '[?#].*$', ''), '([^/]*)/*$', 1), '\\.[^.]*$', '')) as stem from {dealt(seed_sql(_ALT_CASES, 'page_id, alt, src'), 'page_id')}),
    m as (select *, regexp_matches(s, {literal(C._EXTENSION)}) or regexp_matches(s, '[0-9]{{3,}}') or (not contains(s, ' ') and contains(s, '_')) or regexp_matches(bare, {literal(C.GENERATED)}) or (not contains(s, ' ') and contains(s, '-') and s = lower(s) and len(list_filter(string_split_regex(bare, '[-_.\\s]+'), lambda x: regexp_matches(x, {literal(_SLUGS)}))) > 0) as machine,
        regexp_matches(bare, {literal(C.GENERATED)}) and not contains(bare, ' ') and (regexp_matches(bare, '[0-9_-]') or bare <> s) as typed from a)
    select page_id, alt, case when alt is null then 'missing' when s = '' then 'decorative' when lower(s) in ('placeholder', 'untitled') or regexp_matches(s, {literal(C.GENERIC_ALT)}) or typed or (stem <> '' and lower(bare) = stem and machine) then 'generic' else 'descriptive' end as class from m""",
)
def alt_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, spark.createDataFrame(_ALT_CASES, "page_id int, alt string, src string"), "page_id").select("page_id", "alt", C.alt_class(F.col("alt"), F.col("src")).alias("class"))


_MEDIA = [
    (1, '<img src="a.png"><img alt="" src="b"><img alt="A fox" src="c"><svg><title>t</title></svg><svg><path/></svg><svg aria-hidden="true"></svg><a href="/x"><img alt="" src="d"></a><a href="/y"><img alt="" src="e"> text</a><button><img src="f"></button>'),
    (2, '<video src="v"></video><video><track kind="captions"></video><audio></audio><iframe src="https://www.youtube.com/embed/1"></iframe><iframe src="https://vimeo.com/1" title="t"></iframe><canvas></canvas><canvas>text</canvas><i class="fa fa-x"></i><i class="fa fa-y" aria-hidden="true"></i><span role="img" aria-label="z"></span><a href="/doc.PDF?x=1">d</a>'),
    (3, "<p>nothing</p>"),
]


@query("media_signals", _of_cases("page_id", "page_id, img_missing, img_decorative, img_descriptive, svg_unlabeled, controls_unlabeled, media_no_captions, iframes_no_title, canvas_no_fallback, icons_unlabeled, pdf_links", "(1::bigint, 2::bigint, 3::bigint, 1::bigint, 1::bigint, 2::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint)", "(2, 0, 0, 0, 0, 0, 2, 1, 1, 1, 1)", "(3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)"))
def media_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.media(H.events(spread(spark, sf_dir, spark.createDataFrame(_MEDIA, "page_id long, html string"), "page_id")))
    return m.select("page_id", "img_missing", "img_decorative", "img_descriptive", "svg_unlabeled", "controls_unlabeled", "media_no_captions", "iframes_no_title", "canvas_no_fallback", "icons_unlabeled", "pdf_links")


@query("pdf_text_layer", _of_cases("page_id", "page_id, name, has_text, method", "(1, 'tagged', true, 'tagged_structure')", "(2, 'flate', true, 'flate_decoded_text_operators')", "(3, 'scan', false, 'image_xobject_no_text')", "(4, 'cut', null, 'inconclusive_truncated')", "(5, 'html', false, 'not_a_pdf')", "(6, 'plain', true, 'uncompressed_text_operators')"))
def pdf_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = zlib.compress(b"BT /F1 12 Tf (Hi) Tj ET")
    rows = [("tagged", b"%PDF-1 /StructTreeRoot", False), ("flate", b"%PDF-1\nstream\n" + packed + b"\nendstream", False), ("scan", b"%PDF-1 /Subtype /Image", False), ("cut", b"%PDF-1 zzz", True), ("html", b"<html>", False), ("plain", b"%PDF-1 BT (x) Tj ET", False)]
    d = spread(spark, sf_dir, spark.createDataFrame([(i, n, bytearray(b), t) for i, (n, b, t) in enumerate(rows, 1)], "page_id int, name string, data binary, cut boolean"), "page_id")
    return d.withColumn("p", C.pdf_text_layer("data", "cut")).select("page_id", "name", "p.has_text", "p.method")


_LANDING = [
    (1, "https://a.com/x", '<nav><a href="/">Home</a></nav><h1>T</h1><a class="btn-primary" href="/go">Go</a><a href="/privacy">p</a><a href="mailto:a@b">mail</a><p>Built for teams. Lorem ipsum dolor.</p><img src="http://a.com/i.png">'),
    (2, "https://a.com/y", '<p>short</p><a href="#">x</a>'),
    (3, "https://a.com/login", '<form><input type="password"></form>'),
    (4, "http://a.com/z", "<div id='onetrust-banner-sdk'></div><p>Confirm your age please. Are you over 18</p><a href='/terms'>Terms</a><a href='https://b.com/'>out</a>"),
]


@query("landing_signals", _of_cases("page_id", 
        "page_id, utility, cta, nav, contact, privacy, terms, internal_links, empty_links, dead_end, placeholders, interstitial, audience, mixed_content, cookie_banner, login_gate",
        "(1::bigint, false, true, true, true, true, false, 3::bigint, 0::bigint, false, 'lorem ipsum', '', 'built for', 1::bigint, false, false)",
        "(2, false, false, false, false, false, false, 0, 1, true, '', '', null, 0, false, false)",
        "(3, true, false, false, false, false, false, 0, 0, false, '', '', null, 0, false, false)",
        "(4, false, false, false, false, false, true, 1, 0, true, '', 'are you over 18,confirm your age', null, 0, true, false)",
    ),
)
def landing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir, spark.createDataFrame(_LANDING, "page_id long, url string, html string"), "page_id")
    return C.landing(p, H.events(p))


_TITLES = "(values (1, 'Home'), (2, 'Untitled Document'), (3, '  '), (4, 'Acme anvils'), (5, 'My Blog'), (6, 'Vite + React')) as t(page_id, title)"


@query("default_titles", f"select page_id, title, trim(title) = '' or regexp_matches(title, {literal(C.DEFAULT_TITLE)}) as is_default from {dealt(_TITLES, 'page_id')}")
def default_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _TITLES, "page_id").select("page_id", "title", ((F.trim("title") == "") | F.col("title").rlike(C.DEFAULT_TITLE)).alias("is_default"))


_JS = [
    (1, '<meta http-equiv="Refresh" content="5; url=/new"><script>location.href = "/a";</script>'),
    (2, '<meta http-equiv="refresh" content="600"><script>document.addEventListener("click", function () { window.location = "/b"; });</script>'),
    (3, "<script>// location.href = '/no'\nfunction go() { location.replace('/c') } window.addEventListener('load', () => { location.assign('/d') })</script>"),
    (4, "<script>history.pushState({}, ''); useNavigate()</script><script type='application/json'>location = '/e'</script>"),
]


@query("client_redirects", _of_cases("page_id", "page_id, meta, load, event, routing, redirects", "(1::bigint, '/new', '/a', '', '', true)", "(2, '', '', '/b', '', false)", "(3, '', '/no,/d', '/c', '', true)", "(4, '', '', '', 'History API pushState/replaceState,React Router useNavigate hook', false)"))
def client_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.redirects(H.events(spread(spark, sf_dir, spark.createDataFrame(_JS, "page_id long, html string"), "page_id")))
    return r.select("page_id", *[F.array_join(c, ",").alias(c) for c in ("meta", "load", "event", "routing")], "redirects")


_OUTLINE = [(1, "<h1>A</h1><p>intro words here</p><h3>Why us?</h3><h2>What is it</h2><p>It is a thing.</p><div role='heading' aria-level='4'>Deep</div><nav><p>menu</p></nav>"), (2, "<h2>Sub</h2><h1 hidden>No</h1>"), (3, "<p>x</p>")]


@query(
    "heading_outline",
    f"""with l as (select page_id, list_transform(regexp_extract_all(html, '<h[1-6]>|aria-level=.[1-6]'), lambda x: cast(regexp_extract(x, '[1-6]') as int)) as l from {dealt(seed_sql(_OUTLINE, 'page_id, html'), 'page_id')})
    select page_id, cast(len(l) as bigint) as headings, cast(len(list_filter(l, lambda x: x = 1)) as bigint) as h1_count, not list_contains(l, 1) as h1_missing, cast(len(list_filter(range(2, len(l) + 1), lambda i: l[i] > l[i - 1] + 1)) as bigint) as skipped, array_to_string(list_sort(list_distinct(l)), ',') as levels from l where len(l) > 0""",
)
def heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_queries import outline

    return outline(H.headings(H.events(spread(spark, sf_dir, spark.createDataFrame(_OUTLINE, "page_id long, html string"), "page_id")))).select("page_id", "headings", "h1_count", "h1_missing", "skipped", "levels")


@query(
    "question_headings",
    f"""with m as (select page_id, unnest(regexp_extract_all(html, '<h[1-6]>[^<]+</h[1-6]>(?:<p>[^<]+)?')) as m from {dealt(seed_sql(_OUTLINE, 'page_id, html'), 'page_id')}), t as (select page_id, regexp_extract(m, '>([^<]+)<', 1) as text, contains(m, '<p>') as answered from m)
    select page_id, text, answered from t where regexp_matches(text, '[?؟]\\s*$') or regexp_matches(text, '(?i)^(what|how|why|when|where|who|which|whom|whose|is|are|can|could|does|do|did|should|will|would|may|might)\\b')""",
)
def question_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that ask, and whether any text comes before the next heading."""
    from pyspark.sql import Window

    ev = H.events(spread(spark, sf_dir, spark.createDataFrame(_OUTLINE, "page_id long, html string"), "page_id"))
    h = H.headings(ev).withColumn("next", F.lead("el").over(Window.partitionBy("page_id").orderBy("n")))
    asks = F.col("text").rlike(r"[?؟]\s*$") | F.col("text").rlike(r"(?i)^(what|how|why|when|where|who|which|whom|whose|is|are|can|could|does|do|did|should|will|would|may|might)\b")
    q = h.where(asks).select("page_id", "n", "text", "el", "next")
    b = H.text_blocks(ev).select(F.col("page_id").alias("p"), F.col("el").alias("b_el"))
    hit = q.join(b, (F.col("page_id") == F.col("p")) & (F.col("b_el") > F.col("el")) & (F.col("next").isNull() | (F.col("b_el") < F.col("next"))), "left")
    return hit.groupBy("page_id", "n", "text").agg(F.bool_or(F.col("b_el").isNotNull()).alias("answered")).select("page_id", "text", "answered")


def _w(n: int) -> str:
    return " ".join(["w"] * n)


_POSITIONED = [(1, "".join(f"<li>{_w(5)}</li>" for _ in range(4)) + f"<p>{_w(80)}</p><footer>{_w(50)}</footer>"), (2, "".join(f"<li>{_w(6)}</li>" for _ in range(10)) + f"<p>{_w(40)}</p>"), (3, f"<p>{_w(20)}</p>"), (4, "".join("<li>a b</li>" for _ in range(60)))]


@query(
    "content_positioning",
    f"""with d as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '<footer>.*?</footer>', '', 'g'), '<(?:li|p)>([^<]*)', 1)) as t, generate_subscripts(regexp_extract_all(regexp_replace(html, '<footer>.*?</footer>', '', 'g'), '<(?:li|p)>([^<]*)', 1), 1) as k from {dealt(seed_sql(_POSITIONED, 'page_id, html'), 'page_id')}),
    n as (select page_id, k, len(string_split(t, ' ')) as words from d), b as (select *, coalesce(sum(words) over (partition by page_id order by k rows between unbounded preceding and 1 preceding), 0) as before from n),
    g as (select page_id, cast(sum(words) as bigint) as total, cast(min(case when words >= 12 then before end) as bigint) as before from b group by page_id)
    select *, round_even(before / total::double, 4) as share, round_even(before / total::double, 4) <= 0.3 as front_loaded from g where total >= 80 and before is not null""",
)
def content_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far into a page's words its first block of twelve words comes; pages of fewer than 80 words are not judged."""
    from pyspark.sql import Window

    b = H.text_blocks(H.events(spread(spark, sf_dir, spark.createDataFrame(_POSITIONED, "page_id long, html string"), "page_id")))
    w = Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    c = b.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    g = c.groupBy("page_id").agg(F.sum("words").alias("total"), F.min(F.when(F.col("words") >= 12, F.col("before"))).alias("before")).where("total >= 80 and before is not null")
    return g.withColumn("share", F.bround(F.col("before") / F.col("total"), 4)).withColumn("front_loaded", F.col("share") <= 0.3)


_HEADERS = [(1, "Acme Inc | Home", "Welcome", "We sell anvils"), (2, "Acme Inc | Shop", "Shop", "WE SELL anvils"), (3, "Contact", "Contact us", "Other")]
_SEGMENTS = "select scope, page_id, generate_subscripts(parts, 1) as k, trim(unnest(parts)) as segment from (select scope, page_id, list_concat(string_split_regex(title, '[|:—•-]'), string_split_regex(h1, '[|:—•-]')) as parts from h)"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, scope, url, title, h1, description): what each page calls itself, by host."""
    d = spread(spark, sf_dir, spark.createDataFrame(_HEADERS, "page_id int, title string, h1 string, description string"), "page_id")
    return d.join(pages(spark, sf_dir).select("page_id", "url", C.U.host(F.col("url")).alias("scope")), "page_id")


_HEADS_SQL = f"h as (select d.*, p.url, regexp_replace(lower(regexp_extract(p.url, '://([^/?#]*)', 1)), '^www\\.', '') as scope from {dealt(seed_sql(_HEADERS, 'page_id, title, h1, description'), 'page_id')} d join pages p using (page_id))"


@query(
    "brand_phrase",
    f"""with {_HEADS_SQL}, s as ({_SEGMENTS}),
    c as (select scope, lower(segment) as brand, count(*) as n, min((page_id, k)) as first from s where length(segment) >= 2 group by 1, 2 having count(*) > 1) select scope as host, brand, n from c qualify row_number() over (partition by scope order by n desc, first) = 1""",
)
def brand_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that the titles and headings of a host repeat most; of equals, the first seen."""
    s = _headers(spark, sf_dir).select("scope", "page_id", F.posexplode(F.concat(F.split("title", r"[|\-:—•]"), F.split("h1", r"[|\-:—•]"))).alias("k", "segment")).withColumn("segment", F.trim("segment")).where("length(segment) >= 2")
    c = s.groupBy("scope", F.lower("segment").alias("brand")).agg(F.count("*").alias("n"), F.min(F.struct("page_id", "k")).alias("first")).where("n > 1")
    return c.groupBy(F.col("scope").alias("host")).agg(F.max_by("brand", F.struct("n", -F.col("first.page_id"), -F.col("first.k"))).alias("brand"), F.max("n").alias("n"))


@query("reused_descriptions", f"with {_HEADS_SQL} select scope as host, lower(description) as description, count(distinct regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(www\\.)?', ''), '/+$', '')) as pages from h group by 1, 2 having pages >= 2")
def reused_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _headers(spark, sf_dir)
    return d.groupBy(F.col("scope").alias("host"), F.lower("description").alias("description")).agg(F.countDistinct(C.U.page_key(F.col("url"))).alias("pages")).where("pages >= 2")


_ORIENT = "(values (1, 'Acme', null, 'T'), (2, null, null, 'T'), (3, '', 'what we do', ''), (4, 'A', 'b', 'c')) as t(page_id, brand, description, h1)"


@query("orientation", f"select page_id, cast(coalesce(brand, '') <> '' as int) + cast(coalesce(description, '') <> '' as int) + cast(coalesce(h1, '') <> '' as int) >= 2 as orientation_ok from {dealt(_ORIENT, 'page_id')}")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _ORIENT, "page_id").select("page_id", C.orientation(F.col("brand"), F.col("description"), F.col("h1")).alias("orientation_ok"))
