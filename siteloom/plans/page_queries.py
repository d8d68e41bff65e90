"""Queries over the HTML of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import html_events as H
from .registry import dealt, literal, pages, query, spread
from .url_queries import GROUP, PARTS

#: Text as it is shown: what the fixture's pages need of entity decoding, the ampersand last.
_DECODE = "replace(replace(replace(replace(regexp_replace({}, '&copy;', '©', 'g'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"


def shown_sql(html: str = "html") -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
    return f"regexp_replace({_DECODE.format(f'''regexp_replace({bare}, '<[^>]*>', chr(1), 'g')''')}, '&amp;?', '&', 'g')"


WORD = r"[\p{L}\p{N}_]+"
_TITLE = f"trim(regexp_replace(regexp_replace({_DECODE.format('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')}, '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query(
    "page_overview",
    f"""with {PARTS} select page_id, {_TITLE} as title, cast(len(regexp_extract_all(html, '<h1[ >]')) as bigint) as h1_count, cast(len(regexp_extract_all(html, '<a ')) as bigint) as links,
    cast(len(regexp_extract_all({shown_sql()}, '{WORD}')) as bigint) as words, lower(regexp_replace(netloc, '^www\\.', '') || regexp_replace(path, '/+$', '')) as norm, {GROUP} as url_group from parts""",
)
def page_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, headings, links, words and normalised address of each page: one parse, one aggregate."""
    p = pages(spark, sf_dir)
    ev = H.inside(H.events(p), "title", "in_title")
    shown = (F.col("kind") == "text") & ~F.col("unshown")
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "text") & F.col("in_title").isNotNull(), F.struct("seq", "text")))), lambda x: x["text"]), "")
    start = F.col("kind") == "start"
    facts = ev.groupBy("page_id").agg(
        H.collapsed(title).alias("title"),
        F.count_if(start & (F.col("tag") == "h1")).alias("h1_count"),
        F.count_if(start & (F.col("tag") == "a")).alias("links"),
        F.coalesce(F.sum(F.when(shown, H.word_count(F.col("text")))), F.lit(0)).alias("words"),
    )
    return facts.join(p.select("page_id", U.normalized(F.col("url")).alias("norm"), U.group(F.col("url"))["name"].alias("url_group")), "page_id")


@query(
    "html_tag_counts",
    """with t as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<script>', 'g'), '<([a-z][a-z0-9]*)[ />]', 1)) as tag from pages) select tag, count(*) as n, count(distinct page_id) as pages from t group by tag""",
)
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = H.events(pages(spark, sf_dir)).where("kind = 'start'")
    return ev.groupBy("tag", "page_id").agg(F.count("*").alias("k")).groupBy("tag").agg(F.sum("k").alias("n"), F.count("*").alias("pages"))


_BODY = shown_sql()
_MAIN = shown_sql("regexp_replace(regexp_replace(html, '(?is)<nav>.*?</nav>', ' ', 'g'), '(?is)<footer>.*$', ' ', 'g')")


@query(
    "page_text_share",
    f"""with w as (select page_id, cast(len(regexp_extract_all({_BODY}, '{WORD}')) as bigint) as words, cast(len(regexp_extract_all({_MAIN}, '{WORD}')) as bigint) as main_words from pages) select *, round_even(main_words / words::double, 3) as share from w""",
)
def page_text_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.shown_text(H.events(pages(spark, sf_dir))).withColumn("n", H.word_count(F.col("text")))
    c = t.groupBy("page_id").agg(F.sum("n").alias("words"), F.sum(F.when(~F.col("chrome"), F.col("n")).otherwise(0)).alias("main_words"))
    return c.withColumn("share", F.bround(F.col("main_words") / F.col("words"), 3))


def thin(main, total) -> F.Column:
    """Hardly any text, or hardly any that is not the page's frame."""
    return (main < 80) | ((total >= 200) & (main / total < 0.15))


_THIN = "(values (1, 79, 5000), (2, 80, 199), (3, 80, 5000), (4, 149, 1000), (5, 150, 1000), (6, 0, 0)) as t(page_id, main_len, total_len)"


@query("thin_content", f"select page_id, main_len < 80 or (total_len >= 200 and main_len / total_len < 0.15) as thin from {dealt(_THIN, 'page_id')}")
def thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _THIN, "page_id").select("page_id", thin(F.col("main_len"), F.col("total_len")).alias("thin"))


def page_links(p: DataFrame, ev: DataFrame) -> DataFrame:
    """(page_id, seq, href, url): navigational links, absolute and without fragments.

    Absolute addresses, those of the host and those of the page's folder are joined as RFC 3986 has it.
    """
    a = ev.where("kind = 'start' and tag = 'a'").select("page_id", "seq", F.col("attrs")["href"].alias("href")).where(F.coalesce("href", F.lit("")) != "")
    a = a.where(U.navigational(F.col("href"))).join(p.select("page_id", F.col("url").alias("base")), "page_id")
    root = F.concat(U.scheme(F.col("base")), F.lit("://"), F.regexp_extract("base", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(U.path(F.col("base")), "[^/]*$", "")
    h = F.col("href")
    full = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(U.scheme(F.col("base")), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, U.path(F.col("base")), h))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), h))
    )
    return a.select("page_id", "seq", "href", U.without_dots(F.regexp_replace(full, "#.*$", "")).alias("url"))


@query(
    "page_links",
    f"""with {PARTS}, a as (select page_id, netloc, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from parts)
    select page_id, replace(href, '&amp;', '&') as href, regexp_extract(url, '^[a-z]+') || '://' || regexp_extract(url, '://([^/?#]*)', 1) || replace(href, '&amp;', '&') as url from a""",
)
def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return page_links(p, H.events(p)).select("page_id", "href", "url")


@query(
    "page_links_by_sql",
    f"""with {PARTS}, a as (select page_id, netloc, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from parts)
    select page_id, replace(href, '&amp;', '&') as href, regexp_extract(url, '^[a-z]+') || '://' || regexp_extract(url, '://([^/?#]*)', 1) || replace(href, '&amp;', '&') as url from a""",
)
def links_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from SQL alone, by the table function; links of pages that start with a slash, as all of theirs do."""
    H.register(spark)
    return spark.sql(
        """select p.page_id, e.attrs['href'] as href, concat(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0), regexp_replace(e.attrs['href'], '#.*$', '')) as url
        from {pages} p, lateral html_events(p.html, 'start') e where e.tag = 'a' and startswith(e.attrs['href'], '/')""",
        pages=pages(spark, sf_dir),
    )


@query(
    "link_targets",
    f"""with {PARTS}, a as (select page_id, lower(regexp_replace(netloc, '^www\\.', '') || regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '#.*$', ''), '/+$', '')) as target from parts)
    select target, count(*) as links, count(distinct page_id) as pages from a group by target""",
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    t = page_links(p, H.events(p)).select("page_id", U.normalized(F.col("url")).alias("target"))
    return t.groupBy("target", "page_id").agg(F.count("*").alias("n")).groupBy("target").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query(
    "navigation_reach",
    f"""with {PARTS}, home as (select regexp_replace(netloc, '^www\\.', '') as host, min(page_id) as page_id from parts group by 1), l as (select h.host, lower(h.host || regexp_replace(regexp_replace(unnest(regexp_extract_all(p.html, '<a href="([^"]*)"', 1)), '#.*$', ''), '/+$', '')) as target from home h join parts p using (page_id)),
    k as (select distinct host, target as key from l union select host, host || '/about' from home) select host, key, exists (select 1 from l where l.host = k.host and l.target = k.key) as linked from k""",
)
def navigation_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which key addresses does each site's start page link? The first page of a host stands for its start page."""
    p = pages(spark, sf_dir).withColumn("host", U.without_www(U.authority(F.col("url"))))
    home = p.groupBy("host").agg(F.min("page_id").alias("page_id"))
    own = p.join(home, ["host", "page_id"])
    linked = page_links(own, H.events(own)).join(own.select("page_id", "host"), "page_id").select("host", U.normalized(F.col("url")).alias("key")).distinct()
    keys = linked.unionByName(home.select("host", F.concat("host", F.lit("/about")).alias("key"))).distinct()
    return keys.join(linked.withColumn("hit", F.lit(True)), ["host", "key"], "left").select("host", "key", F.coalesce("hit", F.lit(False)).alias("linked"))


#: The levels of each page's headings with text, in order, as the fixture's pages write them.
HEADINGS = """heads as (select page_id, list_transform(regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?is)<h([1-6])(?:\\s[^>]*)?>\\s*[^<\\s][^<]*</h[1-6]>', 1), lambda x: cast(x as int)) as levels from pages),
    outlines as (select page_id, levels, len(list_filter(levels, lambda x: x = 1)) as h1, len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) as skipped from heads)"""


@query(
    "page_outline",
    f"with {HEADINGS} select page_id, cast(len(levels) as bigint) as headings, cast(h1 as bigint) as h1_count, h1 = 0 as h1_missing, h1 > 1 as multiple_h1, cast(skipped as bigint) as skipped, array_to_string(list_sort(list_distinct(levels)), ',') as levels from outlines where len(levels) > 0",
)
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(H.headings(H.events(pages(spark, sf_dir))))


def outline(heads: DataFrame) -> DataFrame:
    """Counts, skipped levels and the levels there are, of each page with headings."""
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("n"))
    h = heads.withColumn("skips", F.coalesce(F.col("level") > before + 1, F.lit(False)))
    one = F.count_if(F.col("level") == 1)
    return h.groupBy("page_id").agg(
        F.count("*").alias("headings"), one.alias("h1_count"), (one == 0).alias("h1_missing"), (one > 1).alias("multiple_h1"), F.count_if("skips").alias("skipped"), F.array_join(F.transform(F.array_sort(F.collect_set("level")), lambda x: x.cast("string")), ",").alias("levels")
    )


#: Advisory words of each kind of page. Fixed values.
BANDS = [("product", 120), ("service", 150), ("article", 350), ("homepage", 80), ("category", 60), ("content", 60)]
#: What a path says about a page, in order. Fixed values.
PATH_INTENTS = [
    (r"/(login|log-in|signin|sign-in|register|signup|sign-up|account|cart|checkout|basket|contact|support/ticket|search|404|not-found|thank-you|privacy|terms|legal|cookie|gdpr|unsubscribe|logout)(/|$|\?)", "utility"),
    (r"/(app|dashboard|console|portal|admin|tool|calculator|configurator|playground)(/|$|\?)", "app"),
    (r"/(blog|news|article|articles|post|posts|insights|stories|press|newsroom|resources/[a-z].*[a-z])(/|$)", "article"),
    (r"/(product|products|shop|store|item|items|p|sku)(/|$)", "product"),
    (r"/(pricing|plans|packages)(/|$)", "service"),
    (r"/(services|solutions|features|capabilities|use-cases?)(/|$)", "service"),
    (r"/(category|categories|collections?|tag|tags|topics?)(/|$)", "category"),
]


def path_intent(url) -> F.Column:
    """The first rule that a path satisfies; a root is a homepage; null otherwise."""
    p = F.lower(U.path(url))
    out = F.when(p.isin("", "/"), "homepage")
    for pattern, name in PATH_INTENTS:
        out = out.when(p.rlike(pattern), name)
    return out


def advisory(intent) -> F.Column:
    out = None
    for name, words in BANDS:
        out = F.when(intent == name, words) if out is None else out.when(intent == name, words)
    return out.cast("long")


@query(
    "content_depth",
    f"""with {PARTS}, c as (select page_id, cast(len(list_filter(string_split_regex({shown_sql()}, '[\\s\\x01]+'), lambda w: w <> '')) as bigint) as words, cast(len(regexp_extract_all(html, '<p[ >]')) as bigint) as paragraphs,
    cast(len(regexp_extract_all(html, '<h[1-6][ >]')) as bigint) as headings, cast(len(regexp_extract_all(html, '<li[ >]')) as bigint) as items, cast(len(regexp_extract_all(html, '<article[ >]')) as bigint) as articles, path from parts),
    i as (select *, case when path in ('', '/') then 'homepage' when articles >= 1 and paragraphs >= 3 then 'article' else 'content' end as intent from c)
    select page_id, words, paragraphs, headings, items, intent, cast(case intent when 'article' then 350 when 'homepage' then 80 else 60 end as bigint) as advisory,
    words < case intent when 'article' then 350 when 'homepage' then 80 else 60 end and paragraphs <= 2 and headings <= 2 as below from i""",
)
def content_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and structure against what pages of the kind usually have."""
    p = pages(spark, sf_dir)
    start = (F.col("kind") == "start") & ~F.col("unshown")

    def count(cond) -> F.Column:
        return F.count_if(start & cond)

    shown = (F.col("kind") == "text") & ~F.col("unshown")
    c = H.events(p).groupBy("page_id").agg(
        F.coalesce(F.sum(F.when(shown, F.regexp_count("text", F.lit(r"\S+")))), F.lit(0)).cast("long").alias("words"),
        count(F.col("tag") == "p").alias("paragraphs"),
        count(F.col("tag").rlike("^h[1-6]$")).alias("headings"),
        count(F.col("tag") == "li").alias("items"),
        count(F.col("tag") == "article").alias("articles"),
        count(F.col("tag") == "form").alias("forms"),
        count((F.col("tag") == "input") & (F.lower(F.col("attrs")["type"]) == "password")).alias("passwords"),
    )
    c = c.join(p.select("page_id", path_intent(F.col("url")).alias("by_path")), "page_id")
    layout = F.when((F.col("articles") >= 1) & (F.col("paragraphs") >= 3), "article").when((F.col("forms") >= 1) & (F.col("passwords") >= 1), "utility")
    intent = F.coalesce("by_path", layout, F.lit("content"))
    form_page = (F.col("passwords") >= 1) | ((F.col("forms") >= 1) & (F.col("words") < 120) & (F.col("paragraphs") <= 2))
    c = c.withColumn("intent", F.when(form_page & intent.isin("homepage", "category", "content"), "utility").otherwise(intent)).withColumn("advisory", advisory(F.col("intent")))
    below = F.coalesce((F.col("words") < F.col("advisory")) & (F.col("paragraphs") <= 2) & (F.col("headings") <= 2), F.lit(False))
    return c.select("page_id", "words", "paragraphs", "headings", "items", "intent", "advisory", below.alias("below"))


_INTENT_URLS = "(values (1, 'https://a.com/'), (2, 'https://a.com'), (3, 'https://a.com/blog/x'), (4, 'https://a.com/Products/7'), (5, 'https://a.com/pricing'), (6, 'https://a.com/use-case/x'), (7, 'https://a.com/topics/'), (8, 'https://a.com/app'), (9, 'https://a.com/log-in?next=1'), (10, 'https://a.com/vinyl.htm'), (11, 'https://a.com/resources/a-b')) as t(page_id, url)"


_INTENT_CASES = " ".join(f"when regexp_matches(p, {literal(rx)}) then {literal(name)}" for rx, name in PATH_INTENTS)
_BAND_CASES = " ".join(f"when {literal(name)} then {words}" for name, words in BANDS)


@query(
    "path_intent",
    f"""with p as (select page_id, url, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) as p from {dealt(_INTENT_URLS, 'page_id')}), i as (select page_id, url, case when p in ('', '/') then 'homepage' {_INTENT_CASES} end as intent from p)
    select *, case intent {_BAND_CASES} end as advisory from i""",
)
def path_intent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _INTENT_URLS, "page_id").select("page_id", "url", path_intent(F.col("url")).alias("intent")).withColumn("advisory", advisory(F.col("intent")))


@query(
    "page_weight",
    """select page_id, cast(octet_length(encode(html)) as bigint) as html_bytes, cast(len(regexp_extract_all(html, '<img[ >]')) as bigint) as images, cast(len(regexp_extract_all(html, '<link[^>]*stylesheet')) + len(regexp_extract_all(html, '<script[^>]*src=')) as bigint) as resources from pages""",
)
def page_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    start, a = F.col("kind") == "start", F.col("attrs")
    sheet = (F.col("tag") == "link") & F.lower(a["rel"]).rlike("(^| )stylesheet( |$)") & (F.coalesce(a["href"], F.lit("")) != "")
    script = (F.col("tag") == "script") & (F.coalesce(a["src"], F.lit("")) != "")
    c = H.events(p).groupBy("page_id").agg(F.count_if(start & (F.col("tag") == "img")).alias("images"), F.count_if(start & (sheet | script)).alias("resources"))
    return p.select("page_id", F.octet_length("html").cast("long").alias("html_bytes")).join(c, "page_id")


@query("mobile_signals", "select page_id, contains(lower(html), 'name=\"viewport\"') as viewport, contains(lower(regexp_extract(html, '(?is)<style[^>]*>(.*?)</style>', 1)), '@media') as media_queries from pages")
def mobile_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = H.inside(H.events(pages(spark, sf_dir)), "style", "in_style")
    viewport = (F.col("kind") == "start") & (F.col("tag") == "meta") & (F.lower(F.trim(F.col("attrs")["name"])) == "viewport")
    media = (F.col("kind") == "text") & F.col("in_style").isNotNull() & F.contains(F.lower("text"), F.lit("@media"))
    return ev.groupBy("page_id").agg(F.coalesce(F.bool_or(viewport), F.lit(False)).alias("viewport"), F.coalesce(F.bool_or(media), F.lit(False)).alias("media_queries"))


@query(
    "landing_position",
    """with b as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<script>', 'g'), '(?s)<!--.*?-->', ' ', 'g') as h from pages),
    t as (select page_id, len(regexp_extract_all(h, '<[a-z][a-z0-9]*[ />]')) as total, len(regexp_extract_all(h[:strpos(h, '<h1>')], '<[a-z][a-z0-9]*[ />]')) + 1 as first from b)
    select page_id, cast(total as bigint) as elements, cast(first as bigint) as first_content, round_even(first / total::double, 3) as share from t""",
)
def landing_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far into its elements a page's first heading comes."""
    c = H.events(pages(spark, sf_dir)).where("kind = 'start'").groupBy("page_id").agg(F.max("el").cast("long").alias("elements"), F.min(F.when(F.col("tag") == "h1", F.col("el"))).cast("long").alias("first_content"))
    return c.withColumn("share", F.bround(F.col("first_content") / F.col("elements"), 3))


@query("duplicate_titles", f"with t as (select {_TITLE} as title, page_id from pages) select lower(title) as title, count(*) as pages, min(page_id) as first_page from t where title <> '' group by lower(title) having count(*) >= 2")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_titles(H.events(pages(spark, sf_dir))).where("title <> ''")
    return t.groupBy(F.lower("title").alias("title")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages >= 2")


def page_titles(ev: DataFrame) -> DataFrame:
    rows = H.inside(ev, "title", "in_title").where("kind = 'text' and in_title is not null")
    return rows.groupBy("page_id").agg(H.collapsed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")).alias("title"))


@query(
    "heading_followups",
    f"""with h as (select page_id, strpos(html, '</h1>') as k, html from pages where contains(html, '</h1>')),
    p as (select page_id, regexp_extract(substr(html, k), '(?s)<p>(.*?)</p>', 1) as raw from h)
    select page_id, cast(len(regexp_extract_all(regexp_replace({_DECODE.format("regexp_replace(raw, '<[^>]*>', chr(1), 'g')")}, '&amp;?', '&', 'g'), '{WORD}')) as bigint) as words from p where raw <> ''""",
)
def heading_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the paragraph that follows each page's heading: up to the paragraph's end, over what it forgot to close."""
    ev = H.events(pages(spark, sf_dir))
    w = Window.partitionBy("page_id").orderBy("seq")
    ended = F.min(F.when((F.col("tag") == "h1") & (F.col("kind") == "end"), F.col("seq"))).over(Window.partitionBy("page_id"))
    rows = ev.withColumn("h", ended).where("h is not null and seq > h")
    opened = F.min(F.when((F.col("tag") == "p") & (F.col("kind") == "start"), F.col("seq"))).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("o", opened).where("o is not null and seq > o")
    closed = F.min(F.when((F.col("tag") == "p") & (F.col("kind") == "end"), F.col("seq"))).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("c", closed).where("c is not null and seq < c and kind = 'text' and not unshown")
    return rows.groupBy("page_id").agg(F.sum(H.word_count(F.col("text"))).alias("words"))
