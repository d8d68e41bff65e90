"""The whole audit of a corpus of pages: one parse, signals, findings, and counts by host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.tables import written
from ..operators import content as C
from ..operators import html_events as H
from ..operators import structured as S
from . import rules as R
from .page_queries import _TITLE, HEADINGS, advisory, outline, page_titles, path_intent, shown_sql
from .registry import SQL, literal, pages, query
from .url_queries import PARTS


def page_signals(p: DataFrame, today, ev: DataFrame | None = None) -> DataFrame:
    """One wide row per page (its id in ``site``): what a page alone can show; what it can't stays null.

    The events are written, so a page is parsed once for all branches and nothing stays in executors' memory; every
    branch ends in an aggregate by page, and the branches meet in equi-joins on the page.
    """
    ev = written(H.events(p), "events") if ev is None else ev
    start, shown = (F.col("kind") == "start") & ~F.col("unshown"), (F.col("kind") == "text") & ~F.col("unshown")
    count = lambda cond: F.count_if(start & cond)
    a = F.col("attrs")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("seq", "text")))), lambda x: x["text"]), " ")
    flat = ev.groupBy("page_id").agg(
        F.coalesce(F.sum(F.when(shown, F.regexp_count("text", F.lit(r"\S+")))), F.lit(0)).alias("words"),
        count(F.col("tag") == "p").alias("paragraphs"),
        count(F.col("tag").rlike("^h[1-6]$")).alias("headings"),
        count(F.col("tag") == "article").alias("articles"),
        F.coalesce(F.bool_or(start & (F.col("tag") == "meta") & (F.lower(a["name"]) == "viewport")), F.lit(False)).alias("viewport"),
        F.coalesce(F.bool_or((F.col("kind") == "text") & F.contains(F.lower("text"), F.lit("@media"))), F.lit(False)).alias("media"),
        F.array_max(C.copyright_years(text, today)).alias("copyright_year"),
    )
    n = S.nodes(p)
    blocks = n.groupBy("page_id").agg(F.count_if(F.col("n") == -1).alias("json_blocks"), F.count_if(F.col("error").isNotNull()).alias("json_errors"), F.count_if((F.col("n") >= 0) & (F.size("types") > 0)).alias("entities"))
    heads = outline(H.headings(ev)).select("page_id", "h1_count", "skipped")
    land = C.landing(p, ev).select("page_id", "utility", "dead_end", "privacy", "terms", "placeholders")
    j = p.select("page_id", "url", F.octet_length("html").alias("bytes"))
    for t in (flat, blocks, heads, land, page_titles(ev)):
        j = j.join(t, "page_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    intent = F.coalesce(path_intent(F.col("url")), F.when((F.col("articles") >= 1) & (F.col("paragraphs") >= 3), "article"), F.lit("content"))
    known = {
        "structured_checked": F.lit(True),
        "entities": zero("entities"),
        "json_errors": zero("json_errors"),
        "json_blocks": zero("json_blocks"),
        "h1_count": zero("h1_count"),
        "h1_missing": zero("h1_count") == 0,
        "level_skips": zero("skipped"),
        "below_reference": (zero("words") < advisory(intent)) & (zero("paragraphs") <= 2) & (zero("headings") <= 2),
        "no_viewport_no_media": ~F.coalesce("viewport", F.lit(False)) & ~F.coalesce("media", F.lit(False)),
        "default_title": (F.coalesce("title", F.lit("")) == "") | F.col("title").rlike(C.DEFAULT_TITLE),
        "html_bytes": F.col("bytes").cast("long"),
        "url_depth": U.folders(F.col("url"))["depth"],
        "utility": F.col("utility"),
        "dead_end": F.col("dead_end"),
        "privacy_page": F.col("privacy"),
        "terms_page": F.col("terms"),
        "placeholder_hits": F.size(F.filter(F.split(F.coalesce("placeholders", F.lit("")), ","), lambda x: x != "")).cast("long"),
        "dates_checked": F.lit(True),
        "copyright_age": (F.year(today) - F.col("copyright_year")).cast("long"),
    }
    return j.select(F.col("page_id").cast("string").alias("site"), *[(known[s] if s in known else F.lit(None)).cast(kind).alias(s) for s, kind in R.SIGNALS.items()])


def _today() -> F.Column:
    return F.lit("2025-01-01").cast("date")


#: What links to contacts, privacy and terms are called, as ``content.landing`` has it.
CONTACT_TEXT, PRIVACY_TEXT, TERMS_TEXT = r"(?i)\bcontact\b|\bget in touch\b|\bsupport\b", r"(?i)\bprivacy\s*(?:policy)?\b", r"(?i)\bterms\b|\bconditions\b"


def _has(links: str, rx: str) -> str:
    return f"len(list_filter({links}, lambda x: regexp_matches(x, {literal(rx)}))) > 0"


_ACTION = " or ".join(f"contains(lower(x), {literal(a)})" for a in C.ACTIONS)
#: Whether a page has a link to its privacy statement or its terms, by its HTML.
TRUST = f"({_has('hrefs', C.PRIVACY)}) or ({_has('hrefs', C.TERMS)}) or ({_has('texts', PRIVACY_TEXT)}) or ({_has('texts', TERMS_TEXT)})"
#: For each rule that a page alone can raise, its severity and the condition over table ``c``, by patterns over the HTML.
RAISED = {
    "jsonld_missing": ("high", "not contains(html, 'application/ld+json')"),
    "viewport_missing": ("high", "not regexp_matches(html, '(?is)<meta[^>]*viewport') and not contains(lower(html), '@media')"),
    "h1_missing": ("medium", "h1 = 0"),
    "h1_multiple": ("low", "h1 > 1"),
    "heading_skips": ("low", "h1 = 1 and skipped > 0"),
    "thin_content": ("medium", "below"),
    "html_too_large": ("medium", "strlen(html) > 2000000"),
    "url_too_deep": ("low", "depth > 3"),
    "trust_pages_missing": ("low", f"not ({TRUST}) and not utility"),
    "landing_dead_end": ("medium", f"not contains(html, '<nav') and len(list_filter(texts, lambda x: {_ACTION})) = 0 and not ({_has('hrefs', C.CONTACT)}) and not ({_has('texts', CONTACT_TEXT)}) and len(list_filter(hrefs, lambda x: starts_with(x, '/'))) < 5 and not utility"),
    "placeholder_text": ("medium", f"regexp_matches(shown, {literal(C.PLACEHOLDER)})"),
    "title_default": ("low", f"title = '' or regexp_matches(title, {literal(C.DEFAULT_TITLE)})"),
    "copyright_outdated": ("low", "list_max(list_filter(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(shown, '(?i)(?:copyright|©|\\bcopr\\b)\\s*[^.;<\\n]{1,120}'), ' '), '\\b(?:19|20)[0-9]{2}\\b'), lambda y: cast(y as int)), lambda y: y between 1990 and 2026)) <= 2023"),
}
#: Table ``c``: what the conditions read of each page.
PAGE_TABLES = f"""{PARTS}, {HEADINGS}, depth as ({SQL["content_depth"]}), below_top as ({SQL["url_folders"]}),
    b as (select p.page_id, regexp_replace(p.netloc, '^www\\.', '') as host, p.path, p.html, {_TITLE.replace("html", "p.html")} as title, {shown_sql("p.html")} as shown, regexp_extract_all(p.html, '<a [^>]*href="([^"]*)"', 1) as hrefs, regexp_extract_all(p.html, '(?s)<a [^>]*>([^<]*)</a>', 1) as texts,
        o.h1, o.skipped, d.below, d.words, f.depth from parts p join outlines o using (page_id) join depth d using (page_id) join below_top f using (page_id)),
    c as (select *, regexp_matches(html, '(?i)<input[^>]*type="?password') or (contains(html, '<form') and words < 120 and not contains(html, '<h1')) or regexp_matches(lower(path), {literal(C.UTILITY)}) as utility from b)"""


def _oracle(select: str) -> str:
    """What the rules find, from the HTML by patterns: each condition is worked out for each page."""
    rows = " union all ".join(f"select page_id, host, '{slug}' as slug, '{severity}' as severity from c where {condition}" for slug, (severity, condition) in RAISED.items())
    return f"with {PAGE_TABLES}, f as ({rows}) {select}"


@query("page_findings", _oracle("select page_id, slug, severity from f"))
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.findings(page_signals(pages(spark, sf_dir), _today()))
    return found.select(F.col("site").cast("long").alias("page_id"), "slug", "severity")


@query("host_findings", _oracle("select host, count(distinct page_id) as pages, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from f group by host"))
def host_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    found = R.findings(page_signals(p, _today())).join(p.select(F.col("page_id").cast("string").alias("site"), U.without_www(U.authority(F.col("url"))).alias("host")), "site")
    per = found.groupBy("host", "site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    return per.groupBy("host").agg(F.count("*").alias("pages"), *[F.sum(s).alias(s) for s in ("high", "medium", "low")])
