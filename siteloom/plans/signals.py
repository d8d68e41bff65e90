"""Signals of pages and of whole sites, measured by the operators: what ``rules.findings`` reads.

Each function below gives some columns of ``rules.SIGNALS``, a row a page or a site; what was not measured stays null.
They meet in equi-joins on the page, are rolled up to one row a host by ``by_site``, and there meet what was recorded of
the host as a whole: crawler rules, handshakes, fetches, sitemaps, search results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.tables import written
from ..operators import access as A
from ..operators import content as C
from ..operators import evidence as G
from ..operators import html_events as H
from ..operators import robots as B
from ..operators import structured as S
from . import rules as R
from .audit import PAGE_TABLES, RAISED, TRUST, page_signals
from .page_queries import WORD, outline, page_links, page_titles, shown_sql
from .registry import pages, query

#: What scripts mount on, where they keep their data, and signs of a challenge page. Fixed values.
MOUNTS = ["root", "app", "__next", "__nuxt", "app-root", "react-root", "___gatsby", "gatsby-focus-wrapper", "ember-application", "ember-app", "angular-app", "ng-app", "vue-app", "svelte-app", "blazor-app", "blazor-content", "app-container", "main-content", "portal-root", "page-content", "spa-root", "client-root"]
MOUNT_SHAPE = r"(?i)^(?:[a-z0-9]+[-_])?(?:root|app|mount|spa|client)(?:[-_][a-z0-9-]+)?$|^(?:react|vue|ng|angular|svelte|ember|next|nuxt|gatsby|blazor|qwik|astro)[-_][a-z0-9-]*(?:root|app|mount|container|wrapper)[a-z0-9-]*$"
MOUNT_CLASSES = ["react-app", "vue-app", "angular-app", "svelte-app", "ember-app", "nuxt-app", "gatsby-app", "next-app", "ng-view", "ng-app"]
ISLANDS = ["__NEXT_DATA__", "__NUXT__", "__STATE__", "__INITIAL_STATE__", "__REDUX_STATE__", "__APOLLO_STATE__", "__RELAY_STORE__"]
CHALLENGE_NAMES = ["cf-challenge-body", "cf-browser-verification", "cf-wrapper", "cf-error-overview", "captcha-container", "ddos-protection", "px-captcha", "datadome-interstitial", "akamai-wait-spinner"]
CHALLENGE_SCRIPT = r"(?i)window\._cf_chl_opt|window\.__ddg_runtime|window\.__akamai|window\.botd|_px\.init|window\.__DDGU"
CHALLENGE_TITLE = r"(?i)just a moment|attention required|access denied|browser check|checking your browser|security check|human verification|ddos protection|ray id"
SKELETON = r"(?i)\b(?:skeleton|shimmer|ghost-?(?:element|card|loader)|loading-?(?:state|placeholder|skeleton))\b"
SERVED_ELEMENTS = ["turbo-frame", "turbo-stream", "turbo-cable-stream-source", "astro-island", "astro-slot", "astro-static-slot", "is-land", "trix-editor", "rails-ujs", "live-view", "phx-", "hotwire-", "amp-img", "amp-video", "amp-analytics", "amp-ad", "amp-list", "model-viewer", "lite-youtube", "media-chrome"]
#: How a heading asks. Fixed values.
ASKS = r"[?؟]\s*$|(?i)^(what|how|why|when|where|who|which|whom|whose|is|are|can|could|does|do|did|should|will|would|may|might)\b"


def _start(*more: Column) -> Column:
    return reduce(lambda x, y: x & y, more, F.col("kind") == "start")


def _no(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


# ---- one page ------------------------------------------------------------------------------------------------------


def markup(p: DataFrame, ev: DataFrame) -> DataFrame:
    """Directives, redirects, and what is not text. ``p`` may lack ``headers``."""
    if "headers" not in p.columns:
        p = p.withColumn("headers", F.lit(None).cast("map<string,string>"))
    said = A.directives(p, ev).select("page_id", F.col("is_noindex").alias("noindex"), F.col("is_nofollow").alias("nofollow"), F.col("duplicate_canonical").alias("canonical_duplicate"))
    moved = C.redirects(ev).select("page_id", F.col("redirects").alias("client_redirect"), (F.size("routing") > 0).alias("spa_routing"))
    things = C.media(ev).select(
        "page_id", F.col("img_missing").alias("images_no_alt"), F.col("img_generic").alias("images_generic_alt"), "controls_unlabeled", "svg_unlabeled", "media_no_captions", "iframes_no_title", "canvas_no_fallback", "icons_unlabeled"
    )
    return said.join(moved, "page_id", "left").join(things, "page_id", "left")


def reading(ev: DataFrame) -> DataFrame:
    """Headings without a first, questions without an answer before the next heading, and how soon content comes."""
    heads, blocks = H.headings(ev), H.text_blocks(ev)
    level = outline(heads).select("page_id", (F.col("h1_missing") & (F.col("headings") > 0)).alias("h1_subheadings"))
    h = heads.withColumn("next", F.lead("el").over(Window.partitionBy("page_id").orderBy("n"))).where(F.col("text").rlike(ASKS))
    b = blocks.select("page_id", F.col("el").alias("at_el"))
    open_ = h.join(b, "page_id", "left").groupBy("page_id", "n").agg(F.bool_or((F.col("at_el") > F.col("el")) & (F.col("next").isNull() | (F.col("at_el") < F.col("next")))).alias("answered"))
    asked = open_.groupBy("page_id").agg(F.count_if(~_no("answered")).alias("unanswered"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("page_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = blocks.withColumn("before", before).groupBy("page_id").agg(F.sum("words").alias("total"), F.min(F.when(F.col("words") >= 12, F.col("before"))).alias("before")).where("total >= 80 and before is not null")
    far = far.select("page_id", F.lit(True).alias("question_checked"), (F.col("before") / F.col("total") <= 0.3).alias("front_loaded"))
    return level.join(asked, "page_id", "full_outer").join(far, "page_id", "full_outer")


def structured(p: DataFrame, n: DataFrame) -> DataFrame:
    """What the entities of a page are and lack, and whether the page shows what they say."""
    e = S.entities(n)
    roles = S.grounding(e).select("page_id", "structural_only", (F.size("identity") > 0).alias("has_identity"), F.size("unclassified").cast("long").alias("unclassified_types"))
    told = S.descriptions(e).select("page_id", "describable", (F.col("describable") - F.col("described")).alias("description_gaps"))
    lacks = S.completeness(e).where("size(missing) > 0").groupBy("page_id").agg(F.count("*").alias("lacking"))
    sold = S.offers(e, n).where("not has_name or not coalesce(has_offers, false) or price is null").groupBy("page_id").agg(F.count("*").alias("unsold"))
    pairs = S.faq_pairs(e, n)
    asked = pairs.groupBy("page_id").agg(F.count("*").alias("faq_detected"), F.count_if(F.col("question").isNotNull() & F.col("answer").isNotNull()).alias("faq_complete"))
    unseen = S.faq_overlap(pairs, p).groupBy("page_id").agg(F.count("*").alias("faq_low_overlap"))
    items = S.prop("itemListElement")
    crumbs = e.where(S.is_a(["BreadcrumbList"])).groupBy("page_id").agg(F.count_if(F.coalesce(items, F.lit("[]")).isin("[]", "", "null")).alias("breadcrumbs_empty"))
    by = S.authors(e).groupBy("page_id").agg(F.count_if("placeholder").alias("placeholder_authors"))
    wrong = S.contact_mismatches(e, p).groupBy("page_id").agg(F.count("*").alias("nap_mismatches"))
    same = G.same_as(n).withColumn("host", U.host(F.col("url")))
    known = same.groupBy("page_id").agg(
        F.bool_or(C.first_host(F.col("host"), ["wikipedia.org", "wikidata.org"]).isNotNull()).alias("sameas_wiki"), F.bool_or(C.first_host(F.col("host"), C.REGISTRIES).isNotNull()).alias("sameas_registry"), F.lit(True).alias("sameas_found")
    )
    j = p.select("page_id", U.short_root(F.col("url")).alias("is_root"), F.col("html").isNotNull().alias("html_provided"))
    for t in (roles, told, lacks, sold, asked, unseen, crumbs, by, wrong, known):
        j = j.join(t, "page_id", "left")
    return (
        j.withColumn("schema_incomplete", F.coalesce("lacking", F.lit(0)) + F.coalesce("unsold", F.lit(0)))
        .withColumn("faq_checked", F.col("faq_detected").isNotNull())
        .withColumn("nap_checked", F.lit(True))
        .withColumn("sameas_found", F.when(F.col("html_provided"), _no("sameas_found")))
        .drop("lacking", "unsold")
    )


def facts(n: DataFrame, ev: DataFrame) -> DataFrame:
    """Whether what products and organisations declare about themselves stands in the text of their page."""
    e = S.entities(n)
    named = e.where(S.is_a(["Product", "IndividualProduct", "SomeProducts", "SoftwareApplication", *S.COMPLETE["organization"][0]]))
    said = named.select("page_id", F.explode(F.array(S.prop("name"), S.prop("sku"), F.get_json_object("props", "$.brand.name"))).alias("value"))
    sold = S.offers(e, n).select("page_id", F.explode(F.array("price", "availability")).alias("value"))
    values = said.unionByName(sold).where("trim(value) <> ''").join(H.joined(H.shown_text(ev)), "page_id")
    return S.consistency(values).select("page_id", F.col("inconsistent").alias("facts_inconsistent"))


def dates(n: DataFrame, ev: DataFrame, now: Column) -> DataFrame:
    """The age of what a page says, by its declared dates or those that it shows, and how recent its listings are."""
    e = S.entities(n).groupBy("page_id").agg(F.max(S.prop("datePublished")).alias("published"), F.max(S.prop("dateModified")).alias("modified"))
    newest = H.joined(H.shown_text(ev)).select("page_id", F.get(C.visible_dates(F.col("text"), F.to_date(now)), F.lit(0)).alias("newest"))
    facts = C.date_facts(F.col("published"), F.col("modified"), F.col("newest"), now)
    d = newest.join(e, "page_id", "full_outer").select("page_id", facts["age_days"].alias("content_age_days"), facts["source"].alias("content_age_source"), facts["issue"].alias("date_issue"))
    listed = C.listing_recency(G.listing_dates(ev), F.to_date(now)).select("page_id", F.lit(True).alias("decay_checked"), "decayed", (F.col("precision") == "relative_recent").alias("relative_recent"))
    return d.join(listed, "page_id", "full_outer")


def measured(ev: DataFrame) -> DataFrame:
    """(page_id, m): of a page as it stands, what ``content.barriers``, ``skeleton``, ``waf`` and ``hydration`` read."""
    rows = H.inside(H.inside(ev, "script", "in_script"), "noscript", "in_noscript")
    a, text = F.col("attrs"), F.col("kind") == "text"
    ident, cls = F.trim(F.coalesce(a["id"], F.lit(""))), F.lower(F.coalesce(a["class"], F.lit("")))
    names = F.lower(F.concat_ws(" ", a["id"], a["class"]))
    shown, main = ~F.col("unshown") & ~F.col("hidden"), ~F.col("chrome")
    has = lambda s, known: reduce(lambda x, y: x | y, [F.contains(s, F.lit(k)) for k in known])
    words = lambda on: F.coalesce(F.sum(F.when(text & on, F.regexp_count("text", F.lit(r"\S+")))), F.lit(0))
    script, hint = F.when(text & F.col("in_script").isNotNull(), F.col("text")), F.when(text & F.col("in_noscript").isNotNull(), F.col("text"))
    count = lambda rx, *on: F.count_if(_start(F.col("tag").rlike(rx), shown, *on))
    bootstraps = lambda on: _no(F.bool_or(on))
    custom = F.col("tag").contains("-") & ~reduce(lambda x, y: x | y, [F.startswith("tag", F.lit(t)) for t in SERVED_ELEMENTS])
    g = rows.groupBy("page_id").agg(
        words(shown & main).alias("words"),
        words(shown).alias("words_all"),
        words(shown & main).alias("words_main"),
        count("^p$").alias("paragraphs"),
        count("^h[1-6]$").alias("headings"),
        count("^li$").alias("items"),
        count("^p$", main).alias("paragraphs_main"),
        count("^h[1-6]$", main).alias("headings_main"),
        count("^li$", main).alias("items_main"),
        F.count_if(_start(F.col("tag") == "script", F.contains(F.lower(F.coalesce(a["type"], F.lit(""))), F.lit("ld+json")))).alias("jsonld"),
        bootstraps(_start(F.lower(ident).isin(MOUNTS) | ident.rlike(MOUNT_SHAPE) | has(cls, MOUNT_CLASSES))).alias("mounts"),
        bootstraps(_start(ident.isin(ISLANDS))).alias("islands"),
        F.count_if(_start(custom, shown)).alias("custom"),
        F.array_union(
            F.collect_set(F.when(_start(F.col("tag") == "script"), C.first_label(F.coalesce(a["src"], F.lit("")), C.FRAMEWORK_SOURCES))),
            F.array_distinct(F.flatten(F.collect_list(C.labels(script, C.FRAMEWORK_TEXTS)))),
        ).alias("frameworks"),
        bootstraps(_start(names.rlike(SKELETON))).alias("markers"),
        bootstraps(_start(has(names, CHALLENGE_NAMES))).alias("challenge_names"),
        bootstraps(script.rlike(CHALLENGE_SCRIPT)).alias("challenge_script"),
        bootstraps(hint.rlike(C.JS_REQUIRED)).alias("js_required"),
    )
    heads = H.headings(ev).groupBy("page_id").agg(F.collect_list(F.lower("text")).alias("texts"))
    g = g.join(heads, "page_id", "left").join(page_titles(ev), "page_id", "left")
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    g = g.withColumn("skeleton", C.skeleton(F.col("words"), F.col("markers"), texts))
    g = g.withColumn("waf", C.waf(F.col("challenge_names"), F.col("challenge_script"), _no(F.col("title").rlike(CHALLENGE_TITLE)), F.col("words_main"), F.col("words_all")))
    return g.select("page_id", F.struct(*[c for c in g.columns if c not in ("page_id", "texts", "title")]).alias("m"))


def rendering(p: DataFrame, ev: DataFrame, n: DataFrame) -> DataFrame:
    """What keeps a page from being read without scripts; against ``rendered_html``, if ``p`` has it and it is there.

    ``render_reason`` says why a page was not rendered.
    """
    raw = p.select("page_id", F.octet_length("html").alias("bytes")).join(measured(ev).withColumnRenamed("m", "raw"), "page_id", "left")
    if "rendered_html" in p.columns:
        done = p.where("rendered_html is not null").select("page_id", "url", F.col("rendered_html").alias("html"))
        after = written(H.events(done), "rendered-events")
        raw = raw.join(measured(after).withColumnRenamed("m", "rendered"), "page_id", "left")
        types = lambda d, name: S.entities(d).select("page_id", F.explode("types").alias("t")).groupBy("page_id").agg(F.collect_set("t").alias(name))
        urls = lambda d, e, name: page_links(d, e).select("page_id", U.normalized(F.col("url")).alias("url")).distinct().groupBy("page_id").agg(F.collect_set("url").alias(name))
        for t in (types(n, "types_raw"), types(S.nodes(done), "types_done"), urls(p, ev, "urls_raw"), urls(done, after, "urls_done"), done.select("page_id", F.lit(True).alias("was_rendered"))):
            raw = raw.join(t, "page_id", "left")
        none = F.array().cast("array<string>")
        more = lambda x: F.size(F.array_except(F.coalesce(f"{x}_done", none), F.coalesce(f"{x}_raw", none))).cast("long")
        seen = F.col("was_rendered").isNotNull()
        raw = raw.withColumn("schema_barrier", F.when(seen, more("types") > 0)).withColumn("links_js_only", F.when(seen, more("urls"))).withColumn("links_rendered", F.when(seen, F.size(F.coalesce("urls_done", none)).cast("long")))
        raw = raw.withColumn("render_available", F.when(seen, True))
        if "render_reason" in p.columns:
            why = p.select("page_id", F.nullif("render_reason", F.lit("")).alias("render_reason"))
            raw = raw.join(why, "page_id", "left").withColumn("render_available", F.when(F.col("render_reason").isNull(), F.col("render_available")).otherwise(seen))
    else:
        raw = raw.withColumn("rendered", F.lit(None).cast(raw.schema["raw"].dataType))
    m = F.col("raw")
    reasons = C.barriers(F.struct(*[m[c].alias(c) for c in ("words", "paragraphs", "headings", "items", "paragraphs_main", "headings_main", "items_main", "mounts", "islands", "custom", "frameworks", "skeleton", "waf", "js_required")], "bytes", C.hydration().alias("hydrates")))
    got = F.col("raw").isNotNull()
    return raw.select("page_id", F.when(got, m["waf"]).alias("waf_challenge"), F.when(got, m["skeleton"]).alias("skeleton"), F.when(got, F.size(reasons) > 0).alias("rendering_barrier"), *[c for c in ("schema_barrier", "links_js_only", "links_rendered", "render_available", "render_reason") if c in raw.columns])


def naming(p: DataFrame, ev: DataFrame, n: DataFrame) -> DataFrame:
    """Whether a page says who speaks and what about, whether its title has the name, and its description (for the site)."""
    a = F.col("attrs")
    meta = lambda key, name: F.min_by(F.when(_start(F.col("tag") == "meta", F.lower(a[key]) == name), F.nullif(F.trim(a["content"]), F.lit(""))), F.when(_start(F.col("tag") == "meta", F.lower(a[key]) == name), F.col("seq")))
    tags = ev.groupBy("page_id").agg(meta("name", "description").alias("meta"), meta("property", "og:site_name").alias("og_site"), meta("property", "og:description").alias("og_description"))
    org = S.entities(n).where(S.is_a(S.COMPLETE["organization"][0]))
    org = org.groupBy("page_id").agg(F.min_by(S.prop("name"), F.struct("block", "n")).alias("org_name"), F.min_by(S.prop("description"), F.struct("block", "n")).alias("org_description"))
    h1 = H.headings(ev).where("level = 1").groupBy("page_id").agg(F.min_by("text", "n").alias("h1"))
    j = p.select("page_id", "url")
    for t in (tags, org, h1, page_titles(ev)):
        j = j.join(t, "page_id", "left")
    none = F.lit(None).cast("string")
    called = G.brand_candidates(j.withColumn("logo_alt", none).withColumn("subhead", none)).select("page_id", "brand", "brand_source", "description")
    j = j.join(called, "page_id")
    own = F.when(F.col("brand_source") != "title_suffix", F.lower(F.trim("brand")))
    return j.select("page_id", C.orientation(F.col("brand"), F.col("description"), F.col("h1")).alias("orientation_ok"), (~F.contains(F.lower(F.coalesce("title", F.lit(""))), own)).alias("brand_missing_in_title"), F.lower("meta").alias("siteloom_description"))


def all_page_signals(p: DataFrame, now: Column) -> DataFrame:
    """(page_id, url, siteloom_description, signals...) of pages (page_id, url, html, and if known status, headers, rendered_html, render_reason).

    A page that did not answer with success gives its status only: what an error page says is not the site's.
    """
    if "status" in p.columns:
        failed = p.where("not coalesce(status between 200 and 299, false)").select("page_id", "url", F.col("status").cast("long").alias("http_status"), F.lit(False).alias("dates_checked"), F.lit(False).alias("decay_checked"))
        p = p.where("status between 200 and 299")
    p = p.withColumn("page_id", F.col("page_id").cast("long"))
    ev, n = written(H.events(p), "events"), written(S.nodes(p), "nodes")
    base = page_signals(p, F.to_date(now), ev).withColumn("page_id", F.col("site").cast("long"))
    parts = [markup(p, ev), reading(ev), structured(p, n), facts(n, ev), dates(n, ev, now), rendering(p, ev, n), naming(p, ev, n)]
    new = {c for t in parts for c in t.columns} - {"page_id", "siteloom_description"}
    j = base.drop("site", *new)
    for t in parts:
        j = j.join(t, "page_id", "left")
    j = j.join(p.select("page_id", "url", *(["status"] if "status" in p.columns else [])), "page_id")
    if "status" in p.columns:
        j = j.withColumn("http_status", F.col("status").cast("long")).drop("status").unionByName(failed, allowMissingColumns=True)
    return j.select("page_id", "url", "siteloom_description", *[F.col(s).cast(k).alias(s) for s, k in R.SIGNALS.items()])


# ---- a whole site --------------------------------------------------------------------------------------------------

#: Signals that hold of a site only if they hold of all its pages that were measured; others hold if they hold of one.
OF_ALL = "front_loaded html_provided structured_checked decay_checked relative_recent orientation_ok utility render_available".split()
#: Counts of which the greatest of a page counts, not the sum.
GREATEST = "url_depth h1_count http_status html_bytes content_age_days copyright_age links_js_only links_rendered faq_detected faq_complete".split()


def by_site(pages: DataFrame) -> DataFrame:
    """One row per host (``site``) from signals per page: problems of any page, virtues of all, sums of what is counted.

    ``content_age_days`` is that of the page that is oldest, with its source; descriptions that pages share are counted.
    """
    host = U.without_www(U.authority(F.col("url")))
    rows = pages.withColumn("site", host)

    def rolled(name: str, kind: str) -> Column:
        c = F.when(~_no("utility"), F.col(name)) if name == "orientation_ok" else F.col(name)  # a form need not say what it is about
        if kind == "boolean":
            return F.bool_and(c) if name in OF_ALL else F.bool_or(c)
        if kind == "string":
            return F.max_by(c, F.coalesce("content_age_days", F.lit(-1))) if name == "content_age_source" else F.max(c)
        return F.max(c) if name in GREATEST else F.sum(c)

    site = rows.groupBy("site").agg(*[rolled(s, k).cast(k).alias(s) for s, k in R.SIGNALS.items()])
    shared = rows.where("siteloom_description is not null").groupBy("site", "siteloom_description").agg(F.countDistinct(U.page_key(F.col("url"))).alias("n")).where("n > 1")
    shared = shared.groupBy("site").agg(F.count("*").alias("shared"))
    return site.join(shared, "site", "left").withColumn("reused_descriptions", F.coalesce("shared", F.lit(0)).cast("long")).drop("shared")


def crawler_rules(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Crawlers kept from the root and from other paths (site, url), by (site, status, malformed, robots_txt).

    Crawlers that are documented not to heed the file are not kept from anything by it.
    """
    rules = written(B.rules(B.parse(files.select("site", "robots_txt"))), "robots-rules")
    agents = F.array(*[F.lit(token) for token, *_ in B.AGENTS])
    root = files.select("site").distinct().withColumn("url", F.lit("/"))
    asked = root.unionByName(paths.select("site", U.path_and_query(F.col("url")).alias("url")).join(files.select("site").distinct(), "site", "left_semi")).distinct()
    v = B.classified(B.verdicts(asked.withColumn("agent", F.explode(agents)), rules))
    kept = v.where(F.col("disallowed") & ~F.col("honours").eqNullSafe(F.lit(False))).withColumn("at_root", F.col("url") == "/")
    k = kept.groupBy("site").agg(
        F.countDistinct(F.when(F.col("at_root"), F.col("agent"))).alias("root_blocked"),
        F.countDistinct(F.when(F.col("at_root") & (F.col("class") != "training"), F.col("agent"))).alias("root_blocked_retrieval"),
        F.countDistinct(F.when(~F.col("at_root"), F.struct("url", "agent"))).alias("path_blocked"),
        F.countDistinct(F.when(~F.col("at_root") & (F.col("class") != "training"), F.struct("url", "agent"))).alias("path_blocked_retrieval"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    j = files.select("site", F.coalesce("malformed", F.lit(False)).alias("robots_malformed")).join(k, "site", "left")
    open_root = F.coalesce("root_blocked", F.lit(0)) == 0
    path = lambda c: F.when(open_root, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long").alias(c)  # noqa: E731  a closed root says it all
    return j.select("site", "robots_malformed", zero("root_blocked"), zero("root_blocked_retrieval"), path("path_blocked"), path("path_blocked_retrieval"))


def handshakes(certificates: DataFrame, now: Column) -> DataFrame:
    """Of (site, reachable, verify_code, not_after)."""
    c = A.certificate(now)
    return certificates.select("site", c["certificate_valid"].alias("tls_valid"), c["failure_kind"].alias("tls_failure"), c["days_remaining"].alias("tls_days"), c["expiring_soon"].alias("tls_expiring_soon"))


def identities(fetches: DataFrame) -> DataFrame:
    """Of rows as ``access.compare_identities`` takes them, and ``redirects`` if known."""
    f = fetches if "redirects" in fetches.columns else fetches.withColumn("redirects", F.lit(None).cast("int"))
    c = A.compare_identities(fetches).withColumn("site", U.without_www(U.authority(F.col("url"))))
    any_ = lambda x, name: F.bool_or(x).alias(name)
    hops = f.where("identity = 'bot'").groupBy(U.without_www(U.authority(F.col("url"))).alias("site")).agg(F.max("redirects").cast("long").alias("redirects"), F.bool_or("allowed").alias("robots_permit_cited"))
    challenged = f.where("identity = 'bot'").groupBy("url").agg(F.bool_or(_no("cloudflare") | _no("captcha")).alias("met"))  # by whomever else
    c = c.join(challenged, "url", "left").withColumn("bot_challenged", F.col("bot_challenged") | _no("met"))
    got = c.groupBy("site").agg(
        any_("bot_blocked", "bot_blocked"), any_("bot_soft_blocked", "bot_soft_blocked"), any_("bot_challenged", "bot_challenged"), any_("fingerprints_differ", "identities_differ"), any_("rate_limited", "rate_limited"), any_("bot_never_completed", "bot_never_completed"), F.max("bot_status").cast("long").alias("bot_status")
    )
    return got.join(hops, "site", "left")


def sitemaps(probes: DataFrame) -> DataFrame:
    """Of (site, conventional, status, failure, body): the sitemap that a site names, and what stands at the usual address."""
    is_map = F.coalesce(F.regexp_replace("body", "^[\ufeff\\s]+", "").rlike(r"^<(\?xml|[A-Za-z]*:?urlset|[A-Za-z]*:?sitemapindex)"), F.lit(False))
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    why = A.sitemap_failure(F.col("status"), F.when(ok & ~is_map, "invalid_xml_200").otherwise(F.col("failure")))
    found = ok & is_map
    s = probes.groupBy("site").agg(
        F.bool_or(found).alias("sitemap_found"),
        F.min_by(F.when(~found, why), F.when(~found, F.col("conventional").cast("int"))).alias("sitemap_failure"),
        F.bool_or(F.when(F.col("conventional"), ok & ~is_map)).alias("conventional_soft_200"),
        F.bool_or(found & F.col("body").rlike("^[\ufeff\\s]")).alias("sitemap_leading_junk"),
    )
    return s.withColumn("conventional_soft_200", F.col("conventional_soft_200") & F.col("sitemap_found"))


def searches(results: DataFrame, brands: DataFrame) -> DataFrame:
    """Of results (site, rank, url, title, snippet) of each brand (site, brand, domain): rank, ambiguity, entries of registers."""
    a = C.ambiguity(results, brands).select("site", F.col("risk").alias("ambiguity_risk"), F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("domain_in_top"))
    n = results.groupBy("site").agg(F.count("*").alias("search_results"), F.lit(True).alias("domain_provided"))
    entry = lambda on, name: C.entity_match(results, brands, on).select("site", F.lit(True).alias(name))
    j = n.join(a, "site", "left").join(entry("wikipedia.org", "wikipedia"), "site", "left").join(entry("wikidata.org", "wikidata"), "site", "left")
    return j.withColumn("wikipedia", _no("wikipedia")).withColumn("wikidata", _no("wikidata"))


def key_pages(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """Of the addresses (site, url) that matter, those that no page of the site links, as (site, page url, url) says."""
    k = keys.select("site", "url", U.normalized(F.col("url")).alias("key")).distinct()
    lost = k.join(linked.select("site", U.normalized(F.col("url")).alias("key")).distinct(), ["site", "key"], "left_anti")
    tail = U.long_tail(F.col("url"))
    n = lost.groupBy("site").agg(F.count_if(~tail).alias("unlinked_key_pages"), F.count_if(tail).alias("unlinked_long_tail"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return k.select("site").distinct().join(n, "site", "left").select("site", zero("unlinked_key_pages"), zero("unlinked_long_tail"))


def documents(pdfs: DataFrame) -> DataFrame:
    """PDFs (site, data, truncated) without text that can be selected."""
    return pdfs.withColumn("has_text", C.pdf_text_layer("data", "truncated")["has_text"]).groupBy("site").agg(F.count_if(F.col("has_text").eqNullSafe(F.lit(False))).alias("pdf_no_text"))


def site_signals(pages: DataFrame, now: Column, robots: DataFrame | None = None, certificates: DataFrame | None = None, fetches: DataFrame | None = None, probes: DataFrame | None = None, results: DataFrame | None = None, brands: DataFrame | None = None, cited: DataFrame | None = None, keys: DataFrame | None = None, pdfs: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """One wide row per host for ``rules.findings``, from pages and whatever was recorded of their hosts.

    ``cited`` are rows as ``content.citations`` takes them. ``more`` (site, signal, value) are signals from elsewhere, such as verdicts; they win over those measured here. A host
    of which nothing but recordings are known gets a row too.
    """
    out = by_site(written(all_page_signals(pages, now), "page-signals"))
    own = pages.select(U.without_www(U.authority(F.col("url"))).alias("site"), "url")
    parts = []
    if robots is not None:
        parts.append(crawler_rules(robots, own))
    if certificates is not None:
        parts.append(handshakes(certificates, now))
    if fetches is not None:
        parts.append(identities(fetches))
    if probes is not None:
        parts.append(sitemaps(probes))
    if results is not None and brands is not None:
        parts.append(searches(results, brands))
    if cited is not None:
        parts.append(C.citations(cited).groupBy("site").agg(F.bool_or("contradicts").alias("citation_contradiction")))
    if keys is not None:
        links = page_links(pages.withColumn("page_id", F.col("page_id").cast("long")), H.events(pages))
        parts.append(key_pages(keys, links.join(pages.select(F.col("page_id").cast("long").alias("page_id"), U.without_www(U.authority(F.col("url"))).alias("site")), "page_id")))
    if pdfs is not None:
        parts.append(documents(pdfs))
    if more is not None:
        parts.append(R.wide(more))
    for t in parts:
        both = [c for c in t.columns if c != "site"]
        out = out.join(t.select("site", *[F.col(c).alias(f"new_{c}") for c in both]), "site", "full_outer")
        out = out.withColumns({c: F.coalesce(f"new_{c}", c) for c in both}).drop(*[f"new_{c}" for c in both])
    return out.select("site", *[F.col(s).cast(k).alias(s) for s, k in R.SIGNALS.items()])


_BOUNDARY = "(?i)</?(?:" + "|".join(H.BOUNDARIES) + r")\b[^>]*>"
#: The words of each block of text outside of frames and headings: an end of a block is a character of its own.
_BLOCKS = f"""cut as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(nav|header|footer|aside)\\b.*?</(nav|header|footer|aside)>', chr(2), 'g'), '(?is)<h[1-6]\\b.*?</h[1-6]>', chr(2), 'g'), '{_BOUNDARY}', chr(2), 'g') as html from c),
    blocks as (select page_id, list_filter(list_transform(string_split(replace({shown_sql()}, chr(1), ''), chr(2)), lambda x: len(regexp_extract_all(x, '{WORD}'))), lambda n: n > 0) as n from cut),
    far as (select page_id, list_sum(n) as total, list_position(list_transform(n, lambda x: x >= 12), true) as first, n from blocks),
    buried as (select page_id, case when total >= 80 and first > 0 then coalesce(list_sum(n[:first - 1]), 0) / total > 0.3 end as buried from far)"""
#: What has to be so of a host's pages ``h`` for a rule: one page that raises it, unless it says otherwise.
_OF_HOST = {slug: f"bool_or({condition})" for slug, (_, condition) in RAISED.items()} | {
    "jsonld_missing": "bool_and(not contains(html, 'application/ld+json'))",
    "h1_multiple": "min(h1) > 0 and max(h1) > 1",
    "heading_skips": "min(h1) > 0 and max(h1) <= 1 and sum(skipped) > 0",
    "trust_pages_missing": f"not bool_or({TRUST}) and not bool_and(utility)",
    "sameas_missing": "bool_and(not contains(html, 'sameAs'))",
    "landing_no_orientation": "coalesce(bool_or(not utility and not oriented), false)",
    "content_buried": "coalesce(bool_or(buried), false)",
}
_TAIL = "trim(regexp_extract(title, '^.*\\s[|–—-]\\s(.*)$', 1))"
_SITE_SQL = f"""with {PAGE_TABLES}, {_BLOCKS},
    h as (select c.*, buried, (({_TAIL}) <> '' and len(string_split_regex({_TAIL}, '\\s+')) between 1 and 5)::int + regexp_matches(html, '(?i)<meta[^>]*name="description"')::int + regexp_matches(html, '(?is)<h1[^>]*>\\s*[^<\\s]')::int >= 2 as oriented from c join buried using (page_id)),
    k as (select host as site, {", ".join(f"{condition} as {slug}" for slug, condition in _OF_HOST.items())} from h group by host)
    select site, slug from (unpivot k on columns(* exclude site) into name slug value raised) where raised"""


@query("site_findings", _SITE_SQL)
def site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit of every host of ``pages``: all signals that pages show, all rules."""
    return R.findings(site_signals(pages(spark, sf_dir), F.lit("2025-01-01").cast("timestamp"))).select("site", "slug")
