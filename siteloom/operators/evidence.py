"""Listing dates, page intent from all its sources, links to identities, what a page calls itself, and what was skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from . import content as C
from . import html_events as H
from . import structured as S

#: Lines that carry a year without dating a post, and times that say recent. Fixed values.
BOILERPLATE = r"(?i)copyright|©|\bcopr\b|&copy;|founded\s+in|established\s+in|all\s+rights\s+reserved|privacy\s+policy|terms\s+of\s+service"
RECENT = r"(?i)\b(just now|today|yesterday|\d+\s*(second|minute|hour|day|week)s?\s+ago|an?\s+(hour|day|week)\s+ago)\b"

#: What a type in structured data, or of Open Graph, says about a page. Fixed values.
TYPE_INTENT = {
    "product": "product offer aggregateoffer productgroup vehicle book",
    "article": "article blogposting newsarticle techarticle report scholarlyarticle faqpage howto recipe qapage",
    "service": "service financialproduct loanorcredit",
    "app": "webapplication softwareapplication mobileapplication",
    "utility": "contactpage checkoutpage searchresultspage",
    "homepage": "aboutpage organization localbusiness website",
    "category": "collectionpage itemlist",
    "media": "videoobject imageobject audioobject",
}
OG_INTENT = {"article": "article blog book", "product": "product product.group product.item", "homepage": "website", "media": "video.other music.song video.movie"}
SITE_TYPES = ["website", "organization", "localbusiness"]


def listing_dates(ev: DataFrame) -> DataFrame:
    """(page_id, raw, relative, structured): what a listing dates its posts with.

    A time element counts by its attribute, a relative text, or a text with a year; other texts by a year, unless they
    read like boilerplate; digits of a telephone number are no year. A footer outside of articles is the page's own and dates nothing.
    """
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    depth = lambda tag: F.sum(F.when((F.col("tag") == tag) & (F.col("kind") == "start"), 1).when((F.col("tag") == tag) & (F.col("kind") == "end"), -1).otherwise(0)).over(w)
    rows = H.inside(ev.where("not unshown"), "time", "at").withColumn("footer", depth("footer")).withColumn("article", depth("article"))
    rows = rows.where("not (footer > 0 and article <= 0)")
    timed = rows.where("at is not null").groupBy("page_id", "at").agg(
        F.max(F.when(F.col("kind") == "start", F.trim(F.coalesce(F.col("attrs")["datetime"], F.lit(""))))).alias("stamp"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", F.trim("text").alias("t"))))), lambda x: x["t"]), " ")).alias("body"),
    )
    has_year = lambda text: C.without_phones(F.col(text)).rlike(rf"\b{C.YEAR}\b")
    dated = F.col("stamp").rlike(r"\d{4}-\d{2}-\d{2}")
    relative = ~dated & (F.col("body").rlike(RECENT) | F.col("stamp").rlike(RECENT))
    timed = timed.where(dated | relative | has_year("body")).select("page_id", F.when(dated, F.col("stamp")).when(F.col("body") != "", F.col("body")).otherwise(F.col("stamp")).alias("raw"), relative.alias("relative"), F.lit(True).alias("structured"))
    loose = rows.where("at is null and kind = 'text'").select("page_id", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("raw")).where(has_year("raw") & ~F.col("raw").rlike(BOILERPLATE)).distinct()
    plain = loose.join(timed.where("not relative").select("page_id").distinct(), "page_id", "left_anti").select("page_id", "raw", F.lit(False).alias("relative"), F.lit(False).alias("structured"))
    return timed.distinct().unionByName(plain)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for intent, names in table.items():
        out = F.when(key.isin(names.split()), intent).otherwise(out)
    return out


def page_intent(pages: DataFrame) -> DataFrame:
    """(page_id, intent, basis) from (page_id, url, types, og_type, layout, hint, form_page).

    Structured data speaks first, then Open Graph, the path, the layout and the caller. A type of a whole site says
    homepage only on a root. A page that is mostly a form is a utility unless something says what else it is.
    """
    from ..plans.page_queries import path_intent

    root = U.short_root(F.col("url"))
    types = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(t))
    said = F.transform(types, lambda t: F.when(~(t.isin(SITE_TYPES) & ~root), _lookup(t, TYPE_INTENT)))
    schema = F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0))
    og_key = F.lower(F.trim("og_type"))
    og_full = _lookup(og_key, OG_INTENT)
    og = F.coalesce(og_full, _lookup(F.get(F.split(og_key, ":"), F.lit(0)), OG_INTENT))
    og = F.when(~((og == "homepage") & ~root), og)
    hint = F.when(F.col("hint").isin("product", "service", "article", "homepage", "category", "content", "utility", "app", "media"), F.col("hint"))
    basis = F.when(F.coalesce(schema, og).isNotNull(), "schema_or_og").otherwise("url_path_or_layout_or_default")
    intent = F.coalesce(schema, og, path_intent(F.col("url")), F.col("layout"), hint, F.lit("content"))
    return pages.select("page_id", F.when(F.col("form_page") & intent.isin("homepage", "category", "content"), "utility").otherwise(intent).alias("intent"), basis.alias("basis"))


#: Types of nodes whose links say nothing about an entity. Fixed values.
NO_ENTITY = ["breadcrumblist", "itemlist", "webpage", "webpagelement", "sitenavigationelement", "collectionpage"]


def same_as(nodes: DataFrame) -> DataFrame:
    """(page_id, n, url): links of any entity to itself elsewhere, the first of each address."""
    rows = nodes.where("n >= 0").where(~F.exists("types", lambda t: F.lower(t).isin(NO_ENTITY)))
    links = rows.select("page_id", "block", "n", F.posexplode(S.listed("sameAs")).alias("pos", "raw"))
    links = links.withColumn("url", F.trim(F.when(F.startswith("raw", F.lit("{")), F.get_json_object("raw", "$['@id']")).otherwise(F.col("raw")))).where("url <> ''")
    norm = F.concat(U.scheme(F.col("url")), F.lit("://"), U.authority(F.col("url")), F.regexp_replace(U.path(F.col("url")), "/+$", ""))
    first = Window.partitionBy("page_id", norm).orderBy("block", "n", "pos")
    kept = links.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("block", "n", "pos"))).select("page_id", F.col("place").alias("n"), "url")


def brand_candidates(facts: DataFrame) -> DataFrame:
    """(page_id, brand, brand_source, description, description_source) from what a page says in several places, the best first."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))
    tail = F.trim(F.regexp_extract("title", r"^.*\s[|–—\-]\s(.*)$", 1))
    has_tail = (tail != "") & words(tail).between(1, 5)
    brand = [("jsonld_organization", said(F.col("org_name")), F.col("org_name")), ("og:site_name", said(F.col("og_site")), F.col("og_site")), ("title_suffix", has_tail, tail), ("logo_alt", words(F.col("logo_alt")).between(1, 6), F.col("logo_alt"))]
    desc = [("meta_description", words(F.col("meta")) >= 4, F.col("meta")), ("jsonld_description", words(F.col("org_description")) >= 4, F.col("org_description")), ("subhead_paragraph", words(F.col("subhead")) >= 6, F.col("subhead")), ("og:description", words(F.col("og_description")) >= 4, F.col("og_description"))]

    def pick(options, i: int) -> Column:
        out = None
        for name, on, value in options:
            v = F.lit(name) if i == 0 else value
            out = F.when(on, v) if out is None else out.when(on, v)
        return out

    return facts.select("page_id", pick(brand, 1).alias("brand"), pick(brand, 0).alias("brand_source"), pick(desc, 1).alias("description"), pick(desc, 0).alias("description_source"))


def refused(fetches: DataFrame, decisions: DataFrame) -> DataFrame:
    """(url, reason, rule) of everything the crawler rules kept from being looked at: a detailed row stands for a bare one."""
    detailed = decisions.where("not allowed").select("url", F.col("source").alias("reason"), "rule").distinct()
    bare = fetches.where("not allowed").select("url").distinct().join(detailed, "url", "left_anti").select("url", F.lit("disallowed").alias("reason"), F.lit(None).cast("string").alias("rule"))
    return detailed.unionByName(bare)


def audited_pages(*tables: DataFrame) -> DataFrame:
    """(site, pages): distinct addresses that any of the tables (site, url) has, one at least."""
    rows = tables[0].select("site", "url")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("site", "url"))
    return rows.groupBy("site").agg(F.greatest(F.lit(1).cast("long"), F.countDistinct("url")).alias("pages"))


def measured_resources(resources: DataFrame, most: int = 15) -> DataFrame:
    """(page_id, found, measured, bytes, errors) from (page_id, pos, url, length, error): the first few are measured; a length that is unknown counts as an error."""
    on = F.col("pos") <= most
    return resources.groupBy("page_id").agg(F.count("*").alias("found"), F.count_if(on).alias("measured"), F.coalesce(F.sum(F.when(on, F.col("length"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(on & F.col("length").isNull()).alias("errors"))


def snippet(tag: Column, attrs: Column, most: int = 120) -> Column:
    """An element's start as evidence: long values and long starts are cut."""
    parts = F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.when(F.length(e["value"]) > 60, F.concat(F.substring(e["value"], 1, 60), F.lit("…"))).otherwise(e["value"]), F.lit('"')))
    full = F.concat(F.lit("<"), tag, F.array_join(parts, ""), F.lit(">"))
    return F.when(F.length(full) > most, F.concat(F.substring(full, 1, most), F.lit("…"))).otherwise(full)
