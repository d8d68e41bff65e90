"""From signals to findings: a table of rules over one wide row per site, and the report.

A rule is a condition over signal columns. What was not measured is null and satisfies no condition, so a condition
says ``is false`` where only a measured false counts. All rules are tried in one pass over the row; there is no union
of ninety scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import reports as P

#: Signal columns and their types.
SIGNALS = {
    name: kind
    for kind, names in {
        "boolean": """robots_malformed robots_permit_cited tls_valid tls_expiring_soon bot_blocked bot_soft_blocked bot_challenged identities_differ rate_limited bot_never_completed
            noindex nofollow canonical_duplicate conventional_soft_200 sitemap_leading_junk sitemap_found sitemap_skipped render_available waf_challenge rendering_barrier schema_barrier
            skeleton client_redirect spa_routing structured_checked structural_only is_root has_identity h1_missing h1_subheadings render_ruled_out_js question_checked front_loaded
            facts_inconsistent facts_verdict faq_checked nap_checked citation_contradiction domain_provided domain_in_top wikipedia wikidata html_provided sameas_found sameas_wiki
            sameas_registry ambiguous_verdict dates_checked decay_checked decayed relative_recent below_reference no_viewport_no_media brand_missing_in_title orientation_ok
            orientation_verdict dead_end dead_end_verdict utility privacy_page terms_page default_title""",
        "string": "tls_failure sitemap_failure render_reason ambiguity_risk content_age_source date_issue",
        "bigint": """root_blocked root_blocked_retrieval path_blocked path_blocked_retrieval tls_days bot_status redirects url_depth links_js_only links_rendered entities json_errors json_blocks
            unclassified_types describable description_gaps faq_low_overlap schema_incomplete faq_detected faq_complete breadcrumbs_empty placeholder_authors nap_mismatches h1_count
            level_skips unanswered images_no_alt images_generic_alt controls_unlabeled svg_unlabeled media_no_captions iframes_no_title canvas_no_fallback icons_unlabeled pdf_no_text
            search_results copyright_age content_age_days http_status unlinked_key_pages unlinked_long_tail reused_descriptions resource_errors html_bytes placeholder_hits""",
    }.items()
    for name in names.split()
}

_BLOCK = "(bot_blocked is true or bot_soft_blocked is true or (bot_challenged is true and identities_differ is true))"
_MAP = "sitemap_found is false and sitemap_skipped is not true and "
_H1 = "h1_missing is true and (rendering_barrier is true or (h1_subheadings is true and render_ruled_out_js is not true))"
_ORIENT = "coalesce(orientation_verdict, orientation_ok) is false and utility is not true"

#: (slug, category, severity, confidence, condition), in the order in which findings of one severity are listed. Severity
#: and confidence may be expressions. Conditions, severities and confidences.
RULES = [
    ("robots_malformed", "crawl_access", "'critical'", "1.0", "robots_malformed is true"),
    ("robots_root_block_retrieval", "crawl_access", "'critical'", "1.0", "root_blocked > 0 and root_blocked_retrieval > 0"),
    ("robots_root_block_training_only", "crawl_access", "'medium'", "1.0", "root_blocked > 0 and coalesce(root_blocked_retrieval, 0) = 0"),
    ("robots_path_block_retrieval", "crawl_access", "'high'", "1.0", "path_blocked > 0 and path_blocked_retrieval > 0"),
    ("robots_path_block_training_only", "crawl_access", "'low'", "1.0", "path_blocked > 0 and coalesce(path_blocked_retrieval, 0) = 0"),
    ("tls_rejected", "crawl_access", "'critical'", "1.0", "tls_valid is false and tls_failure in ('expired', 'not_yet_valid', 'hostname_mismatch', 'self_signed', 'revoked')"),
    ("tls_untrusted_chain", "crawl_access", "'high'", "0.6", "tls_valid is false and tls_failure = 'untrusted_chain'"),
    ("tls_failed_other", "crawl_access", "'medium'", "0.5", "tls_valid is false and coalesce(tls_failure, 'other') not in ('expired', 'not_yet_valid', 'hostname_mismatch', 'self_signed', 'revoked', 'untrusted_chain')"),
    ("tls_expiring", "crawl_access", "'low'", "1.0", "tls_valid is true and tls_expiring_soon is true"),
    ("bot_block_policy_mismatch", "crawl_access", "'critical'", "1.0", f"{_BLOCK} and robots_permit_cited is true"),
    ("bot_block_generic", "crawl_access", "'critical'", "1.0", f"{_BLOCK} and robots_permit_cited is not true"),
    ("captcha_shared", "crawl_access", "'low'", "1.0", f"not {_BLOCK} and bot_challenged is true and identities_differ is not true"),
    ("rate_limited", "crawl_access", "'low'", "1.0", f"not {_BLOCK} and bot_challenged is not true and rate_limited is true"),
    ("bot_fetch_incomplete", "crawl_access", "'medium'", "0.6", f"not {_BLOCK} and bot_challenged is not true and rate_limited is not true and bot_never_completed is true"),
    ("redirect_never_resolves", "crawl_access", "'high'", "1.0", "bot_status in (301, 302, 303, 307, 308)"),
    ("redirect_chain_long", "crawl_access", "'low'", "1.0", "bot_status between 200 and 299 and redirects >= 3"),
    ("noindex", "crawl_access", "'critical'", "1.0", "noindex is true"),
    ("nofollow", "crawl_access", "'medium'", "1.0", "nofollow is true and noindex is not true"),
    ("canonical_duplicate", "crawl_access", "'medium'", "1.0", "canonical_duplicate is true"),
    ("sitemap_conventional_soft200", "crawl_access", "'low'", "1.0", "conventional_soft_200 is true"),
    ("sitemap_leading_junk", "crawl_access", "'low'", "1.0", "sitemap_leading_junk is true"),
    ("sitemap_blocked", "crawl_access", "'high'", "1.0", _MAP + "sitemap_failure = 'blocked'"),
    ("sitemap_rate_limited", "crawl_access", "'low'", "0.6", _MAP + "sitemap_failure = 'rate_limited'"),
    ("sitemap_server_error", "crawl_access", "'high'", "1.0", _MAP + "sitemap_failure = 'server_error'"),
    ("sitemap_unreachable", "crawl_access", "'medium'", "0.6", _MAP + "sitemap_failure = 'network_unreachable'"),
    ("sitemap_invalid_xml", "crawl_access", "'high'", "0.6", _MAP + "sitemap_failure = 'invalid_xml_200'"),
    ("sitemap_missing", "crawl_access", "'high'", "1.0", _MAP + "coalesce(sitemap_failure, 'other') in ('not_found', 'other')"),
    ("url_too_deep", "crawl_access", "'low'", "1.0", "url_depth > 3"),
    ("render_no_browser", "crawl_render", "'low'", "1.0", "render_available is false and render_reason in ('no_browser_installed', 'root_no_sandbox')"),
    ("render_failed_page", "crawl_render", "'low'", "0.8", "render_available is false and render_reason in ('timed_out', 'render_failed', 'launch_failed')"),
    ("waf_interstitial", "crawl_render", "'critical'", "1.0", "waf_challenge is true"),
    ("csr_barrier_confirmed", "crawl_render", "'high'", "1.0", "rendering_barrier is true and schema_barrier is true"),
    ("csr_barrier", "crawl_render", "'high'", "1.0", "rendering_barrier is true and schema_barrier is not true"),
    ("skeleton_screen", "crawl_render", "'medium'", "1.0", "skeleton is true and rendering_barrier is not true"),
    ("schema_js_only", "crawl_render", "'high'", "1.0", "schema_barrier is true and rendering_barrier is not true"),
    ("client_redirect", "crawl_render", "'medium'", "1.0", "client_redirect is true"),
    ("spa_routing", "crawl_render", "'low'", "1.0", "spa_routing is true and rendering_barrier is not true"),
    ("links_js_only", "crawl_render", "'medium'", "1.0", "links_js_only >= 5 or (links_js_only >= 2 and links_rendered > 0 and 4 * links_js_only >= links_rendered)"),
    ("jsonld_unparseable", "readability", "'high'", "1.0", "structured_checked is true and entities = 0 and json_errors > 0 and json_blocks > 0"),
    ("jsonld_missing", "readability", "'high'", "1.0", "structured_checked is true and entities = 0 and not (coalesce(json_errors, 0) > 0 and coalesce(json_blocks, 0) > 0)"),
    ("jsonld_partial_errors", "readability", "'medium'", "1.0", "entities > 0 and json_errors > 0"),
    ("schema_structural_only", "readability", "'medium'", "1.0", "structural_only is true"),
    ("schema_no_identity_home", "readability", "'medium'", "0.9", "is_root is true and entities > 0 and has_identity is false and unclassified_types = 0 and structural_only is not true"),
    ("schema_description_gap", "readability", "'low'", "1.0", "describable > 0 and description_gaps > 0"),
    ("faq_answer_not_visible", "readability", "'medium'", "0.6", "faq_checked is true and faq_low_overlap > 0"),
    ("schema_incomplete", "readability", "'medium'", "1.0", "schema_incomplete > 0"),
    ("faq_incomplete", "readability", "'medium'", "1.0", "faq_detected > faq_complete"),
    ("breadcrumb_empty", "readability", "'low'", "1.0", "breadcrumbs_empty > 0"),
    ("author_placeholder", "readability", "'low'", "0.6", "placeholder_authors > 0"),
    ("nap_mismatch", "readability", "'medium'", "0.6", "nap_checked is true and nap_mismatches > 0"),
    ("h1_client_injected", "readability", "'medium'", "case when rendering_barrier is true then 1.0 else 0.6 end", _H1),
    ("h1_missing", "readability", "'medium'", "1.0", f"h1_missing is true and not ({_H1})"),
    ("h1_multiple", "readability", "'low'", "1.0", "h1_missing is not true and h1_count > 1"),
    ("heading_skips", "readability", "'low'", "1.0", "h1_missing is not true and coalesce(h1_count, 0) <= 1 and level_skips > 0"),
    ("question_unanswered", "readability", "'medium'", "1.0", "unanswered > 0"),
    ("content_buried", "readability", "'low'", "0.5", "question_checked is true and front_loaded is false"),
    ("facts_not_visible", "readability", "case when facts_verdict is true then 'high' else 'medium' end", "case when facts_verdict is true then 1.0 else 0.5 end", "coalesce(facts_verdict, facts_inconsistent) is true"),
    ("img_alt_missing", "readability", "case when images_no_alt > 3 then 'high' else 'medium' end", "1.0", "images_no_alt > 0"),
    ("img_alt_generic", "readability", "'low'", "1.0", "images_generic_alt > 0"),
    ("control_unlabeled", "readability", "'high'", "1.0", "controls_unlabeled > 0"),
    ("svg_unlabeled", "readability", "case when svg_unlabeled > 5 then 'high' else 'medium' end", "1.0", "svg_unlabeled > 0"),
    ("media_no_captions", "readability", "'medium'", "1.0", "media_no_captions > 0"),
    ("iframe_no_title", "readability", "'low'", "1.0", "iframes_no_title > 0"),
    ("canvas_no_fallback", "readability", "'low'", "1.0", "canvas_no_fallback > 0"),
    ("icon_unlabeled", "readability", "'low'", "1.0", "icons_unlabeled > 0"),
    ("pdf_no_text", "readability", "'medium'", "1.0", "pdf_no_text > 0"),
    ("citation_contradiction", "freshness_corroboration", "'high'", "1.0", "citation_contradiction is true"),
    ("domain_not_in_results", "freshness_corroboration", "'high'", "1.0", "domain_provided is true and search_results > 0 and domain_in_top is false"),
    ("no_encyclopedia_entry", "freshness_corroboration", "'low'", "1.0", "wikipedia is false and wikidata is false"),
    ("sameas_missing", "freshness_corroboration", "'medium'", "1.0", "html_provided is true and sameas_found is false"),
    ("sameas_entry_unlinked", "freshness_corroboration", "'low'", "0.8", "sameas_found is true and sameas_wiki is not true and (wikipedia is true or wikidata is true)"),
    ("sameas_no_authority", "freshness_corroboration", "'low'", "1.0", "sameas_found is true and sameas_wiki is not true and wikipedia is not true and wikidata is not true and sameas_registry is not true"),
    ("brand_ambiguous", "freshness_corroboration", "'medium'", "case when ambiguous_verdict is true then 1.0 else 0.6 end", "coalesce(ambiguous_verdict, ambiguity_risk = 'elevated') is true"),
    ("copyright_outdated", "freshness_corroboration", "'low'", "1.0", "dates_checked is true and copyright_age >= 2"),
    ("content_stale", "freshness_corroboration", "'medium'", "case when content_age_source = 'latest_visible_date' then 0.6 else 1.0 end", "dates_checked is true and content_age_days > 540"),
    ("date_metadata_error", "freshness_corroboration", "'low'", "1.0", "dates_checked is true and date_issue is not null"),
    ("listing_decayed", "freshness_corroboration", "case when content_age_source = 'low' then 'low' else 'medium' end", "case when content_age_source = 'low' then 0.35 else 1.0 end", "decay_checked is true and decayed is true and relative_recent is not true"),
    ("page_unreachable", "freshness_corroboration", "'medium'", "1.0", "dates_checked is false or decay_checked is false"),
    ("nav_unreachable_longtail", "engagement", "'low'", "0.4", "unlinked_long_tail > 0"),
    ("nav_unreachable", "engagement", "'medium'", "1.0", "unlinked_key_pages > 0"),
    ("thin_content", "engagement", "'medium'", "1.0", "below_reference is true"),
    ("viewport_missing", "engagement", "'high'", "1.0", "no_viewport_no_media is true"),
    ("brand_not_in_title", "engagement", "'medium'", "1.0", "brand_missing_in_title is true"),
    ("meta_description_reused", "engagement", "'medium'", "1.0", "reused_descriptions > 0"),
    ("resource_errors", "engagement", "'low'", "1.0", "resource_errors > 0"),
    ("html_too_large", "engagement", "'medium'", "1.0", "html_bytes > 2000000"),
    ("landing_no_orientation", "engagement", "'high'", "1.0", _ORIENT),
    ("landing_dead_end", "engagement", "'medium'", "1.0", "coalesce(dead_end_verdict, dead_end) is true and utility is not true"),
    ("trust_pages_missing", "engagement", "'low'", "0.5", "privacy_page is false and terms_page is false and utility is not true"),
    ("placeholder_text", "engagement", "'medium'", "1.0", "placeholder_hits > 0"),
    ("title_default", "engagement", "'low'", "1.0", "default_title is true"),
]

#: A blocked fetch leaves these categories, and what dates a page shows, unmeasured.
BLOCKED_CATEGORIES = ("crawl_render", "readability", "engagement")
ON_PAGE_FRESHNESS = ("sameas_missing", "sameas_entry_unlinked", "sameas_no_authority", "copyright_outdated", "content_stale", "date_metadata_error", "listing_decayed", "page_unreachable")
RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 2 end"
SEVERITIES = ("critical", "high", "medium", "low")

#: What to do about findings: a recommendation and the findings that make it moot.
RECOMMENDATIONS = [
    ("allow_ai_crawlers", "root_blocked = 0 or root_blocked is null", ("robots_root_block_retrieval", "robots_path_block_retrieval", "robots_malformed")),
    ("server_side_rendering", "spa_routing is true", ("csr_barrier", "csr_barrier_confirmed")),
    ("authoritative_sameas", "sameas_registry is not true and html_provided is true", ("sameas_missing", "sameas_entry_unlinked", "sameas_no_authority")),
    ("link_key_pages", "unlinked_long_tail > 0", ("nav_unreachable",)),
    ("add_viewport", "no_viewport_no_media is null", ("viewport_missing",)),
]


def wide(signals: DataFrame) -> DataFrame:
    """One row per site from (site, signal, value): the columns of SIGNALS, null where there is no row."""
    return signals.groupBy("site").agg(*[F.expr(f"try_cast(max(case when signal = '{n}' then value end) as {k})").alias(n) for n, k in SIGNALS.items()])


def findings(sites: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(site, rule_no, slug, category, severity, confidence): one row for each rule that a site's signals satisfy.

    ``more`` are findings from elsewhere (site, slug, category, severity, confidence), in whatever state: an unknown
    severity is medium, a confidence is kept within 0 and 1. Where a fetch was blocked, findings of what could not be
    seen are left out.
    """
    tries = ", ".join(f"case when {cond} then named_struct('rule_no', {i}, 'slug', '{slug}', 'category', '{cat}', 'severity', {sev}, 'confidence', cast({conf} as double)) end" for i, (slug, cat, sev, conf, cond) in enumerate(RULES))
    found = sites.select("site", F.explode(F.array_compact(F.expr(f"array({tries})"))).alias("f")).select("site", "f.*")
    if more is not None:
        known = F.when(F.lower("severity").isin(*SEVERITIES), F.lower("severity")).otherwise("medium")
        found = found.unionByName(more.select("site", F.lit(len(RULES)).alias("rule_no"), "slug", "category", known.alias("severity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))).alias("confidence")))
    blocked = found.where(F.col("slug").isin("bot_block_policy_mismatch", "bot_block_generic")).select("site").distinct()
    unseen = found.where(F.col("category").isin(*BLOCKED_CATEGORIES) | F.col("slug").isin(*ON_PAGE_FRESHNESS))
    kept = unseen.join(blocked, "site", "left_anti")
    return kept.unionByName(found.where(~F.col("category").isin(*BLOCKED_CATEGORIES) & ~F.col("slug").isin(*ON_PAGE_FRESHNESS)))


def numbered(found: DataFrame) -> DataFrame:
    """Adds id: F-001 and so on within a site, the most severe first, rules in their order, then by name."""
    w = Window.partitionBy("site").orderBy(F.expr(RANK), "rule_no", "slug")
    n = F.row_number().over(w)
    return found.withColumn("id", F.concat(F.lit("F-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("site").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def recommendations(sites: DataFrame, found: DataFrame) -> DataFrame:
    """(site, recommendation) of those whose condition holds and which no finding covers already."""
    tries = F.array(*[F.when(F.expr(f"({cond}) is true"), F.struct(F.lit(name).alias("recommendation"), F.array(*[F.lit(x) for x in moot]).alias("moot"))) for name, cond, moot in RECOMMENDATIONS])
    wanted = sites.select("site", F.explode(F.array_compact(tries)).alias("r")).select("site", "r.recommendation", F.explode("r.moot").alias("slug"))
    covered = wanted.join(found.select("site", "slug").distinct(), ["site", "slug"]).select("site", "recommendation").distinct()
    return wanted.select("site", "recommendation").distinct().join(covered, ["site", "recommendation"], "left_anti")


def reports(sites: DataFrame, found: DataFrame) -> DataFrame:
    """(site, report): one JSON document per site, sites without findings included."""
    f = numbered(found)
    listed = f.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("id", "category", "slug", "severity", "confidence"))).alias("findings"))
    rec = recommendations(sites, found).groupBy("site").agg(F.array_sort(F.collect_list("recommendation")).alias("recommendations"))
    j = sites.select("site").join(severity_counts(found), "site", "left").join(listed, "site", "left").join(rec, "site", "left")
    summary = F.struct(F.coalesce("total", F.lit(0)).alias("total_findings"), *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES])
    return j.select("site", F.to_json(F.struct(summary.alias("summary"), F.coalesce("findings", F.expr("cast(array() as array<struct<id:string,category:string,slug:string,severity:string,confidence:double>>)")).alias("findings"), F.coalesce("recommendations", F.array().cast("array<string>")).alias("proactive_recommendations"))).alias("report"))


def write_reports(spark: SparkSession, sites: DataFrame, found: DataFrame, path: str) -> str | None:
    """Write the reports as JSON lines, whole or not at all; if that fails, an empty report of each site that says why. The failure is returned, never raised."""
    try:
        P.write(reports(sites, found), path, mode="overwrite")
    except Exception as e:  # the caller still has the findings
        why = str(e).splitlines()[0]
        try:
            P.write(sites.select("site", F.lit(P.fallback(why)).alias("report")), path, mode="overwrite")
        except Exception as again:  # the place itself cannot be written to
            return f"{why}; {str(again).splitlines()[0]}"
        return why
    return None
