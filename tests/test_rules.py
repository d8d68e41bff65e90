"""Rules and reports: each probe has a case that fires and one that does not."""

import json

import pytest
from pyspark.sql import functions as F

from siteloom.plans import rules as R

#: slug: (signals that fire it, signals that do not)
PROBES = {
    "robots_path_block_training_only": ("path_blocked=1 path_blocked_retrieval=0", "path_blocked=1 path_blocked_retrieval=1"),
    "skeleton_screen": ("skeleton=true", "skeleton=true rendering_barrier=true"),
    "robots_root_block_retrieval": ("root_blocked=1 root_blocked_retrieval=1", "root_blocked=1 root_blocked_retrieval=0"),
    "robots_root_block_training_only": ("root_blocked=2 root_blocked_retrieval=0", "root_blocked=0"),
    "tls_rejected": ("tls_valid=false tls_failure=expired", "tls_valid=false tls_failure=untrusted_chain"),
    "tls_failed_other": ("tls_valid=false", "tls_valid=true"),
    "bot_block_policy_mismatch": ("bot_soft_blocked=true robots_permit_cited=true", "bot_soft_blocked=true"),
    "bot_block_generic": ("bot_challenged=true identities_differ=true", "bot_challenged=true identities_differ=false"),
    "captcha_shared": ("bot_challenged=true identities_differ=false", "bot_challenged=true identities_differ=true"),
    "rate_limited": ("rate_limited=true", "rate_limited=true bot_blocked=true"),
    "nofollow": ("nofollow=true", "nofollow=true noindex=true"),
    "sitemap_missing": ("sitemap_found=false", "sitemap_found=false sitemap_skipped=true"),
    "sitemap_blocked": ("sitemap_found=false sitemap_failure=blocked", "sitemap_found=false sitemap_failure=not_found"),
    "csr_barrier": ("rendering_barrier=true", "rendering_barrier=true schema_barrier=true"),
    "links_js_only": ("links_js_only=2 links_rendered=8", "links_js_only=2 links_rendered=9"),
    "jsonld_missing": ("structured_checked=true entities=0", "entities=0"),
    "jsonld_unparseable": ("structured_checked=true entities=0 json_errors=1 json_blocks=1", "structured_checked=true entities=1 json_errors=1 json_blocks=1"),
    "schema_no_identity_home": ("is_root=true entities=2 has_identity=false unclassified_types=0", "is_root=true entities=2 has_identity=false unclassified_types=1"),
    "h1_client_injected": ("h1_missing=true h1_subheadings=true", "h1_missing=true"),
    "h1_missing": ("h1_missing=true", "h1_missing=true rendering_barrier=true"),
    "heading_skips": ("h1_count=1 level_skips=1", "h1_count=2 level_skips=1"),
    "facts_not_visible": ("facts_inconsistent=true", "facts_inconsistent=true facts_verdict=false"),
    "no_encyclopedia_entry": ("wikipedia=false wikidata=false", "wikipedia=false"),
    "sameas_no_authority": ("sameas_found=true", "sameas_found=true sameas_registry=true"),
    "brand_ambiguous": ("ambiguity_risk=elevated", "ambiguity_risk=elevated ambiguous_verdict=false"),
    "content_stale": ("dates_checked=true content_age_days=541", "dates_checked=true content_age_days=540"),
    "listing_decayed": ("decay_checked=true decayed=true", "decay_checked=true decayed=true relative_recent=true"),
    "page_unreachable": ("dates_checked=false", "dates_checked=true"),
    "landing_no_orientation": ("orientation_ok=true orientation_verdict=false", "orientation_ok=false utility=true"),
    "trust_pages_missing": ("privacy_page=false terms_page=false", "privacy_page=false"),
}


def signals(spark, sites):
    rows = [(s, *x.split("=")) for s, t in sites.items() for x in t.split()] + [(s, "none", None) for s in sites]
    return R.wide(spark.createDataFrame(rows, "site string, signal string, value string"))


def test_probes(spark):
    sites = {f"{slug}/{n}": t for slug, pair in PROBES.items() for n, t in enumerate(pair)}
    found = {(r.site, r.slug) for r in R.findings(signals(spark, sites)).collect()}
    for slug in PROBES:
        assert (f"{slug}/0", slug) in found, slug
        assert (f"{slug}/1", slug) not in found, slug


def test_nothing_measured_finds_nothing(spark):
    assert R.findings(signals(spark, {"x": ""})).collect() == []
    s = signals(spark, {})
    assert R.findings(s).collect() == [] and R.reports(s, R.findings(s)).collect() == []


def test_every_rule_has_a_unique_name_and_a_known_severity():
    assert len({r[0] for r in R.RULES}) == len(R.RULES) == 91
    assert all(any(s in r[2] for s in R.SEVERITIES) for r in R.RULES)


def test_rules_read_only_known_signals(spark):
    known = set(R.SIGNALS)
    empty = signals(spark, {"x": ""})
    for slug, _, _, _, cond in R.RULES:
        empty.where(F.expr(cond))  # an unknown column is an error
    assert known == set(empty.columns) - {"site"}


def test_numbers_are_contiguous_and_severities_do_not_rise(spark):
    t = "robots_malformed=true noindex=true images_no_alt=9 url_depth=9 h1_missing=true tls_valid=true tls_expiring_soon=true"
    f = R.numbered(R.findings(signals(spark, {"a": t, "b": "noindex=true"})))
    rows = sorted(f.where("site = 'a'").collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == [f"F-{i + 1:03d}" for i in range(len(rows))]
    ranks = [R.SEVERITIES.index(r.severity) for r in rows]
    assert ranks == sorted(ranks)


def test_a_blocked_site_is_judged_on_access_only(spark):
    f = {r.slug for r in R.findings(signals(spark, {"a": "bot_blocked=true entities=0 structured_checked=true dates_checked=true copyright_age=9 domain_provided=true search_results=1 domain_in_top=false"})).collect()}
    assert f == {"bot_block_generic", "domain_not_in_results"}


def test_reports_and_sink(spark, tmp_path):
    s = signals(spark, {"a": "noindex=true", "b": ""})
    found = R.findings(s)
    assert R.write_reports(spark, s, found, f"{tmp_path}/r") is None
    got = {r.site: json.loads(r.report) for r in spark.read.json(f"{tmp_path}/r").collect()}
    assert got["a"]["summary"] == {"total_findings": 1, "critical": 1, "high": 0, "medium": 0, "low": 0}
    assert got["a"]["findings"][0]["id"] == "F-001" and got["b"]["findings"] == []
    assert R.write_reports(spark, s, found, "nowhere://x/y")


@pytest.mark.parametrize("severity,want", [("URGENT", "medium"), ("Low", "low"), (None, "medium")])
def test_findings_from_elsewhere_are_put_right(spark, severity, want):
    more = spark.createDataFrame([("a", "x", "engagement", severity, 9.0)], "site string, slug string, category string, severity string, confidence double")
    r = R.findings(signals(spark, {"a": ""}), more).collect()
    assert [(x.severity, x.confidence) for x in r] == [(want, 1.0)]
