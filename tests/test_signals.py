"""The audit from end to end: pages and recordings in, findings of each host out."""

import pytest
from pyspark.sql import functions as F

from siteloom.plans import rules as R
from siteloom.plans import signals as G

WORDS = " ".join(f"word{a}{b}" for a in "abcdefghi" for b in "klmnopqrst")
LD = '<script type="application/ld+json">{}</script>'
ORG = '{"@type": "Organization", "name": "Acme", "url": "u", "logo": "l", "telephone": "+1 555 010 9999", "description": "Acme makes anvils of every size there is", "sameAs": ["https://en.wikipedia.org/wiki/Acme"]}'
GOOD = f'<head><title>Acme anvils</title><meta name="viewport" content="x"><meta name="description" content="We make very good anvils"></head><nav><a href="/contact">Contact</a><a href="/privacy">Privacy</a><a href="/terms">Terms</a></nav><h1>Anvils</h1><p>{WORDS}</p><p>Call +1 555 010 9999</p><p>more</p>' + LD.format(ORG)

#: host: (html, slugs that must be found, slugs that must not)
PAGES = {
    "good.com": (GOOD, [], ["noindex", "h1_missing", "jsonld_missing", "img_alt_missing", "csr_barrier", "waf_interstitial", "sameas_missing", "nap_mismatch", "landing_no_orientation", "brand_not_in_title", "content_buried", "schema_incomplete", "viewport_missing", "trust_pages_missing"]),
    "noindex.com": (GOOD.replace("<head>", '<head><meta name="robots" content="noindex, nofollow">'), ["noindex"], ["nofollow"]),
    "nofollow.com": (GOOD.replace("<head>", '<head><meta name="robots" content="nofollow">'), ["nofollow"], ["noindex"]),
    "canonical.com": (GOOD.replace("<head>", '<head><link rel="canonical" href="/a"><link rel="canonical" href="/b">'), ["canonical_duplicate"], []),
    "moves.com": (GOOD + "<script>location.href = '/x';</script>", ["client_redirect"], ["spa_routing"]),
    "routes.com": (GOOD + "<script>history.pushState({}, '')</script>", ["spa_routing"], ["client_redirect"]),
    "media.com": (GOOD + '<img src="a.png"><img alt="image 2" src="b"><svg><path/></svg><video></video><iframe src="https://vimeo.com/1"></iframe><canvas></canvas><i class="fa fa-x"></i><button><img src="f"></button>', ["img_alt_missing", "img_alt_generic", "svg_unlabeled", "media_no_captions", "iframe_no_title", "canvas_no_fallback", "icon_unlabeled", "control_unlabeled"], []),
    "shell.com": ('<title>x</title><div id="root"></div><script src="/static/js/main.1.js"></script>', ["csr_barrier", "h1_client_injected"], ["waf_interstitial"]),
    "waf.com": ("<title>Just a moment</title><script>window._cf_chl_opt = 1</script>", ["waf_interstitial"], []),
    "bones.com": ('<title>x</title><div class="skeleton">a</div>', ["csr_barrier"], ["skeleton_screen"]),
    "questions.com": (GOOD + "<h2>Why us?</h2><h2>Next</h2>", ["question_unanswered"], []),
    "buried.com": ("<h1>T</h1>" + "".join("<li>a b c d e f</li>" for _ in range(12)) + f"<p>{' '.join(['w'] * 40)}</p>", ["content_buried"], []),
    "typed.com": (GOOD.replace(ORG, '{"@type": "BreadcrumbList", "itemListElement": []}'), ["schema_structural_only", "breadcrumb_empty", "sameas_missing"], []),
    "product.com": (GOOD + LD.format('{"@type": "Product", "name": "Anvil"}'), ["schema_incomplete", "schema_description_gap"], []),
    "faq.com": (GOOD + LD.format('{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Q", "acceptedAnswer": {"text": "quantum bananas wobble sideways nightly"}}, {"@type": "Question", "name": "R"}]}'), ["faq_answer_not_visible", "faq_incomplete"], []),
    "author.com": (GOOD + LD.format('{"@type": "Article", "headline": "h", "author": {"name": "admin"}, "datePublished": "2022-01-01", "dateModified": "2021-01-01", "image": "i", "description": "what this article has to say to us"}'), ["author_placeholder", "content_stale", "date_metadata_error"], []),
    "phone.com": (GOOD.replace("Call +1 555 010 9999", ""), ["nap_mismatch"], []),
    "registry.com": (GOOD.replace("https://en.wikipedia.org/wiki/Acme", "https://example.net/acme"), ["sameas_no_authority"], ["sameas_missing"]),
    "title.com": (GOOD.replace("<title>Acme anvils", "<title>Something else"), ["brand_not_in_title"], []),
    "lost.com": (GOOD.replace("<h1>Anvils</h1>", "").replace('"name": "Acme", ', "").replace('<meta name="description" content="We make very good anvils">', "").replace("Acme makes anvils of every size there is", ""), ["landing_no_orientation", "h1_missing"], []),
    "broken.com": (GOOD.replace(ORG, "{broken"), ["jsonld_unparseable"], ["jsonld_missing"]),
    "half.com": (GOOD + LD.format("{broken"), ["jsonld_partial_errors"], ["jsonld_unparseable"]),
    "plain.com": ("<title>Home</title><p>lorem ipsum</p><p>Copyright 2019</p>", ["jsonld_missing", "title_default", "placeholder_text", "thin_content", "viewport_missing", "trust_pages_missing", "landing_dead_end", "copyright_outdated"], []),
    "twoheads.com": (GOOD + "<h1>Again</h1>", ["h1_multiple"], ["h1_missing"]),
    "skips.com": (GOOD + "<h4>Deep</h4>", ["heading_skips"], ["h1_multiple"]),
    "article.com": (GOOD.replace(ORG, '{"@type": "NewsArticle", "headline": "h", "author": "A Person", "datePublished": "2024-12-01", "image": "i", "description": "what this article has to say to us", "sameAs": "https://example.net/"}'), ["schema_no_identity_home"], ["schema_structural_only", "content_stale"]),
    "facts.com": (GOOD + LD.format('{"@type": "Product", "name": "Zircon Widget", "sku": "QX-77", "description": "a widget that is made of zircon", "offers": {"price": "431.50", "availability": "https://schema.org/InStock"}}'), ["facts_not_visible"], ["schema_incomplete"]),
    "linked.com": (GOOD.replace("https://en.wikipedia.org/wiki/Acme", "https://github.com/acme"), ["sameas_entry_unlinked", "brand_ambiguous"], ["sameas_no_authority"]),
    "challenge.com": (GOOD, ["captcha_shared"], ["bot_block_generic"]),
    "halfway.com": (GOOD, ["bot_fetch_incomplete"], []),
    "large.com": (GOOD + "<!--" + "x" * 2_000_001 + "-->", ["html_too_large"], []),
    "old.com": (GOOD + '<article><time datetime="2020-01-01">then</time></article>', ["listing_decayed"], []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"https://www.{host}/", html, 200, None) for i, (host, (html, *_)) in enumerate(PAGES.items())]
    rows += [
        (100, "https://twice.com/a", GOOD, 200, None),
        (101, "https://twice.com/b", GOOD, 200, None),
        (102, "https://gone.com/", "<p>error</p>", 500, None),
        (103, "https://scripts.com/", "<h1>T</h1>", 200, GOOD + "".join(f'<a href="/{i}">x</a>' for i in range(6))),
        (104, "https://empty.com/", None, 200, None),
        (105, "https://twice.com/old", GOOD, None, None),
        (107, "https://typed-later.com/", GOOD.replace(LD.format(ORG), ""), 200, GOOD),
        (106, "https://blocked.com/", "<p>nothing</p>", 200, None),
    ]
    rows += [(108, "https://blocked2.com/", "<p>nothing</p>", 200, None), (109, "https://deep.com/a/b/c/d/e/f", GOOD, 200, None), (110, "https://nobrowser.com/", GOOD, 200, None), (111, "https://timeout.com/", GOOD, 200, None)]
    why = {110: "no_browser_installed", 111: "timed_out"}
    pages = spark.createDataFrame([(*r, why.get(r[0])) for r in rows], "page_id int, url string, html string, status int, rendered_html string, render_reason string")
    robots = spark.createDataFrame([("good.com", 200, False, "User-agent: *\nAllow: /"), ("twice.com", 200, False, "User-agent: GPTBot\nDisallow: /\nUser-agent: *\nDisallow: /b"), ("gone.com", 200, True, "<html>"), ("deep.com", 200, False, "User-agent: *\nDisallow: /a"), ("skips.com", 200, False, "User-agent: GPTBot\nDisallow: /s"), ("phone.com", 200, False, "User-agent: *\nDisallow: /")], "site string, status int, malformed boolean, robots_txt string")
    tls = spark.createDataFrame([("good.com", True, None, "2026-01-01"), ("old.com", True, 10, None), ("faq.com", True, 20, None), ("media.com", True, None, "2025-01-05"), ("title.com", True, 77, None)], "site string, reachable boolean, verify_code int, not_after string").withColumn("not_after", F.to_timestamp("not_after"))
    fetch = "url string, identity string, status int, allowed boolean, length int, cloudflare boolean, captcha boolean, generic_block boolean, login_wall boolean, thin boolean, redirects int"
    ok = (True, 9000, False, False, False, False, False, 0)
    fetches = spark.createDataFrame(
        [("https://good.com/", "browser", 200, *ok), ("https://good.com/", "bot", 200, *ok), ("https://blocked.com/", "browser", 200, *ok), ("https://blocked.com/", "bot", 403, *ok), ("https://blocked2.com/", "browser", 200, *ok), ("https://blocked2.com/", "bot", 401, None, *ok[1:]), ("https://challenge.com/", "browser", 200, True, 9000, False, True, False, False, False, 0), ("https://challenge.com/", "bot", 200, True, 9000, False, True, False, False, False, 0), ("https://halfway.com/", "browser", 200, *ok), ("https://halfway.com/", "bot", None, *ok), ("https://old.com/", "browser", 200, *ok), ("https://old.com/", "bot", 200, *ok[:-1], 3), ("https://faq.com/", "browser", 429, *ok), ("https://faq.com/", "bot", 302, *ok)],
        fetch,
    )
    probes = spark.createDataFrame(
        [("good.com", True, 200, None, "<?xml version='1.0'?><urlset/>"), ("old.com", True, 404, None, None), ("faq.com", True, 503, None, None), ("title.com", True, 200, None, "<html>"), ("media.com", False, 200, None, "\n<urlset/>"), ("media.com", True, 200, None, "<!doctype html>"), ("lost.com", True, None, "network", None), ("typed.com", True, 403, None, None), ("moves.com", True, 429, None, None)],
        "site string, conventional boolean, status int, failure string, body string",
    )
    results = spark.createDataFrame([("good.com", 1, "https://good.com/", "Acme", ""), ("good.com", 2, "https://en.wikipedia.org/wiki/Acme", "Acme - Wikipedia", ""), ("old.com", 1, "https://other.com/", "Other", ""), *(("linked.com", i + 1, f"https://site{i}.com/", "Acme disambiguation", "") for i in range(8)), ("linked.com", 9, "https://en.wikipedia.org/wiki/Acme", "Acme - Wikipedia", "")], "site string, rank int, url string, title string, snippet string")
    brands = spark.createDataFrame([("good.com", "Acme", "good.com"), ("old.com", "Old", "old.com"), ("linked.com", "Acme", "linked.com")], "site string, brand string, domain string")
    cited = spark.createDataFrame([("good.com", "founding_year", "1990", "https://a.org/", "Acme", "founded in 1990"), ("old.com", "founding_year", "1990", "https://b.org/", "Old", "founded in 1971")], "site string, fact string, on_site string, url string, title string, snippet string")
    keys = spark.createDataFrame([("good.com", "https://good.com/contact"), ("old.com", "https://old.com/pricing"), ("old.com", "https://old.com/a-very-long-tail-of-a-page")], "site string, url string")
    pdfs = spark.createDataFrame([("good.com", bytearray(b"%PDF-1 BT (x) Tj ET"), False), ("old.com", bytearray(b"%PDF-1 /Subtype /Image"), False)], "site string, data binary, truncated boolean")
    more = spark.createDataFrame([("good.com", "resource_errors", "1"), ("only.com", "robots_malformed", "true")], "site string, signal string, value string")
    sites = G.site_signals(pages, F.lit("2025-01-01").cast("timestamp"), robots, tls, fetches, probes, results, brands, cited, keys, pdfs, more)
    got: dict[str, set] = {}
    for r in sites.select("site").collect():
        got[r["site"]] = set()
    for r in R.findings(sites).collect():
        got[r["site"]].add(r["slug"])
    return got


@pytest.mark.parametrize("host", sorted(PAGES))
def test_what_pages_show(found, host):
    _, must, mustnt = PAGES[host]
    assert set(must) <= found[host] and not set(mustnt) & found[host], sorted(found[host])


@pytest.mark.parametrize(
    "host,slugs",
    [
        ("twice.com", ["robots_root_block_training_only", "meta_description_reused"]),
        ("gone.com", ["robots_malformed", "page_unreachable"]),
        ("phone.com", ["robots_root_block_retrieval"]),
        ("scripts.com", ["csr_barrier_confirmed", "links_js_only"]),
        ("typed-later.com", ["schema_js_only"]),
        ("old.com", ["tls_rejected", "redirect_chain_long", "sitemap_missing", "domain_not_in_results", "no_encyclopedia_entry", "citation_contradiction", "nav_unreachable", "nav_unreachable_longtail", "pdf_no_text"]),
        ("faq.com", ["tls_untrusted_chain", "rate_limited", "redirect_never_resolves", "sitemap_server_error"]),
        ("media.com", ["tls_expiring", "sitemap_leading_junk", "sitemap_conventional_soft200"]),
        ("title.com", ["tls_failed_other", "sitemap_invalid_xml"]),
        ("lost.com", ["sitemap_unreachable"]),
        ("typed.com", ["sitemap_blocked"]),
        ("moves.com", ["sitemap_rate_limited"]),
        ("blocked2.com", ["bot_block_generic"]),
        ("deep.com", ["url_too_deep", "robots_path_block_retrieval"]),
        ("nobrowser.com", ["render_no_browser"]),
        ("timeout.com", ["render_failed_page"]),
        ("blocked.com", ["bot_block_policy_mismatch"]),
        ("good.com", ["resource_errors"]),
        ("only.com", ["robots_malformed"]),
    ],
)
def test_what_recordings_show(found, host, slugs):
    assert set(slugs) <= found[host], sorted(found[host])


def test_clean_hosts_stay_clean(found):
    assert not {s for s in found["good.com"] if s.startswith(("robots", "tls", "sitemap", "bot", "redirect", "citation", "nav", "pdf", "render"))}, found["good.com"]


def test_a_blocked_fetch_leaves_the_page_unseen(found):
    assert found["blocked.com"] == {"bot_block_policy_mismatch"}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert G.site_signals(none, F.lit("2025-01-01").cast("timestamp")).count() == 0
