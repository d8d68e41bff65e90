"""Queries over fetches, directives, sitemaps, certificates and links: cases of each kind, dealt out over the pages and hosts of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import html_events as H
from .registry import dealt, pages, query, spread

_FETCHES = """(values ('u1', 'browser', 200, true, 9000, false, false, false, false, false), ('u1', 'bot', 403, true, 120, false, false, true, false, true),
 ('u2', 'browser', 200, true, 9000, false, true, false, false, false), ('u2', 'bot', 200, true, 9000, false, true, false, false, false),
 ('u3', 'browser', 200, true, 9000, false, false, false, false, false), ('u3', 'bot', 200, true, 300, false, false, false, false, true),
 ('u4', 'browser', 200, true, 9000, false, false, false, false, false), ('u4', 'bot', null, true, null, null, null, null, null, null),
 ('u5', 'browser', 200, true, 9000, false, false, false, false, false), ('u5', 'bot', null, false, null, null, null, null, null, null),
 ('u6', 'browser', 429, true, 10, false, false, false, false, true), ('u6', 'bot', 503, true, 10, true, false, false, false, true),
 ('u7', 'bot', 200, true, 50, true, true, false, false, true)) as t(url, identity, status, allowed, length, cloudflare, captcha, generic_block, login_wall, thin)"""


@query(
    "identity_comparison",
    f"""with f as (select * from {dealt(_FETCHES, "url", "url")}), b as (select * from f where identity = 'browser'), c as (select * from f where identity = 'bot')
    select coalesce(b.url, c.url) as url, b.status as browser_status, c.status as bot_status, case when b.status is not null and c.status is not null then b.status = c.status end as status_match, case when b.status is not null and c.status is not null then abs(b.length - c.length) end as length_diff,
    case when b.status is not null and c.status is not null then (b.cloudflare, b.captcha, b.generic_block, b.login_wall, b.thin) is distinct from (c.cloudflare, c.captcha, c.generic_block, c.login_wall, c.thin) end as fingerprints_differ,
    coalesce(c.status in (401, 403), false) or coalesce(c.generic_block, false) as bot_blocked, (coalesce(c.cloudflare, false) and not coalesce(b.cloudflare, false)) or (coalesce(c.captcha, false) and not coalesce(b.captcha, false)) as bot_challenged,
    coalesce(c.status between 200 and 299 and b.status between 200 and 299 and c.thin and not b.thin, false) as bot_soft_blocked, coalesce(c.status = 429, false) or coalesce(b.status = 429, false) as rate_limited,
    coalesce(b.status between 200 and 399, false) and c.status is null and coalesce(c.allowed, true) as bot_never_completed, not coalesce(c.allowed, true) as bot_not_allowed from b full join c on b.url = c.url""",
)
def identity_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compare_identities(spread(spark, sf_dir, _FETCHES, "url", "url"))


_HTML = """(values (1, 'Just a moment... CF-CHL token'), (2, '<p>hello</p>'), (3, 'Access Denied. Please verify you are human (reCAPTCHA)'), (4, null)) as t(page_id, html)"""


def _hits(known: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join("'" + x.replace("'", "''") + "'" for x in known) + "], lambda p: contains(lower(coalesce(html, '')), p)), ',')"


@query("challenge_phrases", f"select page_id, {_hits(A.CLOUDFLARE)} as cloudflare, {_hits(A.CAPTCHA)} as captcha, {_hits(A.BLOCKED)} as blocked from {dealt(_HTML, "page_id", mixed="html")}")
def challenge_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return spread(spark, sf_dir, _HTML, "page_id", mixed="html").select("page_id", *[F.array_join(A.phrases(h, k), ",").alias(n) for n, k in (("cloudflare", A.CLOUDFLARE), ("captcha", A.CAPTCHA), ("blocked", A.BLOCKED))])


_DIRECTIVES = """(values (1, 'https://www.a.com/x/', '<meta name="Robots" content="NoIndex, follow"><link rel="canonical" href="https://a.com/x">', ''), (2, 'https://a.com/y', '<meta name="gptbot" content="none">', ''),
 (3, 'https://a.com/z', '<link rel="alternate canonical" href="/other"><link rel="canonical" href="z2">', 'nofollow'), (4, 'https://a.com/w', '<meta name="description" content="noindex">', 'none, noarchive'), (5, 'https://a.com/v', '', '')) as t(page_id, url, html, x_robots)"""


def _lists(text: str, word: str) -> str:
    return f"(contains({text}, '{word}') or list_contains(list_transform(string_split({text}, ','), lambda x: trim(x)), 'none'))"


@query(
    "page_directives",
    f"""with d as (select * from {dealt(_DIRECTIVES, 'page_id')}),
    m as (select page_id, url, lower(coalesce(x_robots, '')) as header, regexp_extract_all(html, '<meta [^>]*>') as metas, list_filter(regexp_extract_all(html, '<link [^>]*>'), lambda l: list_contains(string_split(regexp_extract(l, 'rel="([^"]*)"', 1), ' '), 'canonical')) as links from d),
    n as (select page_id, url, header, coalesce(array_to_string(list_transform(list_filter(metas, lambda t: list_contains([{", ".join(f"'{x}'" for x in A.ROBOTS_META)}], lower(regexp_extract(t, 'name="([^"]*)"', 1)))), lambda t: lower(regexp_extract(t, 'content="([^"]*)"', 1))), ','), '') as meta, len(links) as canonicals, regexp_extract(links[1], 'href="([^"]*)"', 1) as first_c, regexp_extract(links[len(links)], 'href="([^"]*)"', 1) as c from m),
    f as (select *, case when contains(c, '://') then c when starts_with(c, '/') then regexp_extract(url, '^[a-z]+://[^/]*') || c else regexp_replace(url, '[^/]*$', '') || c end as whole from n)
    select page_id, {_lists('meta', 'noindex')} as noindex_meta, {_lists('header', 'noindex')} as noindex_header, {_lists('meta', 'noindex')} or {_lists('header', 'noindex')} as is_noindex, {_lists('meta', 'nofollow')} or {_lists('header', 'nofollow')} as is_nofollow, canonicals > 1 as duplicate_canonical,
    coalesce(coalesce(c, '') <> '' and lower(regexp_replace(regexp_replace(whole, '^https?://(www\\.)?', ''), '/+$', '')) <> lower(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '/+$', '')), false) as canonical_differs from f""",
)
def page_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir, _DIRECTIVES, "page_id").withColumn("headers", F.create_map(F.lit("X-Robots-Tag"), "x_robots"))
    return A.directives(p, H.events(p))


_TLS = "(values ('a.com', true, null, '2025-03-01'), ('b.com', true, null, '2025-01-10'), ('c.com', true, 10, null), ('d.com', true, 62, null), ('e.com', true, 99, null), ('f.com', false, null, null)) as t(host, reachable, verify_code, not_after)"


@query(
    "certificates",
    f"""with t as (select host, reachable, cast(verify_code as int) as verify_code, cast(not_after as timestamp) as not_after from {dealt(_TLS, 'host', 'host')})
    select host, case when reachable then verify_code is null end as certificate_valid, case when verify_code is not null then case verify_code when 9 then 'not_yet_valid' when 10 then 'expired' when 18 then 'self_signed' when 19 then 'self_signed' when 20 then 'untrusted_chain' when 21 then 'untrusted_chain' when 23 then 'revoked' when 62 then 'hostname_mismatch' else 'other' end end as failure_kind,
    case when verify_code is null then cast(floor((epoch(not_after) - epoch(timestamp '2025-01-01')) / 86400) as bigint) end as days_remaining, case when verify_code is null then floor((epoch(not_after) - epoch(timestamp '2025-01-01')) / 86400) <= 14 end as expiring_soon from t""",
)
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(spark, sf_dir, _TLS, "host", "host").withColumn("not_after", F.to_timestamp("not_after")).withColumn("verify_code", F.col("verify_code").cast("int"))
    return t.select("host", *[c.alias(n) for n, c in A.certificate(F.lit("2025-01-01").cast("timestamp")).items()])


_SITEMAPS = """(values ('a', '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.com/ </loc></url><url><loc>https://a.com/b</loc></url></urlset>'),
 ('b', '  <sitemapindex><sitemap><loc>https://b.com/1.xml</loc></sitemap><sitemap><loc>https://b.com/2.xml.gz</loc></sitemap></sitemapindex>'),
 ('c', '<urlset><url><loc>https://c.com/1.xml</loc></url><url><loc>https://c.com/2.xml</loc></url><url><loc>https://c.com/3.xml</loc></url><url><loc>https://c.com/4.xml</loc></url><url><loc>https://c.com/p</loc></url></urlset>'),
 ('d', 'not xml')) as t(site, body)"""


@query(
    "sitemap_locations",
    f"""with f as (select site, body from {dealt(_SITEMAPS, 'site', 'host')} where starts_with(ltrim(body), '<')) select site, trim(unnest(regexp_extract_all(body, '<url><loc>(.*?)</loc>', 1))) as url, false as child from f
    union all select site, trim(unnest(regexp_extract_all(body, '<sitemap><loc>(.*?)</loc>', 1))), true from f""",
)
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sitemap_locations(spread(spark, sf_dir, _SITEMAPS, "site", "host")).select("site", "url", "child")


@query(
    "sitemap_kind",
    f"""with f as (select site, body from {dealt(_SITEMAPS, 'site', 'host')} where starts_with(ltrim(body), '<')), l as (select site, trim(unnest(regexp_extract_all(body, '<url><loc>(.*?)</loc>', 1))) as url, false as child from f
    union all select site, trim(unnest(regexp_extract_all(body, '<sitemap><loc>(.*?)</loc>', 1))), true from f),
    n as (select site, count(*) filter (not child) as pages, count(*) filter (child) as children, count(*) filter (not child and regexp_matches(lower(url), '\\.xml(\\.gz)?$')) as files from l group by site)
    select site, pages, children, children > 0 or (pages > 0 and files >= 0.8 * pages) as is_index from n""",
)
def sitemap_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sitemap_kind(A.sitemap_locations(spread(spark, sf_dir, _SITEMAPS, "site", "host")))


_FAILURES = "(values (1, 404, null), (2, 410, null), (3, 403, null), (4, 401, null), (5, 429, null), (6, 503, null), (7, 302, null), (8, null, 'network'), (9, 200, 'invalid_xml_200'), (10, null, 'other'), (11, null, null)) as t(page_id, status, exc)"


@query(
    "sitemap_failures",
    f"""select page_id, status, exc, case when exc = 'network' then 'network_unreachable' when exc in ('invalid_xml_200', 'other') then exc when status in (404, 410) then 'not_found' when status in (401, 403) then 'blocked' when status = 429 then 'rate_limited' when status between 500 and 599 then 'server_error' else 'other' end as failure from {dealt(_FAILURES, 'page_id')}""",
)
def sitemap_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _FAILURES, "page_id").select("page_id", "status", "exc", A.sitemap_failure(F.col("status"), F.col("exc")).alias("failure"))


_PROBES = "(values ('a.com', 200, '<urlset/>'), ('b.com', 200, '<!doctype html><p>'), ('c.com', 404, 'x'), ('d.com', null, null)) as t(site, status, body)"


@query("sitemap_soft_200", f"select site, status is not null as checked, coalesce(status between 200 and 299 and not regexp_matches(body, '^\\s*<(\\?xml|[a-z]*:?urlset|[a-z]*:?sitemapindex)'), false) as soft_200 from {dealt(_PROBES, 'site', 'host')}")
def sitemap_soft_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usual address that answers with something that is no sitemap."""
    is_map = F.col("body").rlike(r"^\s*<(\?xml|[a-z]*:?urlset|[a-z]*:?sitemapindex)")
    return spread(spark, sf_dir, _PROBES, "site", "host").select("site", F.col("status").isNotNull().alias("checked"), F.coalesce(F.col("status").between(200, 299) & ~is_map, F.lit(False)).alias("soft_200"))


_EDGES = "(values ('s', '/', '/a'), ('s', '/', '/b'), ('s', '/a', '/c'), ('s', '/b', '/c'), ('s', '/c', '/d'), ('s', '/d', '/e'), ('s', '/x', '/y'), ('s', '/c', '/'), ('t', '/', '/a'), ('t', '/a', '/z')) as e(site, src, dst)"


@query(
    "crawl_reach",
    f"""with recursive e as (select * from {dealt(_EDGES, 'site', 'host')}), r(site, url, depth) as (select distinct site, '/', 0 from e union select r.site, e.dst, r.depth + 1 from r join e on e.site = r.site and e.src = r.url where r.depth < 3),
    m as (select site, url, min(depth) as depth from r group by all) select m.site, m.url, m.depth, min(e.src) as parent from m left join (select e.site, e.src, e.dst, p.depth from e join m p on p.site = e.site and p.url = e.src) e on e.site = m.site and e.dst = m.url and e.depth = m.depth - 1 group by all""",
)
def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spread(spark, sf_dir, _EDGES, "site", "host")
    return A.reach(edges, edges.select("site", F.lit("/").alias("url")).distinct(), 3)


@query(
    "crawl_reach_gated",
    f"""with recursive e as (select * from {dealt(_EDGES, 'site', 'host')}), r(site, url, depth) as (select distinct site, '/', 0 from e union select r.site, e.dst, r.depth + 1 from r join e on e.site = r.site and e.src = r.url where r.depth < 3 and r.url in ('/', '/b'))
    select site, url, min(depth) as depth from r group by all""",
)
def crawl_reach_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may not be fetched are seen but lead nowhere."""
    edges = spread(spark, sf_dir, _EDGES, "site", "host")
    starts = edges.select("site", F.lit("/").alias("url")).distinct()
    return A.reach(edges, starts, 3, starts.unionByName(starts.withColumn("url", F.lit("/b")))).select("site", "url", "depth")


_SAMPLED = "(values ('a', 1, 'u1', false), ('a', 2, 'u2', true), ('a', 3, 'u3', true), ('b', 1, 'v1', false), ('b', 2, 'v2', false)) as t(site, pos, url, problem)"


@query("ambiguous_page", f"select site, url, problem from {dealt(_SAMPLED, 'site', 'host')} qualify row_number() over (partition by site order by not problem, pos) = 1")
def ambiguous_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_problem(spread(spark, sf_dir, _SAMPLED, "site", "host"))


@query("decoded_body", "select page_id, case page_id % 4 when 0 then 'gzip' when 1 then 'two members' when 2 then 'deflate' else 'plain' end as packed, length(html) * case when page_id % 4 = 1 then 2 else 1 end as chars, md5(case when page_id % 4 = 1 then html || html else html end) as body_md5, null as note from pages where html is not null")
def decoded_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's HTML, packed as servers send it, and unpacked again."""
    kinds = F.array(*[F.lit(x) for x in ("gzip", "two members", "deflate", "plain")])
    p = pages(spark, sf_dir).where("html is not null").select("page_id", "html", F.element_at(kinds, (F.pmod("page_id", F.lit(4)) + 1).cast("int")).alias("packed"))
    sent = A.packed_bodies(p).withColumn("encoding", F.when(F.col("packed") == "deflate", "deflate").when(F.col("packed") == "gzip", "gzip"))
    return A.decoded_bodies(sent).select("page_id", "packed", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("body_md5"), "note")


_STATUS = "(values (1, '200'), (2, 'timeout'), (3, '404'), (4, null), (5, 'robots_skipped')) as t(page_id, raw)"


@query("typed_status", f"select page_id, try_cast(raw as int) as code, case when raw is not null and try_cast(raw as int) is null then raw end as state from {dealt(_STATUS, 'page_id')}")
def typed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status that is a code or a word, as two columns."""
    code = F.expr("try_cast(raw as int)")
    return spread(spark, sf_dir, _STATUS, "page_id").select("page_id", code.alias("code"), F.when(F.col("raw").isNotNull() & code.isNull(), F.col("raw")).alias("state"))
