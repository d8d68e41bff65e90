"""Queries over signals: each host of ``pages`` has one of the sets below, in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path, written
from ..sources import reports as P
from . import rules as R
from .registry import dealt, query, spread

_SITES = {
    "blocked.com": "bot_blocked=true robots_permit_cited=true noindex=true entities=0 structured_checked=true dates_checked=true copyright_age=5 domain_provided=true search_results=3 domain_in_top=false no_viewport_no_media=true",
    "clean.com": "robots_malformed=false bot_blocked=false noindex=false sitemap_found=true entities=3 json_errors=0 h1_missing=false h1_count=1 wikipedia=true html_provided=true sameas_found=true sameas_wiki=true spa_routing=true",
    "null.com": "",
    "mixed.com": "root_blocked=2 root_blocked_retrieval=0 path_blocked=1 path_blocked_retrieval=1 tls_valid=false tls_failure=untrusted_chain sitemap_found=false sitemap_failure=blocked url_depth=5 rendering_barrier=true schema_barrier=true skeleton=true "
    "h1_missing=true images_no_alt=4 svg_unlabeled=2 content_age_days=600 dates_checked=true content_age_source=latest_visible_date ambiguity_risk=elevated ambiguous_verdict=false links_js_only=2 links_rendered=8 unlinked_long_tail=1 html_bytes=2000001",
    "verdict.com": "facts_inconsistent=true facts_verdict=false orientation_ok=true orientation_verdict=false dead_end=true utility=true ambiguous_verdict=true faq_detected=3 faq_complete=2 tls_valid=true tls_expiring_soon=true h1_count=2 level_skips=1 bot_challenged=true identities_differ=false rate_limited=true",
}
SEED = "(values ('null.com', 'none', cast(null as string)), " + ", ".join(f"('{s}', '{k}', '{v}')" for s, t in _SITES.items() for k, v in (x.split("=") for x in t.split())) + ") as t(site, signal, value)"
_MORE = "(values ('clean.com', 'extra', 'readability', 'URGENT', cast(7 as double)), ('clean.com', 'extra2', 'engagement', 'Low', cast(null as double)), ('blocked.com', 'extra3', 'readability', 'high', cast(-1 as double))) as m(site, slug, category, severity, confidence)"
_WIDE = "wide as (select site, " + ", ".join(f"try_cast(max(case when signal = '{n}' then value end) as {k}) as {n}" for n, k in R.SIGNALS.items()) + f" from {dealt(SEED.replace('cast(null as string)', 'null'), 'site', 'host')} group by site)"
_FOUND = (
    _WIDE
    + ", raised as ("
    + " union all ".join(f"select site, {i} as rule_no, '{slug}' as slug, '{cat}' as category, {sev} as severity, cast({conf} as double) as confidence from wide where {cond}" for i, (slug, cat, sev, conf, cond) in enumerate(R.RULES))
    + f" union all select site, {len(R.RULES)}, slug, category, case when lower(severity) in ('critical', 'high', 'medium', 'low') then lower(severity) else 'medium' end, greatest(0, least(1, coalesce(confidence, 1))) from {dealt(_MORE, 'site', 'host')}), "
    + "found as (select * from raised r where not ((category in ('crawl_render', 'readability', 'engagement') or slug in ("
    + ", ".join(f"'{s}'" for s in R.ON_PAGE_FRESHNESS)
    + ")) and exists (select 1 from raised b where b.site = r.site and b.slug in ('bot_block_policy_mismatch', 'bot_block_generic'))))"
)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.wide(spread(spark, sf_dir, SEED, "site", "host"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(_sites(spark, sf_dir), spread(spark, sf_dir, _MORE, "site", "host"))


@query("findings", f"with {_FOUND} select site, slug, category, severity, confidence, 'F-' || lpad(cast(row_number() over (partition by site order by {R.RANK}, rule_no, slug) as varchar), 3, '0') as id from found")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered(_found(spark, sf_dir)).select("site", "slug", "category", "severity", "confidence", "id")


@query("severity_counts", f"with {_FOUND} select site, count(*) as total, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in R.SEVERITIES) + " from found group by site")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_counts(_found(spark, sf_dir))


@query("severity_rollup", f"with {_FOUND} select site, category, severity, count(*) as n from found group by rollup (site, category, severity)")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).rollup("site", "category", "severity").agg(F.count("*").alias("n"))


@query(
    "recommendations",
    f"with {_FOUND} "
    + " union all ".join(f"select site, '{n}' as recommendation from wide w where ({c}) and not exists (select 1 from found f where f.site = w.site and f.slug in ({', '.join(repr(m) for m in moot)}))" for n, c, moot in R.RECOMMENDATIONS),
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recommendations(_sites(spark, sf_dir), _found(spark, sf_dir))


@query("coverage_blocked", f"with {_FOUND} select w.site, exists (select 1 from found f where f.site = w.site and f.slug like 'bot_block_%') as coverage_blocked, (select count(distinct category) from found f where f.site = w.site) as categories from wide w")
def coverage_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir).groupBy("site").agg(F.bool_or(F.startswith("slug", F.lit("bot_block_"))).alias("b"), F.countDistinct("category").alias("c"))
    return _sites(spark, sf_dir).select("site").join(f, "site", "left").select("site", F.coalesce("b", F.lit(False)).alias("coverage_blocked"), F.coalesce("c", F.lit(0)).alias("categories"))


@query("reports")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reports(_sites(spark, sf_dir), _found(spark, sf_dir))


@query(
    "report_files",
    f"with {_FOUND} select w.site, w.site <> (select min(site) from wide) as whole, (select count(*) from found f where f.site = w.site and w.site <> (select min(site) from wide)) as findings from wide w",
)
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all hosts as they are written, where the signals of one of them cannot be read: its own report alone is a fallback."""
    sites, found = written(_sites(spark, sf_dir), "sites"), written(_found(spark, sf_dir), "found")
    bad = sites.agg(F.min("site")).first()[0]

    def make(part: DataFrame) -> DataFrame:
        own = R.reports(part, found.join(part.select("site"), "site", "left_semi"))
        return own.withColumn("report", F.when(F.col("site") == bad, F.raise_error(F.lit("unreadable signals"))).otherwise(F.col("report")))

    path = new_path(spark, "reports")
    P.write_isolated(sites, make, path)
    r = F.from_json("report", "error string, findings array<struct<id:string>>")
    return spark.read.schema("site string, report string").json(path).select("site", r["error"].isNull().alias("whole"), F.size(r["findings"]).cast("long").alias("findings"))


@query("reports_json", f"with {_FOUND} select w.site, (select count(*) from found f where f.site = w.site) as total_findings, (select count(*) from found f where f.site = w.site and f.severity = 'high') as high, (select count(*) from found f where f.site = w.site) as listed from wide w")
def reports_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report of each host says, read back from its JSON."""
    r = R.reports(_sites(spark, sf_dir), _found(spark, sf_dir)).withColumn("v", F.parse_json("report"))
    get = lambda path: F.expr(f"variant_get(v, '{path}', 'bigint')")
    return r.select("site", get("$.summary.total_findings").alias("total_findings"), get("$.summary.high").alias("high"), F.size(F.expr("variant_get(v, '$.findings', 'array<variant>')")).cast("long").alias("listed"))
