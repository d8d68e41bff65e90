"""Queries over crawler-rule files: each host of ``pages`` has one of the files below, in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robots as R
from .registry import dealt, query, spread, values

_TEXTS = {
    "a.com": ["User-agent: *", "Disallow: /private/", "Allow: /private/open", "Disallow: /*?*", "Crawl-delay: 2", "", "User-agent: GPTBot", "User-agent: CCBot", "Disallow: /", "Sitemap: https://a.com/sitemap.xml"],
    "b.com": ["# all may", "User-Agent: googlebot", "Allow: /", "Disallow: /lp/", "Crawl-delay: 20", "Content-Signal: x", "User-agent: *", "Disallow:"],
    "c.com": ["User-agent: *", "Disallow: /", "User-agent: Claude-SearchBot", "Allow: /docs$", "Disallow: /docs", "Crawl-delay: abc", "Crawl-delay: 1.5"],
    "d.com": [""],
    "e.com": ["User-agent: *", "Disallow: /x"],
    "f.com": ["User-agent: *", "Disallow: /a.b+(c)"],
    "g.com": ["Disallow: /orphan", "User-agent: bingbot", "Disallow: /page", "Allow: /page"],
}
_STATUS = {"a.com": "200", "b.com": "200", "c.com": "200", "d.com": "404", "e.com": "503", "f.com": "200", "g.com": "null"}
FILES = "(values " + ", ".join(f"('{s}', '{'|'.join(t)}', {_STATUS[s]}, {'true' if s == 'f.com' else 'false'})" for s, t in _TEXTS.items()) + ") as t(site, lines, status, malformed)"
PATHS = "(values ('/'), ('/private/x'), ('/private/open/y'), ('/shop?page=2'), ('/lp/1'), ('/docs'), ('/docs/a'), ('/robots.txt'), ('/a.b+(c)'), ('/page'), ('/x')) as p(url)"
WHO = "(values ('*'), ('GPTBot'), ('Googlebot/2.1'), ('Claude-SearchBot'), ('bingbot'), ('other')) as w(agent)"

#: The rules of all files as tables, for the SQL below.
TABLES = rf"""files as (select * from {dealt(FILES, "site", "host")}),
    lines as (select site, generate_subscripts(string_split(lines, '|'), 1) as line_no, unnest(string_split(lines, '|')) as raw from files),
    keyed as (select site, line_no, lower(trim(string_split(regexp_replace(raw, '#.*$', ''), ':')[1])) as k, trim(regexp_extract(regexp_replace(raw, '#.*$', ''), '^[^:]*:(.*)$', 1)) as value from lines where contains(regexp_replace(raw, '#.*$', ''), ':')),
    kinds as (select *, case when k in ('user-agent', 'useragent', 'user agent') then 'agent' when k in ('allow', 'disallow') then k when k = 'crawl-delay' then 'delay' end as kind from keyed),
    known as (select *, lag(kind) over (partition by site order by line_no) as before from kinds where kind is not null),
    parsed as (select site, line_no, kind, value, cast(sum(case when kind = 'agent' and before is distinct from 'agent' then 1 else 0 end) over (partition by site order by line_no) as bigint) as group_id from known),
    agents as (select distinct site, group_id, lower(value) as agent from parsed where kind = 'agent'),
    rules as (select a.site, a.agent, p.kind, p.value as pattern, '^' || replace(regexp_replace(case when ends_with(p.value, '$') then p.value[:-2] else p.value end, '([\\.+?^$(){{}}\[\]|])', '\\\1', 'g'), '*', '.*') || case when ends_with(p.value, '$') then '$' else '' end as rx
              from agents a left join parsed p on a.site = p.site and a.group_id = p.group_id and p.kind in ('allow', 'disallow')),
    targets as (select site, agent, url, lower(trim(string_split(agent, '/')[1])) as token from files cross join {PATHS} cross join {WHO}),
    ruled as (select *, case when exists (select 1 from rules r where r.site = t.site and r.agent = t.token) then token when exists (select 1 from rules r where r.site = t.site and r.agent = '*') then '*' end as g from targets t),
    hits as (select t.*, r.kind, r.pattern, row_number() over (partition by t.site, t.agent, t.url order by length(r.pattern) desc, r.kind) as n from ruled t join rules r on r.site = t.site and r.agent = t.g and r.pattern <> '' and t.url <> '/robots.txt' and regexp_matches(t.url, r.rx)),
    verdicts as (select t.site, t.agent, t.url, coalesce(h.kind = 'disallow', false) as disallowed, upper(h.kind[1]) || h.kind[2:] || ': ' || h.pattern as rule, t.g as group_name from ruled t left join hits h on h.site = t.site and h.agent = t.agent and h.url = t.url and h.n = 1)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, FILES.replace("\\", "\\\\"), "site", "host").withColumn("robots_txt", F.replace("lines", F.lit("|"), F.lit("\n")))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse(_files(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("site").crossJoin(F.broadcast(values(spark, PATHS))).crossJoin(F.broadcast(values(spark, WHO)))  # both lists are literals


@query("robots_parse", f"with {TABLES} select site, kind, value, group_id from parsed")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("kind <> 'sitemap'").select("site", "kind", "value", "group_id")


@query("robots_sitemaps", f"""with {TABLES} select site, value as sitemap from (select site, k, value from keyed) where k = 'sitemap'""")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("kind = 'sitemap'").select("site", F.col("value").alias("sitemap"))


@query("robots_matrix", f"with {TABLES} select * from verdicts")
def robots_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.verdicts(_targets(spark, sf_dir), R.rules(_parsed(spark, sf_dir)))


@query(
    "robots_query_only",
    f"""with {TABLES}, base as (select v.site, v.agent, v.url, string_split(v.url, '?')[1] as plain from verdicts v where v.disallowed and contains(v.url, '?')),
    r2 as (select b.*, case when exists (select 1 from rules r where r.site = b.site and r.agent = lower(string_split(b.agent, '/')[1])) then lower(string_split(b.agent, '/')[1]) else '*' end as g from base b),
    h2 as (select b.site, b.agent, b.url, arg_max(r.kind, length(r.pattern) * 2 + (r.kind = 'allow')::int) as kind from r2 b left join rules r on r.site = b.site and r.agent = b.g and r.pattern <> '' and regexp_matches(b.plain, r.rx) group by all)
    select site, agent, url from h2 where kind is null or kind = 'allow'""",
)
def robots_query_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.rules(_parsed(spark, sf_dir))
    return R.with_query_only(R.verdicts(_targets(spark, sf_dir), r), r).where("query_only").select("site", "agent", "url")


@query(
    "robots_gate",
    f"""with {TABLES}, s as (select v.*, case when v.url = '/robots.txt' then 'exempt' when f.status is null then 'unreachable' when f.status between 500 and 599 then 'server_error' when f.status between 400 and 499 then 'absent'
    when f.malformed then 'unparseable' when not exists (select 1 from rules r where r.site = v.site) then 'empty' when v.disallowed then 'disallow' else 'allow' end as source from verdicts v join files f on f.site = v.site)
    select site, agent, url, source not in ('unreachable', 'server_error', 'disallow') as allowed, source, case when source in ('allow', 'disallow') then rule end as rule from s""",
)
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gate(_targets(spark, sf_dir), _files(spark, sf_dir), R.rules(_parsed(spark, sf_dir)))


_NAMED = "(values (1, '*'), (2, 'GPTBot'), (3, 'Googlebot/2.1'), (4, 'Claude-SearchBot'), (5, 'bingbot'), (6, 'other')) as w(page_id, agent)"
_CLASSES = "(values " + ", ".join(f"('{t}', '{c}', '{r}', {str(h).lower()})" for t, c, r, h in R.AGENTS) + ") as k(token, class, role, honours)"


@query("agent_classes", f"select page_id, agent, case when token is null and agent = '*' then 'wildcard' else coalesce(class, 'unclassified') end as class, case when agent = '*' then 'all_unlisted_crawlers' else role end as role, honours from {dealt(_NAMED, 'page_id')} left join {_CLASSES} on lower(trim(string_split(agent, '/')[1])) = token")
def agent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classified(spread(spark, sf_dir, _NAMED, "page_id")).select("page_id", "agent", "class", "role", "honours")


_UAS = "(values (1, 'Mozilla/5.0 (compatible; GPTBot/1.2)'), (2, 'Mozilla/5.0 Applebot-Extended/0.1'), (3, 'Mozilla/5.0 (Windows NT 10.0)'), (4, 'PerplexityBot'), (5, ''), (6, '*'), (7, 'foo Meta-ExternalAgent meta-externalfetcher/1')) as u(page_id, user_agent)"


@query(
    "agent_of_user_agent",
    f"select page_id, user_agent, case when user_agent <> '' and not contains(user_agent, ' ') and not contains(user_agent, '/') then user_agent else coalesce((select arg_max(token, length(token) * 1000 + ascii(token)) from {_CLASSES} where contains(lower(user_agent), token)), '*') end as agent from {dealt(_UAS, 'page_id')}",
)
def agent_of_user_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.agent_of_user_agent(spark, spread(spark, sf_dir, _UAS, "page_id")).select("page_id", "user_agent", "agent")


@query(
    "crawl_delay",
    f"""with {TABLES}, d as (select site, group_id, arg_max(try_cast(value as double), line_no) filter (try_cast(value as double) is not null) as delay from parsed where kind = 'delay' group by all)
    select a.site, a.agent, case when a.agent = '*' then max(delay) else arg_min(delay, a.group_id) end as delay, greatest(0.0::double, least(greatest(2.0::double, least(case when a.agent = '*' then max(delay) else arg_min(delay, a.group_id) end, 10.0::double)), 8.0::double)) as spacing
    from agents a join d on a.site = d.site and a.group_id = d.group_id where delay is not null group by a.site, a.agent""",
)
def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.crawl_delays(_parsed(spark, sf_dir))
    return d.select("site", "agent", "delay", R.spacing(F.col("delay"), F.lit(2.0), F.lit(8.0)).alias("spacing"))


@query(
    "robots_blocks_by_class",
    f"""with {TABLES}, v as (select v.*, case when v.agent = '*' then 'wildcard' else coalesce(k.class, 'unclassified') end as class, k.honours from verdicts v left join {_CLASSES} on lower(trim(string_split(v.agent, '/')[1])) = k.token)
    select site, url, string_agg(agent, ',' order by agent) filter (disallowed and class <> 'training' and honours is distinct from false) as impacting, string_agg(agent, ',' order by agent) filter (disallowed and class = 'training') as training,
    string_agg(agent, ',' order by agent) filter (disallowed and class <> 'training' and honours = false) as ineffective, bool_or(not disallowed and class = 'retrieval') as retrieval_allowed from v where url in ('/', '/docs') group by site, url""",
)
def robots_blocks_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.classified(R.verdicts(_targets(spark, sf_dir).where(F.col("url").isin("/", "/docs")), R.rules(_parsed(spark, sf_dir))))
    training, idle = F.col("class") == "training", ~F.col("honours").eqNullSafe(F.lit(False))

    def names(condition) -> F.Column:
        return F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("agent")))), ","), F.lit(""))

    return v.groupBy("site", "url").agg(
        names(F.col("disallowed") & ~training & idle).alias("impacting"),
        names(F.col("disallowed") & training).alias("training"),
        names(F.col("disallowed") & ~training & ~idle).alias("ineffective"),
        F.bool_or(~F.col("disallowed") & (F.col("class") == "retrieval")).alias("retrieval_allowed"),
    )


@query("robots_by_rule", f"with {TABLES} select site, url, rule, group_name, count(*) as agents, string_agg(agent, ',' order by agent) as who from verdicts where disallowed group by all")
def robots_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.verdicts(_targets(spark, sf_dir), R.rules(_parsed(spark, sf_dir))).where("disallowed")
    return v.groupBy("site", "url", "rule", "group_name").agg(F.count("*").alias("agents"), F.array_join(F.array_sort(F.collect_list("agent")), ",").alias("who"))


_CANDIDATES = """(values ('a.com', 1, 'https://a.com/robots.txt', 200, '<!DOCTYPE html><html>'), ('a.com', 2, 'https://www.a.com/robots.txt', 200, 'User-agent: *'), ('a.com', 3, 'http://a.com/robots.txt', 200, 'x: y'),
    ('b.com', 1, 'https://b.com/robots.txt', 404, null), ('b.com', 2, 'https://www.b.com/robots.txt', null, null), ('c.com', 1, 'https://c.com/robots.txt', 200, ' <HTML><body>'), ('d.com', 1, 'https://d.com/robots.txt', 200, '')) as t(site, n, url, status, body)"""


@query(
    "robots_candidate",
    f"""with c as (select *, status = 200 and not (starts_with(trim(lower(coalesce(body, ''))), '<!doctype html') or contains(lower(coalesce(body, '')), '<html') or contains(lower(coalesce(body, '')), '<body')) as ok, status = 200 and (starts_with(trim(lower(coalesce(body, ''))), '<!doctype html') or contains(lower(coalesce(body, '')), '<html')) as html from {dealt(_CANDIDATES, 'site', 'host')})
    select site, coalesce(arg_min(url, n) filter (ok), arg_min(url, n) filter (html)) as resolved, coalesce(bool_or(ok), false) or coalesce(bool_or(html), false) as reachable, not coalesce(bool_or(ok), false) and coalesce(bool_or(html), false) as malformed from c group by site""",
)
def robots_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidate addresses of a file, the first that answers with rules; else the first that answers with a page."""
    body = F.trim(F.lower(F.coalesce("body", F.lit(""))))
    page = F.startswith(body, F.lit("<!doctype html")) | body.rlike("<html|<body")
    c = spread(spark, sf_dir, _CANDIDATES, "site", "host").withColumn("got", F.coalesce(F.col("status") == 200, F.lit(False)))
    first = lambda on: F.min_by(F.when(on, F.col("url")), F.when(on, F.col("n")))
    ok, html = F.col("got") & ~page, F.col("got") & page
    return c.groupBy("site").agg(F.coalesce(first(ok), first(html)).alias("resolved"), F.bool_or("got").alias("reachable"), (~F.bool_or(ok) & F.bool_or(html)).alias("malformed"))
