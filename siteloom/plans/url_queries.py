"""Queries over the URLs of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .registry import dealt, pages, query, spread

_RX = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Parts of every page's URL, for the queries below.
PARTS = f"""parts as (select page_id, url, html, lower(regexp_extract(url, '{_RX}', 2)) as netloc, regexp_extract(url, '{_RX}', 3) as path, regexp_extract(url, '{_RX}', 4) as q,
    list_filter(string_split(regexp_extract(url, '{_RX}', 3), '/'), lambda s: s <> '') as segs from pages)"""
HOST = r"regexp_replace(regexp_replace(netloc, ':\d*$', ''), '^www\.', '')"


@query("url_normalize", f"with {PARTS} select page_id, lower(regexp_replace(netloc, '^www\\.', '') || regexp_replace(path, '/+$', '')) as norm from parts")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.normalized(F.col("url")).alias("norm"))


@query("url_host", f"with {PARTS} select {HOST} as host, count(*) as pages from parts group by 1")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(
    "url_registrable",
    f"""with {PARTS}, h as (select page_id, string_split({HOST}, '.') as l from parts)
    select page_id, case when len(l) <= 2 then array_to_string(l, '.') when len(l) >= 3 and l[len(l) - 1] in ('co', 'com', 'org', 'net', 'gov', 'ac', 'edu') then array_to_string(l[len(l) - 2:], '.') else array_to_string(l[len(l) - 1:], '.') end as registrable from h""",
)
def url_registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.registrable(U.host(F.col("url"))).alias("registrable"))


@query(
    "url_host_is",
    f"with {PARTS}, h as (select page_id, {HOST} as h from parts) select page_id, h = 'tiontion.example.com' or h like '%.tiontion.example.com' as below_target, h = 'example.com' or h like '%.example.com' as same_or_below from h",
)
def url_host_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = U.host(F.col("url"))
    return pages(spark, sf_dir).select("page_id", U.host_is(h, F.lit("tiontion.example.com")).alias("below_target"), U.same_or_below(F.lit("example.com"), h).alias("same_or_below"))


@query(
    "url_folders",
    f"""with {PARTS}, f as (select page_id, case when len(segs) > 0 and contains(segs[len(segs)], '.') then segs[:len(segs) - 1] else segs end as s from parts),
    g as (select page_id, s, len(s) > 0 and regexp_full_match(s[1], '[a-z]{{2}}') as locale from f)
    select page_id, cast(len(list_filter(s, lambda x, i: not (i = 1 and locale) and not regexp_full_match(x, '(19|20)[0-9]{{2}}'))) as bigint) as depth, case when locale then s[1] || ' (locale)' end as locale, len(list_filter(s, lambda x, i: not (i = 1 and locale) and not regexp_full_match(x, '(19|20)[0-9]{{2}}'))) > 3 as deep from g""",
)
def url_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = U.folders(F.col("url"))
    return pages(spark, sf_dir).select("page_id", f["depth"].alias("depth"), F.get(F.filter(f["ignored"], lambda x: F.endswith(x, F.lit("(locale)"))), F.lit(0)).alias("locale"), (f["depth"] > 3).alias("deep"))


_SEED_PATHS = """(values (1, 'https://a.com/de/2026/03/12/x/y/z.html'), (2, 'https://a.com/lp/a/b/c/d'), (3, 'https://a.com/en-us/shop/2024/31/item'), (4, 'https://a.com/'), (5, 'https://a.com/03/12/a'), (6, '/zh-hant/a/b/'), (7, ''), (8, 'https://a.com/es-419/v1.2/')) as t(page_id, url)"""


@query(
    "url_folders_seed",
    f"""select * from {dealt("(select * from (values (1, 'https://a.com/de/2026/03/12/x/y/z.html', 2, 'de (locale),2026 (year),03 (month/day),12 (month/day)', false), (2, 'https://a.com/lp/a/b/c/d', 5, '', true), (3, 'https://a.com/en-us/shop/2024/31/item', 2, 'en-us (locale),2024 (year),31 (month/day)', false), (4, 'https://a.com/', 0, '', false), (5, 'https://a.com/03/12/a', 3, '', false), (6, '/zh-hant/a/b/', 2, 'zh-hant (locale)', false), (7, '', 0, '', false), (8, 'https://a.com/es-419/v1.2/', 0, 'es-419 (locale)', false)) as t(page_id, url, depth, ignored, deep))", "page_id")} where true""",
)
def url_folders_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = U.folders(F.col("url"))
    return spread(spark, sf_dir, _SEED_PATHS, "page_id").select("page_id", "url", f["depth"].alias("depth"), F.array_join(f["ignored"], ",").alias("ignored"), (f["depth"] > 3).alias("deep"))


GROUP = "case when len(segs) = 0 then '(homepage)' when len(segs) = 1 then '(top-level pages)' else '/' || segs[1] || '/' end"
NOT_PAGE = "regexp_matches(lower(path), '\\.(" + "|".join(U.NON_PAGE) + ")$')"


@query("url_group", f"with {PARTS} select page_id, {GROUP} as name, cast(len(segs) as bigint) as depth, not {NOT_PAGE} as is_page from parts")
def url_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = U.group(F.col("url"))
    return pages(spark, sf_dir).select("page_id", g["name"].alias("name"), g["depth"].alias("depth"), U.is_page(F.col("url")).alias("is_page"))


@query(
    "url_shape",
    f"""with {PARTS} select page_id, len(segs) > 0 and (len(segs) >= 3 or length(segs[len(segs)]) >= 40 or length(segs[len(segs)]) - length(replace(segs[len(segs)], '-', '')) >= 5) as long_tail,
    len(segs) = 0 or (len(segs) = 1 and length(segs[1]) <= 5) as short_root, len(segs) = 0 or (len(segs) = 1 and (length(segs[1]) <= 5 or lower(segs[1]) in ('index.html', 'index.htm', 'index.php', 'home'))) as named_root from parts""",
)
def url_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.long_tail(u).alias("long_tail"), U.short_root(u).alias("short_root"), U.named_root(u).alias("named_root"))


@query(
    "url_keys",
    f"""with {PARTS} select page_id, regexp_replace(netloc, '^www\\.', '') || case when regexp_replace(path, '/+$', '') = '' then '/' else regexp_replace(path, '/+$', '') end as page_key,
    case when path = '' then '/' else path end || case when q = '?' then '' else coalesce(q, '') end as path_and_query from parts""",
)
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.page_key(F.col("url")).alias("page_key"), U.path_and_query(F.col("url")).alias("path_and_query"))


def group_table(urls: DataFrame, site: str = "site", pos: str = "pos") -> DataFrame:
    """(site, pos, url, name, depth, size, modal): the pages of each site with their group, its size and usual depth.

    Counts come from aggregates, joined back, so a site of any size is spread over tasks.
    """
    g = U.group(F.col("url"))
    rows = urls.where(U.is_page(F.col("url"))).select(site, pos, "url", g["name"].alias("name"), g["depth"].alias("depth"))
    depths = rows.groupBy(site, "name", "depth").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    groups = depths.groupBy(site, "name").agg(F.sum("n").alias("size"), F.min("first").alias("first"), F.max_by("depth", F.struct("n", -F.col("depth"))).alias("modal"))
    return rows.join(groups, [site, "name"])


def representative_sample(urls: DataFrame, cap: int = 6, site: str = "site", pos: str = "pos") -> DataFrame:
    """(site, n, url, name, size, reason): the start page, a page of each group by size, then a second of each.

    Of a group, pages of its usual depth stand for it: the first one, then the last. Only those rows are ranked.
    """
    rows = group_table(urls, site, pos).where("depth = modal")
    ends = rows.groupBy(site, "name").agg(F.max("size").alias("size"), F.min("first").alias("first"), F.min_by("url", pos).alias("head"), F.max_by("url", pos).alias("tail"))
    home = F.col("name") == "(homepage)"
    firsts = ends.select(site, "name", "size", "first", F.col("head").alias("url"), F.lit(1).alias("turn"))
    seconds = ends.where(~home & (F.col("tail") != F.col("head"))).select(site, "name", "size", "first", F.col("tail").alias("url"), F.lit(2).alias("turn"))
    w = Window.partitionBy(site).orderBy("turn", F.when(home, 0).otherwise(1), F.desc("size"), "first")
    picked = firsts.unionByName(seconds).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    which = F.when(home, "site homepage").otherwise(F.concat(F.when(F.col("turn") == 1, "first").otherwise("second"), F.lit(" page of a "), F.col("size").cast("string"), F.lit("-URL group")))
    return picked.select(site, "n", "url", "name", "size", which.alias("reason"))


_URLS = f"urls as (select array_to_string(string_split({HOST}, '.')[-2:], '.') as site, page_id as pos, url, {GROUP} as name, len(segs) as depth from parts where not {NOT_PAGE})"


def _site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(U.registrable(U.host(F.col("url"))).alias("site"), F.col("page_id").alias("pos"), "url")


@query("url_group_sizes", f"with {PARTS}, {_URLS}, d as (select site, name, depth, count(*) as n from urls group by all) select site, name, cast(sum(n) as bigint) as size, cast(arg_max(depth, n * 1000 - depth) as bigint) as modal from d group by all")
def url_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_table(_site_urls(spark, sf_dir)).groupBy("site", "name").agg(F.max("size").alias("size"), F.max("modal").alias("modal"))


@query(
    "representative_sample",
    f"""with {PARTS}, {_URLS}, d as (select site, name, depth, count(*) as n, min(pos) as first from urls group by all),
    g as (select site, name, cast(sum(n) as bigint) as size, min(first) as first, arg_max(depth, n * 1000 - depth) as modal from d group by all),
    e as (select u.site, u.name, max(size) as size, min(g.first) as first, arg_min(url, pos) as head, arg_max(url, pos) as tail from urls u join g on u.site = g.site and u.name = g.name and u.depth = g.modal group by all),
    p as (select site, name, size, first, head as url, 1 as turn from e union all select site, name, size, first, tail, 2 from e where name <> '(homepage)' and head <> tail),
    r as (select *, row_number() over (partition by site order by turn, case when name = '(homepage)' then 0 else 1 end, size desc, first) as n from p)
    select site, n, url, name, size, case when name = '(homepage)' then 'site homepage' else case turn when 1 then 'first' else 'second' end || ' page of a ' || size || '-URL group' end as reason from r where n <= 6""",
)
def sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative_sample(_site_urls(spark, sf_dir))


def adaptive_count(total, lo: int, hi: int):
    """The square root of the total, rounded up, within bounds."""
    return F.when(total <= 0, F.lit(lo)).otherwise(F.greatest(F.lit(lo), F.least(F.ceil(F.sqrt(total.cast("double"))), F.lit(hi)))).cast("long")


def every_kth(rows: DataFrame, site: str, pos: str, lo: int, hi: int) -> DataFrame:
    """An evenly spaced sample of each site's rows: every k-th from the first on, as many as ``adaptive_count`` says.

    Places are counted within stretches of positions and shifted by the rows of the stretches before, so a site with
    most of the rows is no single task's.
    """
    cut = rows.withColumn("stretch", F.floor(F.col(pos) / 65536))
    sizes = cut.groupBy(site, "stretch").agg(F.count("*").alias("n"))
    w = Window.partitionBy(site).orderBy("stretch")
    sizes = sizes.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(site))).drop("n")
    place = F.row_number().over(Window.partitionBy(site, "stretch").orderBy(pos)) - 1
    met = cut.withColumn("i", place).join(sizes, [site, "stretch"]).withColumn("i", F.col("i") + F.col("before")).withColumn("cap", adaptive_count(F.col("total"), lo, hi))
    step = F.greatest(F.lit(1).cast("long"), F.expr("total div cap"))
    return met.withColumn("step", step).where("i % step = 0 and i div step < cap")


@query(
    "sitemap_spot_sample",
    f"""with {PARTS}, {_URLS}, c as (select *, count(*) over (partition by site) as total, row_number() over (partition by site order by pos) - 1 as i from urls),
    k as (select *, greatest(5, least(cast(ceil(sqrt(total)) as bigint), 15)) as cap from c), s as (select *, greatest(1, total // cap) as step from k) select site, pos, total, cap from s where i % step = 0 and i // step < cap""",
)
def sitemap_spot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_kth(_site_urls(spark, sf_dir).where(U.is_page(F.col("url"))), "site", "pos", 5, 15).select("site", "pos", "total", "cap")


@query(
    "crawl_budget",
    f"""with {PARTS}, {_URLS}, c as (select site, count(*) as n from urls group by site)
    select site, n, greatest(20, least(cast(ceil(sqrt(n) * 2) as bigint), 60)) as max_pages, case when n > 500 then 4 else 3 end as max_depth, greatest(20.0::double, least(15 + n / 200.0::double, 45.0::double)) as seconds from c""",
)
def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    c = _site_urls(spark, sf_dir).where(U.is_page(F.col("url"))).groupBy("site").agg(F.count("*").alias("n"))
    return c.select(
        "site",
        "n",
        F.greatest(F.lit(20), F.least(F.ceil(F.sqrt(n.cast("double")) * 2), F.lit(60))).cast("long").alias("max_pages"),
        F.when(n > 500, 4).otherwise(3).alias("max_depth"),
        F.greatest(F.lit(20.0), F.least(15 + n / F.lit(200.0), F.lit(45.0))).alias("seconds"),
    )
