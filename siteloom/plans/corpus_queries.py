"""Queries that set all pages of a host, or all documents, against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.tables import written
from ..operators import access as A
from ..operators import containment as K
from ..operators import html_events as H
from ..operators import paths as P
from ..operators import robots as R
from ..operators import stated as S
from .page_queries import _TITLE, page_links, shown_sql
from .registry import pages, query
from .url_queries import PARTS


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, id, text): what each page shows, a line for each piece, by host."""
    return H.shown_lines(pages(spark, sf_dir).select(U.host(F.col("url")).alias("scope"), F.col("page_id").cast("long").alias("id"), "html"))


def _norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^0-9a-z]+', ' ', 'g'))"


def _probes_sql(texts: str) -> str:
    """CTEs up to ``probes`` (scope, id, probe, n), ``texts`` being a table (scope, id, text)."""
    return rf"""cut as (select scope, id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), '[\x02\n]+')) as s from {texts}),
    clean as (select scope, id, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from cut),
    kept as (select scope, id, {_norm("s")} as s from clean where length(s) >= 25 and len(string_split(s, ' ')) >= 4 and not regexp_matches(s, '[{{}}<>|\\]|\)\s*;|=>|function\s*\(')),
    probes as (select scope, id, array_to_string(string_split(s, ' ')[1:{K.PROBE}], ' ') as probe, count(*) as n from kept where s <> '' group by all)"""


_PAGE_TEXTS = f"shown as (select regexp_replace(netloc, '^www\\.', '') as scope, page_id as id, replace({shown_sql()}, chr(1), chr(10)) as text from parts)"


@query(
    "host_sentence_absence",
    f"""with {PARTS}, {_PAGE_TEXTS}, {_probes_sql("shown")},
    sizes as (select scope, count(*) as texts from shown group by scope), norm as (select scope, id, {_norm("text")} as text from shown),
    each as (select distinct scope, probe from probes), held as (select e.scope, e.probe, count(*) as held from each e join norm t on t.scope = e.scope and contains(t.text, e.probe) group by all)
    select p.scope as host, p.id as page_id, any_value(texts) as pages, cast(sum(n) as bigint) as sentences, cast(sum(n * (texts - held)) as bigint) as absences, cast(sum(case when held = 1 then n else 0 end) as bigint) as alone
    from probes p join held using (scope, probe) join sizes using (scope) group by all""",
)
def host_sentence_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of each page the other pages of its host lack, over all of them, and how many no other one has."""
    out = K.absences(page_texts(spark, sf_dir))
    return out.select(F.col("scope").alias("host"), F.col("id").alias("page_id"), F.col("texts").alias("pages"), "sentences", "absences", "alone")


@query(
    "benchmark_sentences",
    f"""with items as (select '' as scope, item_id as id, text from benchmark where text is not null), {_probes_sql("items")}, norm as (select doc_id, {_norm("text")} as text from documents),
    each as (select distinct probe from probes), held as (select distinct e.probe, t.doc_id from each e join norm t on contains(t.text, e.probe)), totals as (select id, sum(n) as sentences from probes group by id)
    select p.id as item_id, h.doc_id, cast(any_value(sentences) as bigint) as sentences, cast(sum(n) as bigint) as present, cast(any_value(sentences) - sum(n) as bigint) as absent from probes p join held h using (probe) join totals t on t.id = p.id group by p.id, h.doc_id""",
)
def benchmark_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentences of each benchmark text each document holds and lacks, for documents that hold any."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return K.absent_between(items, docs).select(F.col("id").alias("item_id"), F.col("other").alias("doc_id"), "sentences", "present", "absent")


def host_rules(p: DataFrame) -> DataFrame:
    """(site, agent, kind, pattern, rx) made of the pages' own paths: refused or allowed pages, folders' queries, endings.

    As many rules as pages, about: what a generated file of a large site looks like.
    """
    path = U.path(F.col("url"))
    folder = F.regexp_extract(path, "^/[^/]*/", 0)
    own = p.select(F.col("url"), U.host(F.col("url")).alias("site"), path.alias("path"), folder.alias("folder"), F.pmod("page_id", F.lit(4)).alias("k"))
    shapes = F.array(
        F.when(F.col("k") == 0, F.struct(F.lit("disallow").alias("kind"), F.col("path").alias("pattern"))),
        F.when(F.col("k") == 1, F.struct(F.lit("allow").alias("kind"), F.concat("path", F.lit("$")).alias("pattern"))),
        F.when(F.col("k") == 2, F.struct(F.lit("disallow").alias("kind"), F.regexp_replace("path", "[0-9](/|[.]html)?$", "").alias("pattern"))),
        F.when(F.col("folder") != "", F.struct(F.lit("disallow").alias("kind"), F.concat("folder", F.lit("*?page=")).alias("pattern"))),
        F.struct(F.lit("allow").alias("kind"), F.lit("/*.html$").alias("pattern")),
    )
    rules = own.select("site", F.explode(F.array_compact(shapes)).alias("r")).select("site", F.lit("*").alias("agent"), "r.kind", "r.pattern").where("pattern <> ''").distinct()
    return rules.withColumn("rx", R.pattern_regex(F.col("pattern")))


_HOST_RULES = f"""{PARTS}, own as (select page_id, url, regexp_replace(netloc, '^www\\.', '') as site, path, regexp_extract(path, '^/[^/]*/') as folder, page_id % 4 as k, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') as target from parts),
    rules as (select distinct * from (select site, 'disallow' as kind, path as pattern from own where k = 0 union all select site, 'allow', path || '$' from own where k = 1 union all select site, 'disallow', regexp_replace(path, '[0-9](/|[.]html)?$', '') from own where k = 2
              union all select site, 'disallow', folder || '*?page=' from own where folder <> '' union all select site, 'allow', '/*.html$' from own) where pattern <> ''),
    forms as (select *, '^' || replace(regexp_replace(rtrim(pattern, '$'), '([\\\\.+?^$(){{}}\\[\\]|])', '\\\\\\1', 'g'), '*', '.*') || case when ends_with(pattern, '$') then '$' else '' end as rx, string_split(rtrim(pattern, '$'), '*')[1] as head from rules)"""


@query(
    "host_rule_verdicts",
    f"""with {_HOST_RULES}, hits as (select o.page_id, f.kind, f.pattern, row_number() over (partition by o.page_id order by length(f.pattern) desc, f.kind) as n from own o join forms f on f.site = o.site and regexp_matches(o.target, f.rx))
    select o.site as host, o.page_id, coalesce(h.kind = 'disallow', false) as disallowed, upper(h.kind[1]) || h.kind[2:] || ': ' || h.pattern as rule from own o left join hits h on h.page_id = o.page_id and h.n = 1""",
)
def host_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules made of the pages' own paths say of each page."""
    p = pages(spark, sf_dir)
    asked = p.select(U.host(F.col("url")).alias("site"), F.lit("anybot").alias("agent"), "url").distinct()
    found = R.verdicts(asked, host_rules(p))
    return p.select("page_id", "url", U.host(F.col("url")).alias("site")).join(found, ["site", "url"]).select(F.col("site").alias("host"), "page_id", "disallowed", "rule")


@query(
    "host_rule_comparisons",
    f"""with {_HOST_RULES}, targets as (select distinct site, target from own), met as (select t.site, count(*) as tried from targets t join forms f on f.site = t.site and starts_with(t.target, f.head) group by t.site)
    select site as host, (select count(*) from forms f where f.site = m.site) as rules, (select count(*) from targets t where t.site = m.site) as paths, tried from met m""",
)
def host_rule_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many patterns are tried for each host, beside how many rules and paths it has."""
    p = pages(spark, sf_dir)
    rules = host_rules(p)
    asked = p.select(U.host(F.col("url")).alias("site"), F.lit("*").alias("ruled_by"), U.path_and_query(F.col("url")).alias("target")).distinct()
    met = R.tried(asked, rules).groupBy("site").agg(F.count("*").alias("tried"))
    return met.join(rules.groupBy("site").agg(F.count("*").alias("rules")), "site").join(asked.groupBy("site").agg(F.count("*").alias("paths")), "site").select(F.col("site").alias("host"), "rules", "paths", "tried")


_STOP = ", ".join(f"'{w}'" for w in S.FACT_STOPWORDS)
_STATED = f"""titles as (select page_id as fact, {_TITLE} as value from pages), f as (select fact, list_filter(list_distinct(regexp_extract_all(lower(value), '{S.WORD}')), lambda w: w not in ({_STOP})) as words from titles),
    t as (select page_id as id, list_distinct(regexp_extract_all(lower({shown_sql()}), '{S.WORD}')) as has from pages),
    met as (select fact, id, len(words) as n, len(list_intersect(words, has)) as shared from f, t where len(words) > 0)"""


@query("stated_titles", f"with {_STATED} select fact as page_id, id as stated_by, cast(n as bigint) as words, cast(shared as bigint) as shared from met where shared / n::double >= {S.SHARE}::double")
def stated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages state what a page's title says: seven tenths of its words, whichever page it is."""
    read = H.titled_lines(pages(spark, sf_dir).select(F.col("page_id").cast("long").alias("id"), "html"))
    read = written(read.select("id", "title", S.tokens(F.col("text")).alias("has")), "text-words")
    return S.stated_in(read.select(F.col("id").alias("fact"), H.collapsed(F.col("title")).alias("value")), read.select("id", "has")).select(F.col("fact").alias("page_id"), F.col("id").alias("stated_by"), "words", "shared")


_FOREST = f"""{PARTS}, own as (select distinct regexp_replace(netloc, '^www\\.', '') as site, regexp_replace(path, '/+$', '') as path from parts),
    up as (select site, path as url, regexp_replace(path, '/[^/]*$', '') as parent from own where path <> ''),
    folders as (select distinct site, parent as url, '' as parent from up where parent <> ''),
    starts as (select distinct site, '' as url from own),
    links as (select distinct regexp_replace(netloc, '^www\\.', '') as site, regexp_replace(path, '/+$', '') as src, regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '[#?].*$', ''), '/+$', '') as dst from parts),
    first_links as (select site, replace(dst, '&amp;', '&') as url, src from links where dst <> '')"""


def site_edges(p: DataFrame, ev: DataFrame) -> DataFrame:
    """(site, src, dst): each page's links, and each folder's own pages and folders below the start; paths without queries."""
    path = lambda u: F.regexp_replace(U.path(u), "/+$", "")
    own = p.select("page_id", U.host(F.col("url")).alias("site"), path(F.col("url")).alias("path"))
    links = page_links(p, ev).join(own, "page_id").where(U.host(F.col("url")) == F.col("site")).select("site", F.col("path").alias("src"), path(F.col("url")).alias("dst"))
    steps = F.split("path", "/")
    tree = own.select("site", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda i: F.struct(F.array_join(F.slice(steps, 1, i - 1), "/").alias("src"), F.array_join(F.slice(steps, 1, i), "/").alias("dst")))).alias("e")).select("site", "e.src", "e.dst")
    return links.unionByName(tree).where("src <> dst").distinct()


@query(
    "page_ways",
    f"""with recursive {_FOREST}, edges as (select site, src, url as dst from first_links where src <> url union select site, parent, url from up union select site, parent, url from folders),
    level as (select site, url, 0 as depth, [url] as way from starts union all
              select site, dst, depth + 1, list_append(way, dst) from (select l.site, e.dst, l.depth, l.way, row_number() over (partition by l.site, e.dst order by l.url) as n from level l join edges e on e.site = l.site and e.src = l.url where l.depth < 12 and not list_contains(l.way, e.dst)) where n = 1),
    best as (select *, row_number() over (partition by site, url order by depth) as n from level)
    select site as host, url as path, cast(depth as int) as depth, array_to_string(way, ' > ') as way from best where n = 1""",
)
def page_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest way from each host's start to every path of it that links or folders lead to; of several the least parent's."""
    p = pages(spark, sf_dir)
    edges = site_edges(p, H.events(p))
    starts = edges.select("site").distinct().select("site", F.lit("").alias("url"))
    found = A.reach(edges, starts, levels=1000)
    return P.ways(found.select("site", "url", "parent")).select(F.col("site").alias("host"), F.col("url").alias("path"), "depth", F.array_join("way", " > ").alias("way"))
