"""Crawler rules as tables: text to rules, and rules to verdicts by a longest-match pattern join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U

#: Crawlers: token, class, role, whether its operator says it honours the file. Fixed values.
AGENTS = [
    ("oai-searchbot", "retrieval", "search_index", True),
    ("chatgpt-user", "retrieval", "user_fetch", False),
    ("gptbot", "training", "training", True),
    ("claude-searchbot", "retrieval", "search_index", True),
    ("claude-user", "retrieval", "user_fetch", True),
    ("claudebot", "training", "training", True),
    ("anthropic-ai", "training", "training", True),
    ("perplexitybot", "retrieval", "search_index", True),
    ("perplexity-user", "retrieval", "user_fetch", False),
    ("googlebot", "retrieval", "search_index", True),
    ("google-extended", "training", "use_control", True),
    ("bingbot", "retrieval", "search_index", True),
    ("applebot", "retrieval", "search_index", True),
    ("applebot-extended", "training", "use_control", True),
    ("duckassistbot", "retrieval", "user_fetch", True),
    ("meta-webindexer", "retrieval", "search_index", True),
    ("meta-externalfetcher", "retrieval", "user_fetch", False),
    ("meta-externalagent", "training", "training", True),
    ("ccbot", "training", "training", True),
    ("bytespider", "training", "training", True),
]
MAX_HONOURED_DELAY = 10.0


def agent_table(spark: SparkSession) -> DataFrame:
    """(token, class, role, honours): twenty rows, so broadcast is bounded."""
    return F.broadcast(spark.createDataFrame(AGENTS, "token string, class string, role string, honours boolean"))


def parse(files: DataFrame) -> DataFrame:
    """(site, line_no, kind, value, group_id, starts) of every directive of (site, robots_txt).

    A group starts at an agent line that does not follow another one directly (other directives in between count,
    unknown ones and sitemaps do not); the running sum of starts is its id.
    """
    lines = files.select("site", F.posexplode(F.split(F.coalesce("robots_txt", F.lit("")), "\r\n|\r|\n")).alias("line_no", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    key = F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1)))
    rows = lines.where(F.contains(line, F.lit(":"))).select("site", "line_no", key.alias("key"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    kind = F.when(F.col("key").isin("user-agent", "useragent", "user agent"), "agent").when(F.col("key").isin("allow", "disallow", "sitemap"), F.col("key")).when(F.col("key") == "crawl-delay", "delay")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    w = Window.partitionBy("site").orderBy("line_no")
    grouped = rows.where("kind <> 'sitemap'").withColumn("before", F.lag("kind").over(w))
    starts = ((F.col("kind") == "agent") & (F.coalesce("before", F.lit("")) != "agent")).cast("int")
    grouped = grouped.withColumn("group_id", F.sum(starts).over(w)).drop("before", "key")
    maps = rows.where("kind = 'sitemap'").drop("key").withColumn("group_id", F.lit(None).cast("long"))
    return grouped.unionByName(maps)


def rules(parsed: DataFrame) -> DataFrame:
    """(site, agent, kind, pattern, rx): each rule once for every agent of its group; empty patterns match nothing."""
    agents = parsed.where("kind = 'agent'").select("site", "group_id", F.lower("value").alias("agent")).distinct()
    own = parsed.where("kind in ('allow', 'disallow') and group_id > 0").select("site", "group_id", "kind", F.col("value").alias("pattern"))
    return agents.join(own, ["site", "group_id"], "left").select("site", "agent", "kind", "pattern", pattern_regex(F.col("pattern")).alias("rx"))


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * is anything, a dollar at the end anchors, all else stands for itself."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    body = F.regexp_replace(F.regexp_replace(body, r"([\\.+?^$(){}\[\]|])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), body, F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def literal_head(pattern: Column) -> Column:
    """What every target that a pattern matches begins with: the pattern up to its first star, without a dollar at the end."""
    return F.regexp_extract(pattern, r"(?s)^(.*?)(?:\*|\$\z|\z)", 1)


def tried(targets: DataFrame, site_rules: DataFrame) -> DataFrame:
    """``targets`` (site, ruled_by, target, ...) with each rule (kind, pattern, rx) whose literal head they begin with.

    The heads of a site's rules are met by those beginnings of a target that are as long as any of them, so that rules
    and targets meet in an equi-join on the head: no rule sees a target that it cannot match, but by its star.
    """
    rules_ = site_rules.where("pattern <> ''").withColumnRenamed("agent", "ruled_by").withColumn("head", literal_head(F.col("pattern"))).distinct()
    lengths = rules_.groupBy("site", "ruled_by").agg(F.collect_set(F.length("head")).alias("lengths"))
    begun = targets.join(lengths, ["site", "ruled_by"])
    begun = begun.withColumn("head", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("target")), lambda n: F.left(F.col("target"), n)))).drop("lengths")
    return begun.join(rules_, ["site", "ruled_by", "head"])


def verdicts(targets: DataFrame, site_rules: DataFrame) -> DataFrame:
    """(site, agent, url, disallowed, rule, group_name) for targets (site, agent, url).

    An agent that any group names is ruled by those groups alone, others by the * groups. Rules meet the targets that
    begin with their literal head (``tried``); what stands after a star is tried inside that join, and the longest
    match wins by an aggregate, allow before disallow; nothing is crossed over sites, nor over the paths of one.
    """
    t = targets.withColumn("target", U.path_and_query(F.col("url"))).withColumn("token", U.product_token(F.col("agent")))
    named = site_rules.select("site", F.col("agent").alias("token")).distinct().withColumn("named", F.lit(True))
    stars = site_rules.where("agent = '*'").select("site").distinct().withColumn("starred", F.lit(True))
    t = t.join(named, ["site", "token"], "left").join(stars, "site", "left")
    t = t.withColumn("ruled_by", F.when(F.col("named"), F.col("token")).when(F.col("starred"), F.lit("*")))
    asked = t.where("ruled_by is not null and target <> '/robots.txt'").select("site", "agent", "url", "ruled_by", "target")
    plain = F.col("pattern") == F.col("head")  # such a rule is met in whole already
    hits = tried(asked, site_rules).where(plain | F.expr("target rlike rx"))
    best = hits.groupBy("site", "agent", "url").agg(F.max(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"), "kind", "pattern")).alias("best"))
    out = t.join(best, ["site", "agent", "url"], "left")
    return out.select("site", "agent", "url", F.coalesce(~F.col("best.allow"), F.lit(False)).alias("disallowed"), F.concat(F.initcap("best.kind"), F.lit(": "), F.col("best.pattern")).alias("rule"), F.col("ruled_by").alias("group_name"))


def with_query_only(found: DataFrame, site_rules: DataFrame) -> DataFrame:
    """Adds query_only: a URL refused although the same path without its query is not."""
    base = found.where(F.col("disallowed") & F.contains(U.path_and_query(F.col("url")), F.lit("?"))).select("site", "agent", F.col("url").alias("full"), F.split(U.path_and_query(F.col("url")), r"\?")[0].alias("url"))
    plain = verdicts(base.select("site", "agent", "url").distinct(), site_rules).where("not disallowed").select("site", "agent", "url")
    only = base.join(plain, ["site", "agent", "url"]).select("site", "agent", F.col("full").alias("url"), F.lit(True).alias("query_only")).distinct()
    return found.join(only, ["site", "agent", "url"], "left").withColumn("query_only", F.coalesce("query_only", F.lit(False)))


def classified(agents: DataFrame, column: str = "agent") -> DataFrame:
    """Adds class, role and honours of each agent: * is a wildcard, the unknown unclassified."""
    spark = agents.sparkSession
    t = agents.withColumn("token", U.product_token(F.col(column))).join(agent_table(spark), "token", "left")
    return t.withColumn("class", F.when(F.col("token") == "*", "wildcard").otherwise(F.coalesce("class", F.lit("unclassified")))).withColumn("role", F.when(F.col("token") == "*", "all_unlisted_crawlers").otherwise(F.col("role")))


def agent_of_user_agent(spark: SparkSession, agents: DataFrame, column: str = "user_agent") -> DataFrame:
    """Adds agent: the longest known token in a user agent, else *; a bare token is itself."""
    tokens = agent_table(spark).select("token")
    ua = F.trim(F.coalesce(F.col(column), F.lit("")))
    bare = (ua != "") & ~F.contains(ua, F.lit(" ")) & ~F.contains(ua, F.lit("/"))
    best = agents.select(column).distinct().join(tokens, F.contains(F.lower(column), F.col("token"))).groupBy(column).agg(F.max(F.struct(F.length("token").alias("n"), "token")).alias("best"))
    return agents.join(best, column, "left").withColumn("agent", F.when(bare, ua).otherwise(F.coalesce("best.token", F.lit("*")))).drop("best")


def gate(requests: DataFrame, files: DataFrame, site_rules: DataFrame) -> DataFrame:
    """(site, agent, url, allowed, source, rule): may this be fetched?

    The file itself always may. A file that can't be had refuses everything, one that is absent or no rules nothing.
    """
    f = files.select("site", "status", F.coalesce("malformed", F.lit(False)).alias("malformed"))
    has_rules = site_rules.select("site").distinct().withColumn("has_rules", F.lit(True))
    v = verdicts(requests.select("site", "agent", "url"), site_rules)
    r = v.join(f, "site", "left").join(has_rules, "site", "left")
    source = (
        F.when(U.path_of_absolute(F.col("url")) == "/robots.txt", "exempt")
        .when(F.col("status").isNull(), "unreachable")
        .when(F.col("status").between(500, 599), "server_error")
        .when(F.col("status").between(400, 499), "absent")
        .when(F.col("malformed"), "unparseable")
        .when(F.col("has_rules").isNull(), "empty")
        .when(F.col("disallowed"), "disallow")
        .otherwise("allow")
    )
    return r.withColumn("source", source).select("site", "agent", "url", (~F.col("source").isin("unreachable", "server_error", "disallow")).alias("allowed"), "source", F.when(F.col("source").isin("allow", "disallow"), F.col("rule")).alias("rule"))


def crawl_delays(parsed: DataFrame) -> DataFrame:
    """(site, agent, delay): of a named agent the first one declared, of * the largest."""
    d = parsed.where("kind = 'delay' and group_id > 0").select("site", "group_id", "line_no", F.expr("try_cast(value as double)").alias("delay")).where("delay is not null")
    last = d.groupBy("site", "group_id").agg(F.max_by("delay", "line_no").alias("delay"))
    a = parsed.where("kind = 'agent'").select("site", "group_id", F.lower("value").alias("agent")).distinct()
    return a.join(last, ["site", "group_id"]).groupBy("site", "agent").agg(F.when(F.first("agent") == "*", F.max("delay")).otherwise(F.min_by("delay", "group_id")).alias("delay"))


def spacing(declared: Column, floor: Column, left: Column) -> Column:
    """Seconds between two requests: the declared delay up to ten, at least the floor, at most what is left."""
    return F.greatest(F.lit(0.0), F.least(F.greatest(floor, F.least(F.coalesce(declared, F.lit(0.0)), F.lit(MAX_HONOURED_DELAY))), left))
