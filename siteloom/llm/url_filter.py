"""URL filters: prefix rules first; then a blocked Bloom filter of listed canonical URLs, whose hits an exact hash join confirms.

A canonical URL is the host without ``www.``, the path without slashes at its end, and the query's parameters in
order, without those that only track (``ref``, ``utm_*``); scheme and fragment are no part of it.

The filter has a row for each block of 512 bits; a key sets one bit in each of its block's eight words. It is broadcast:
it has ``MOST_BLOCKS`` rows at most, whatever the length of the list; a longer list fills it more, passes more URLs that
are not listed to the join, and changes no verdict.

Result for odd input: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; an
empty list blocks nothing; rows that repeat are judged alike; null ids are kept; an empty table gives an empty result;
extra columns are ignored by the query, and kept by ``judged`` unless they have the name of a column it adds.
"""

from __future__ import annotations

import math
import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_facts, materialize, table

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The query lists the canonical URLs of pages whose host holds one of these.
MARKS = ("casino", "pills", "spam")
#: Bits of the filter for each listed URL, words of 64 bits in a block, blocks at most (32 MB of bits).
BITS, WORDS, MOST_BLOCKS = 16, 8, 1 << 19
ADDED = ("host", "path", "canonical", "rule", "verdict")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical URL; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    asked = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(r"^(ref|utm_[^=]*)(=|\z)")))
    return F.when(host != "", F.concat(host, F.rtrim(path_of(url), F.lit("/")), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def winning_rule(host: Column, path: Column, rules) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits (equal lengths: the later in order of its text); null without one."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(none, *fits) if fits else none


def _place(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: str, word: int) -> Column:
    """The key's bit in one word of its block, from six bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(63).cast("int"))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0, w1, ...): the blocked Bloom filter of a column of keys; blocks without a key have no row."""
    return keys.groupBy(_place(key, blocks).alias("block")).agg(*[F.bit_or(_bit(key, i)).alias(f"w{i}") for i in range(WORDS)])


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``pages`` with host, path, canonical, rule and verdict; ``listed`` has the listed URLs in its first column."""
    names = [c for c in pages.columns if c not in ADDED]
    key, block, maybe = (f"siteloom_{x}_{uuid.uuid4().hex}" for x in ("key", "block", "maybe"))
    url = F.col("url")
    rows = pages.select(*names, host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn(key, winning_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select(*names, "host", "path", "canonical", F.col(key)["rule"].alias("rule"), F.col(key)["verdict"].alias("verdict"))
    keys = materialize(listed.select(canonical(F.col(listed.columns[0])).alias(key)).where(F.col(key).isNotNull()).distinct(), "listed")
    blocks = max(1, min(most_blocks, math.ceil(keys.count() * BITS / (64 * WORDS))))
    bits = bloom_filter(keys, key, blocks).withColumnRenamed("block", block)
    asked = F.when(F.col("rule").isNull(), _place("canonical", blocks))
    hit = reduce(Column.__and__, (F.col(f"{block}_{i}").bitwiseAND(_bit("canonical", i)) != 0 for i in range(WORDS)))
    bits = bits.select(block, *[F.col(f"w{i}").alias(f"{block}_{i}") for i in range(WORDS)])
    seen = rows.join(F.broadcast(bits), (asked == F.col(block)) & F.col("canonical").isNotNull(), "left")  # MOST_BLOCKS rows at most
    seen = materialize(seen.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(maybe)), "possible-urls")
    out = [*names, "host", "path", "canonical", "rule"]
    passed = seen.where(~F.col(maybe)).select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    # Each possible hit once: a URL with a third of all pages is one row here, and meets its verdict by broadcast below.
    possible = seen.where(F.col(maybe))
    known = possible.select(F.col("canonical").alias(key)).distinct().join(keys.withColumn(block, F.lit(True)).hint("shuffle_hash"), key, "left").select(key, F.coalesce(block, F.lit(False)).alias(block))
    confirmed = join_facts(possible.withColumn(key, F.col("canonical")), known, [key], by=None)
    return passed.unionByName(confirmed.select(*out, F.when(F.col(block), "block").otherwise("allow").alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marked = pages.where(host_of(F.col("url")).rlike("|".join(MARKS))).select("url")
    return judged(pages, marked).select("page_id", "host", "path", "canonical", "rule", "verdict")


def oracle() -> str:
    """The same for DuckDB."""
    fits = ", ".join(f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'n': {len(h + p)}, 'rule': '{h + p}', 'verdict': '{v}'}} end" for v, h, p in RULES)
    return f"""
    with r as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
    h as (select page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from r),
    q as (select *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(ref|utm_[^=]*)(=|$)'))) as asked, regexp_replace(host, '^www\\.', '') as bare from h),
    c as (select page_id, host, path, case when bare <> '' then concat(bare, rtrim(path, '/'), case when len(asked) > 0 then '?' || array_to_string(asked, '&') else '' end) end as canonical,
                 list_max([{fits}]) as fit from q),
    listed as (select distinct canonical from c where regexp_matches(host, '{"|".join(MARKS)}') and canonical is not null)
    select page_id, host, path, canonical, fit.rule as rule, coalesce(fit.verdict, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict from c"""
