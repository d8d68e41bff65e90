"""Fetches, page directives, sitemaps, certificates and the link graph."""

from __future__ import annotations

import gzip
import html
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..functions.tables import written

#: Phrases of challenge and block pages. Fixed values.
CLOUDFLARE = ["checking your browser", "cf-browser-verification", "cf-chl", "just a moment", "cf-im-under-attack", "enable javascript and cookies to continue"]
CAPTCHA = ["recaptcha", "hcaptcha", "g-recaptcha", "verify you are human", "captcha-container", "i'm not a robot"]
BLOCKED = ["access denied", "403 forbidden", "access forbidden", "request blocked", "blocked by security policy"]
#: Names under which a page gives robots directives. Fixed values.
ROBOTS_META = ["robots", "googlebot", "googlebot-news", "bingbot", "slurp", "gptbot", "claudebot", "perplexitybot", "google-extended", "applebot"]
#: What a verification code means. Fixed values.
VERIFY = {9: "not_yet_valid", 10: "expired", 18: "self_signed", 19: "self_signed", 20: "untrusted_chain", 21: "untrusted_chain", 23: "revoked", 62: "hostname_mismatch"}
EXPIRING_DAYS = 14
FINGERPRINTS = ["cloudflare", "captcha", "generic_block", "login_wall", "thin"]


def phrases(html: Column, known: list[str]) -> Column:
    """Those of the known phrases that a page has, in their order."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.filter(F.array(*[F.lit(x) for x in known]), lambda p: F.contains(low, p))


def compare_identities(fetches: DataFrame) -> DataFrame:
    """One row per URL from rows per URL and identity ('browser', 'bot'): what the bot got against what the browser got.

    ``status`` is null for a fetch that never completed; ``allowed`` is false for one that was not made. What was not
    measured stays null.
    """
    keep = ["status", "allowed", "length", *FINGERPRINTS]
    sides = [fetches.where(F.col("identity") == i).select("url", F.struct(*keep).alias(i)) for i in ("browser", "bot")]
    j = sides[0].join(sides[1], "url", "full_outer")

    def f(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(False))

    def ok(side: str, top: int) -> Column:
        return F.coalesce(F.col(f"{side}.status").between(200, top), F.lit(False))

    both = F.col("browser.status").isNotNull() & F.col("bot.status").isNotNull()
    differs = F.lit(False)
    for name in FINGERPRINTS:
        differs = differs | ~F.col(f"browser.{name}").eqNullSafe(F.col(f"bot.{name}"))
    return j.select(
        "url",
        F.col("browser.status").alias("browser_status"),
        F.col("bot.status").alias("bot_status"),
        F.when(both, F.col("browser.status") == F.col("bot.status")).alias("status_match"),
        F.when(both, F.abs(F.col("browser.length") - F.col("bot.length"))).alias("length_diff"),
        F.when(both, differs).alias("fingerprints_differ"),
        (F.coalesce(F.col("bot.status").isin(401, 403), F.lit(False)) | f("bot", "generic_block")).alias("bot_blocked"),
        ((f("bot", "cloudflare") & ~f("browser", "cloudflare")) | (f("bot", "captcha") & ~f("browser", "captcha"))).alias("bot_challenged"),
        (ok("bot", 299) & ok("browser", 299) & f("bot", "thin") & ~f("browser", "thin")).alias("bot_soft_blocked"),
        (F.coalesce(F.col("bot.status") == 429, F.lit(False)) | F.coalesce(F.col("browser.status") == 429, F.lit(False))).alias("rate_limited"),
        (ok("browser", 399) & F.col("bot.status").isNull() & F.coalesce(F.col("bot.allowed"), F.lit(True))).alias("bot_never_completed"),
        (~F.coalesce(F.col("bot.allowed"), F.lit(True))).alias("bot_not_allowed"),
    )


def directives(pages: DataFrame, ev: DataFrame) -> DataFrame:
    """(page_id, ...): robots directives of a page and its headers (a map column), and what it calls itself."""
    a = F.col("attrs")
    meta = (F.col("kind") == "start") & (F.col("tag") == "meta") & F.lower(F.trim(a["name"])).isin(ROBOTS_META)
    content = F.when(meta, F.lower(F.coalesce(a["content"], F.lit(""))))
    canonical = (F.col("kind") == "start") & (F.col("tag") == "link") & F.array_contains(F.split(F.lower(F.coalesce(a["rel"], F.lit(""))), r"\s+"), "canonical")
    got = ev.groupBy("page_id").agg(
        F.array_join(F.collect_list(content), ",").alias("meta"),
        F.count_if(canonical).alias("canonicals"),
        F.max_by(F.when(canonical, a["href"]), F.when(canonical, F.col("seq"))).alias("canonical"),
    )
    j = pages.select("page_id", "url", "headers").join(got, "page_id", "left")
    header = F.lower(F.coalesce(F.element_at(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "x-robots-tag")), 1), F.lit("")))

    def has(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word)) | F.array_contains(F.transform(F.split(text, ","), lambda x: F.trim(x)), "none")

    m = F.coalesce("meta", F.lit(""))
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    c = F.col("canonical")
    full = F.when(F.contains(c, F.lit("://")), c).when(F.startswith(c, F.lit("/")), F.concat(base, c)).otherwise(F.concat(F.regexp_replace("url", r"[^/]*$", ""), c))
    return j.select(
        "page_id",
        has(m, "noindex").alias("noindex_meta"),
        F.coalesce(has(header, "noindex"), F.lit(False)).alias("noindex_header"),
        (has(m, "noindex") | F.coalesce(has(header, "noindex"), F.lit(False))).alias("is_noindex"),
        (has(m, "nofollow") | F.coalesce(has(header, "nofollow"), F.lit(False))).alias("is_nofollow"),
        (F.coalesce("canonicals", F.lit(0)) > 1).alias("duplicate_canonical"),
        F.coalesce((F.coalesce(c, F.lit("")) != "") & (U.normalized(full) != U.normalized(F.col("url"))), F.lit(False)).alias("canonical_differs"),
    )


def certificate(now: Column) -> dict[str, Column]:
    """Facts of a handshake row (reachable, verify_code, not_after): what failed, days left, whether they are few."""
    kind = F.lit(None).cast("string")
    for code, name in VERIFY.items():
        kind = F.when(F.col("verify_code") == code, name).otherwise(kind)
    failed = F.col("verify_code").isNotNull()
    days = F.when(~failed, F.floor((F.unix_timestamp("not_after") - F.unix_timestamp(now)) / 86400))
    return {
        "certificate_valid": F.when(F.col("reachable"), ~failed),
        "failure_kind": F.when(failed, F.coalesce(kind, F.lit("other"))),
        "days_remaining": days.cast("long"),
        "expiring_soon": days <= EXPIRING_DAYS,
    }


def sitemap_failure(status: Column, kind: Column) -> Column:
    """Why a sitemap could not be had, so that refused is not called missing."""
    return (
        F.when(kind == "network", "network_unreachable")
        .when(kind == "invalid_xml_200", "invalid_xml_200")
        .when(kind == "other", "other")
        .when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403), "blocked")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server_error")
        .otherwise("other")
    )


#: An element, an end, or text of XML, whatever the namespace.
_XML = r"<!\[CDATA\[([\s\S]*?)\]\]>|<!--[\s\S]*?-->|<(/?)(?:[\w.-]+:)?([\w.-]+)[^<>]*?(/?)>|([^<]+)"


def _locations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads what there is of each file: an element that never closes costs its own location, not the job."""
    for batch in batches:
        out: list[tuple] = []
        for site, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent, text, seen = "", None, [0, 0]
            for m in re.finditer(_XML, body):
                cdata, closes, name, empty, plain = m.groups()
                if name == "loc" and not closes:
                    text = None if empty else ""
                elif name == "loc" and text is not None:
                    child = parent == "sitemap"
                    out.append((site, seen[child], html.unescape(text).strip(), child))
                    seen[child] += 1
                    text = None
                elif name and name != "loc":
                    parent, text = ("" if closes or empty else name) if name in ("url", "sitemap") else parent, None
                elif text is not None:
                    text += cdata or plain or ""
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((batch.schema.field(0).type, pa.int32(), pa.string(), pa.bool_()))], ["site", "pos", "url", "child"])


def sitemap_locations(files: DataFrame) -> DataFrame:
    """(site, pos, url, child): the locations of (site, body), whatever the namespace; child: of another sitemap.

    XML that is broken gives the locations that can be read; a body that is no XML, none.
    """
    own = files.select("site", F.regexp_replace("body", "^[\ufeff\\s]+", "").alias("xml")).where(F.startswith(F.col("xml"), F.lit("<")))
    return own.mapInArrow(_locations, T.StructType([files.schema["site"], T.StructField("pos", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("child", T.BooleanType())])).where("url <> ''")


def sitemap_kind(locations: DataFrame) -> DataFrame:
    """(site, pages, children, is_index): a file whose pages are nearly all sitemaps is an index too."""
    xml = F.lower("url").rlike(r"\.xml(\.gz)?$")
    n = locations.groupBy("site").agg(F.count_if(~F.col("child")).alias("pages"), F.count_if("child").alias("children"), F.count_if(~F.col("child") & xml).alias("xml_pages"))
    return n.select("site", "pages", "children", ((F.col("children") > 0) | ((F.col("pages") > 0) & (F.col("xml_pages") >= 0.8 * F.col("pages")))).alias("is_index"))


#: Bytes of a body that are inflated, at most: a small body can hold very much.
INFLATED = 10 << 20
#: Bytes of bodies that a task makes before it hands them on, about.
HELD = 4 << 20


def _decoded(data: bytes | None, enc: str | None) -> tuple[str | None, str | None]:
    """Text of a body that is gzipped (by header or by its first bytes), all its members, or deflated; what can be read of a broken one."""
    if data is None:
        return None, None
    enc = (enc or "").lower()
    note = None
    if "gzip" in enc or data[:2] == b"\x1f\x8b":
        data, note = _members(data)
    elif "deflate" in enc:
        engine = zlib.decompressobj(15 if data[:1] == b"\x78" else -15)
        try:
            data = engine.decompress(data, INFLATED)
            note = None if engine.eof else "partial stream"
        except zlib.error:
            data, note = b"", "undecodable body"
    elif enc in ("br", "zstd", "compress"):
        data, note = b"", f"no decoder for {enc}"
    return data.decode("utf-8", errors="replace"), note


def _members(data: bytes) -> tuple[bytes, str | None]:
    """The members of a gzip stream one after another, up to ``INFLATED`` bytes; what follows them that is no member is left out, and said."""
    out, size = [], 0
    while data and size < INFLATED:
        engine = zlib.decompressobj(31)
        try:
            out.append(engine.decompress(data, INFLATED - size))
        except zlib.error:
            return b"".join(out), "undecodable body" if not out else "undecodable rest"
        size += len(out[-1])
        if not engine.eof:
            return b"".join(out), "partial stream"
        data = engine.unused_data.lstrip(b"\0")
    return b"".join(out), "partial stream" if data else None


def _packed(text: str, kind: str) -> tuple[bytes]:
    """A body as servers send it: gzip, gzip in two members, deflate, or as it is."""
    body = text.encode()
    return ({"gzip": lambda: gzip.compress(body, mtime=0), "two members": lambda: gzip.compress(body, mtime=0) * 2, "deflate": lambda: zlib.compress(body)}.get(kind, lambda: body)(),)


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])
#: Text and note of one body, as a column; not in Arrow's batches, which would hold the texts of 10,000 bodies at once.
decoded_body = F.udf(_decoded, _DECODED, useArrow=False)


def _pieces(batches: Iterator[pa.RecordBatch], f: Callable[..., tuple], width: int, kept: list[int], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` and what ``f`` makes of the first ``width`` ones, row by row; handed on as soon as ``HELD`` bytes are there."""
    for batch in batches:
        lo, size, rows = 0, 0, []
        for i in range(len(batch)):
            rows.append(f(*[batch.column(k)[i].as_py() for k in range(width)]))
            size += sum(len(v) for v in rows[-1] if v)
            if size >= HELD or i + 1 == len(batch):
                made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, len(rows)) for k in kept], *made], names=names)
                lo, size, rows = i + 1, 0, []


def decoded_bodies(fetches: DataFrame) -> DataFrame:
    """``fetches`` (raw, encoding, ...) with the text and the note of each body in place of these two.

    A task holds one of Arrow's batches, 64 MB of bodies at most as Spark sets it, and ``HELD`` bytes of texts and one more, whatever these come to.
    """
    others = [c for c in fetches.columns if c not in ("raw", "encoding")]
    schema = T.StructType([*[fetches.schema[c] for c in others], *_DECODED.fields])
    run = lambda batches: _pieces(batches, _decoded, 2, list(range(2, 2 + len(others))), [pa.string(), pa.string()], schema.names)
    return fetches.select("raw", "encoding", *others).mapInArrow(run, schema)


def packed_bodies(pages: DataFrame) -> DataFrame:
    """``pages`` (html, packed, ...) with the body as it is sent, ``raw``, in place of the HTML."""
    others = [c for c in pages.columns if c not in ("html", "packed")]
    schema = T.StructType([pages.schema["packed"], *[pages.schema[c] for c in others], T.StructField("raw", T.BinaryType())])
    run = lambda batches: _pieces(batches, _packed, 2, list(range(1, 2 + len(others))), [pa.binary()], schema.names)
    return pages.select("html", "packed", *others).mapInArrow(run, schema)


def gzipped(text: str) -> bytes:
    return gzip.compress(text.encode(), mtime=0)


def reach(edges: DataFrame, starts: DataFrame, levels: int, allowed: DataFrame | None = None) -> DataFrame:
    """(site, url, depth, parent): the pages within so many clicks of each site's start, breadth first; each level is written, so plans stay small.

    ``edges`` (site, src, dst), ``starts`` (site, url); pages that may not be fetched lead nowhere. One join and one
    anti-join a level; of several parents the least is kept.
    """
    found = starts.select("site", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    frontier = found
    for depth in range(1, levels + 1):
        from_ = frontier if allowed is None else frontier.join(allowed, ["site", "url"], "left_semi")
        step = from_.select("site", F.col("url").alias("src")).join(edges, ["site", "src"]).groupBy("site", F.col("dst").alias("url")).agg(F.min("src").alias("parent"))
        new = step.join(found.select("site", "url"), ["site", "url"], "left_anti").select("site", "url", F.lit(depth).alias("depth"), "parent")
        frontier = written(new, f"reach-{depth}")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def first_problem(pages: DataFrame) -> DataFrame:
    """Of each site's sampled pages (site, pos, url, problem) the first with a problem, else the first."""
    w = Window.partitionBy("site").orderBy(F.when(F.col("problem"), 0).otherwise(1), "pos")
    return pages.withColumn("n", F.row_number().over(w)).where("n = 1").select("site", "url", "problem")


def tls_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VERIFY.items()), "verify_code int, kind string")
