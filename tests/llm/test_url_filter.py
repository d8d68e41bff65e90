"""The URL filter against plain Python."""

import re

from siteloom.llm import url_filter

URLS = [
    "https://WWW.Spam.example.NET/en/1/?utm_source=x&b=2&a=1#top",
    "http://spam.example.net/en/1?a=1&b=2&ref=z",
    "http://spam.example.net/en/1?a=1&b=3",
    "https://a.example.org/es/4",
    "https://example.org/en/12",
    "https://badexample.org/en/12",
    "https://x.com/de/",
    "https://x.com/de",
    "https://x.com/fr/a?q",
    "https://com/de/1",
    "ftp://host#x/y",
    "no scheme",
    "a://b://c/d",
    "://",
    "https://ÜX.Example.net/É/ß?é=1",
    "https://h.net/" + "x/" * 20000,
    "",
    None,
]
LISTED = ["http://spam.example.net/en/1?b=2&a=1", "https://h.net/" + "x/" * 20000, None, "nothing", "https://x.com/de/", "https://x.com/de"]
ADDED = "host string, path string, canonical string, rule string, verdict string, block string, key string, w0 string"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    asked = re.match(r"[^?#]*\?([^#]*)", rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    kept = sorted(p for p in (asked[1].split("&") if asked else []) if p and not re.match(r"(ref|utm_[^=]*)(=|\Z)", p))
    return host, path, (host.removeprefix("www.") + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")) if host else None


def verdict(url, listed):
    host, path, canonical = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if canonical and canonical in listed else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, *"abcdefgh") for i, u in enumerate(urls)], f"page_id long, url string, {ADDED}")


def check(spark, urls, listed, **more):
    got = url_filter.judged(pages(spark, urls), spark.createDataFrame([(u, 1) for u in listed], "key string, n int"), **more).collect()
    names = {parts(u)[2] for u in listed}
    assert sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in got) == sorted(((i, *verdict(u, names)) for i, u in enumerate(urls)), key=lambda x: x[0])
    assert {x.block for x in got} <= {"f"}
    return got


def test_equals_plain(spark):
    got = check(spark, URLS, LISTED)
    assert [x.verdict for x in sorted(got, key=lambda x: x.page_id)][:3] == ["block", "block", "allow"]


def test_a_full_filter_changes_nothing(spark):
    """One block for 400 listed URLs passes nearly all others to the join."""
    urls = [f"https://h{i % 7}.example.net/p/{i}" for i in range(2000)] + ["https://hot.example.net/x"] * 1000
    check(spark, urls, [u for i, u in enumerate(urls[:2000]) if i % 5 == 0] + ["http://hot.example.net/x/"], most_blocks=1)


def test_the_filter_forgets_nothing_and_passes_few_others(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) as key")
    blocks = 20000 * url_filter.BITS // 512
    bits = {r[0]: r[1:] for r in url_filter.bloom_filter(keys, "key", blocks).collect()}
    asked = spark.range(40000).selectExpr("concat('k', id) as key").select("key", url_filter._place("key", blocks).alias("b"), *[url_filter._bit("key", i).alias(f"b{i}") for i in range(url_filter.WORDS)]).collect()
    hits = [all(w & b for w, b in zip(bits.get(r[1], [0] * 8), r[2:], strict=True)) for r in asked]
    assert all(hits[i] for i, r in enumerate(asked) if int(r[0][1:]) < 20000)
    assert sum(hits) - 20000 < 200


def test_empty(spark):
    none = spark.createDataFrame([], "url string")
    assert url_filter.judged(pages(spark, URLS).where("false"), none).collect() == []
    check(spark, URLS, [])
    got = url_filter.judged(pages(spark, URLS), spark.createDataFrame([("https://x.com/fr/a?q",)], "u string"), rules=()).collect()
    assert {x.url for x in got if x.verdict == "block"} == {"https://x.com/fr/a?q"}
