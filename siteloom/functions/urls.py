"""URL functions as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"

#: ISO 639-1 codes. Fixed values.
LANGUAGES = """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es
et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj
kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv
ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti
tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
""".split()
#: File endings that are no pages. Fixed values.
NON_PAGE = "pdf jpg jpeg png gif webp svg avif ico xml gz zip rar 7z mp3 mp4 webm mov wav txt json csv doc docx xls xlsx ppt pptx css js woff woff2 ttf".split()
#: Second-level labels under which names are registered. Fixed values.
SECOND_LEVEL = "co com org net gov ac edu".split()


def _full(url: Column) -> Column:
    s = F.trim(url)
    return F.when(F.contains(s, F.lit("://")), s).otherwise(F.concat(F.lit("https://"), s))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_full(url), _SPLIT, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(_full(url), _SPLIT, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(_full(url), _SPLIT, 3)


def without_dots(url: Column) -> Column:
    """An absolute URL whose path has its dot segments resolved, as RFC 3986 has it."""
    head, own, tail = (F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    segs = F.split(own, "/")

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(segs, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(segs, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(own.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, F.array_join(kept, "/"), tail)).otherwise(url)


def path_of_absolute(url: Column) -> Column:
    """The path of a URL that names its scheme; of a bare path, itself without query and fragment."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, _SPLIT, 3)).otherwise(F.regexp_extract(url, r"^[^?#]*", 0))


def query(url: Column) -> Column:
    """With its question mark; empty without one."""
    return F.regexp_extract(_full(url), _SPLIT, 4)


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normalized(url: Column) -> Column:
    """Host (with a port, without www) and path, in lower case, without trailing slashes; empty for nothing."""
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.lower(F.concat(without_www(authority(url)), F.regexp_replace(path(url), "/+$", ""))))


def host(url: Column) -> Column:
    """The host without www and port; empty where there is none."""
    return F.coalesce(without_www(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")), F.lit(""))


def registrable(h: Column) -> Column:
    """The last two labels of a host, three below a second-level label such as co."""
    parts = F.split(F.regexp_replace(F.lower(h), r"^\.+|\.+$", ""), r"\.")
    n = F.size(parts)
    three = (n >= 3) & F.get(parts, n - 2).isin(SECOND_LEVEL)
    return F.when(n <= 2, F.array_join(parts, ".")).when(three, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def host_is(h: Column, target: Column) -> Column:
    """The host is the target or below it."""
    return (h != "") & (target != "") & ((h == target) | F.endswith(h, F.concat(F.lit("."), target)))


def same_or_below(a: Column, b: Column) -> Column:
    """Either host is the other or below it."""
    return host_is(a, b) | host_is(b, a)


def navigational(href: Column) -> Column:
    return (href != "") & ~href.rlike(r"^(?:javascript:|mailto:|tel:|#)")


def segments(p: Column) -> Column:
    return F.filter(F.split(F.coalesce(p, F.lit("")), "/"), lambda s: s != "")


def is_locale(segment: Column) -> Column:
    code = F.lower(F.regexp_extract(segment, r"^([A-Za-z]{2})(?:[-_](?:[A-Za-z]{2}|[0-9]{3}|[A-Za-z]{4}))?$", 1))
    return code.isin(LANGUAGES)


def folders(url: Column) -> Column:
    """struct(depth, ignored): path folders that mean something, and those that do not.

    Not counted are a file at the end, a locale in front, years, and months or days once a year has come.
    """
    segs = segments(path_of_absolute(url))
    n = F.size(segs)
    segs = F.when((n > 0) & F.contains(F.element_at(segs, -1), F.lit(".")), F.slice(segs, 1, F.greatest(n - 1, F.lit(0)))).otherwise(segs)
    start = F.struct(F.lit(0).cast("long").alias("depth"), F.array().cast("array<string>").alias("ignored"), F.lit(False).alias("year"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        locale = (acc["i"] == 0) & is_locale(s)
        year = s.rlike(r"^(?:19|20)[0-9]{2}$")
        day = acc["year"] & s.rlike(r"^(?:0[1-9]|[12][0-9]|3[01])$")
        note = F.when(locale, F.concat(s, F.lit(" (locale)"))).when(year, F.concat(s, F.lit(" (year)"))).when(day, F.concat(s, F.lit(" (month/day)")))
        return F.struct(
            (acc["depth"] + F.when(note.isNull(), 1).otherwise(0)).cast("long").alias("depth"),
            F.when(note.isNull(), acc["ignored"]).otherwise(F.concat(acc["ignored"], F.array(note))).alias("ignored"),
            (acc["year"] | (~locale & year)).alias("year"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(segs, start, step, lambda a: F.struct(a["depth"].alias("depth"), a["ignored"].alias("ignored")))


def group(url: Column) -> Column:
    """struct(name, depth): which template a URL probably belongs to."""
    segs = segments(path(url))
    n = F.size(segs)
    name = F.when(n == 0, "(homepage)").when(n == 1, "(top-level pages)").otherwise(F.concat(F.lit("/"), F.get(segs, F.lit(0)), F.lit("/")))
    return F.struct(name.alias("name"), n.cast("long").alias("depth"))


def is_page(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(r"\.(?:" + "|".join(NON_PAGE) + ")$")


def long_tail(url: Column) -> Column:
    """A last segment of five hyphens or 40 characters, or three segments and more."""
    segs = segments(path(url))
    last = F.element_at(segs, -1)
    return F.when(F.size(segs) == 0, False).otherwise((F.size(segs) >= 3) | (F.length(last) >= 40) | ((F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit("")))) >= 5))


def short_root(url: Column) -> Column:
    """No path, or one segment of at most five characters."""
    segs = segments(path(url))
    return (F.size(segs) == 0) | ((F.size(segs) == 1) & (F.length(F.get(segs, F.lit(0))) <= 5))


def named_root(url: Column) -> Column:
    """As ``short_root``, or a start page's usual name."""
    segs = segments(F.lower(path(url)))
    return short_root(url) | ((F.size(segs) == 1) & F.get(segs, F.lit(0)).isin("index.html", "index.htm", "index.php", "home"))


def page_key(url: Column) -> Column:
    """Host and path, which name a page whatever its query."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(without_www(authority(url)), F.when(p == "", "/").otherwise(p))


def path_and_query(url: Column) -> Column:
    """What crawler rules are matched against."""
    u = F.coalesce(F.nullif(url, F.lit("")), F.lit("/"))
    p = F.regexp_extract(u, _SPLIT, 3)
    q = F.regexp_extract(u, _SPLIT, 4)
    full = F.concat(F.when(p == "", "/").otherwise(p), F.when(q == "?", "").otherwise(q))
    return F.when(F.contains(u, F.lit("://")), full).when(F.startswith(u, F.lit("/")), u).otherwise(F.concat(F.lit("/"), u))


def stem(url: Column) -> Column:
    """The file name without its ending."""
    name = F.element_at(F.split(F.regexp_replace(path_of_absolute(url), "/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def product_token(agent: Column) -> Column:
    return F.lower(F.trim(F.get(F.split(F.coalesce(agent, F.lit("")), "/"), F.lit(0))))
