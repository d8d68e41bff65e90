"""Structured data of pages: JSON-LD blocks to nodes, and what the nodes say."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written

#: Types that name who publishes, what a page is about, and page furniture. Fixed values.
IDENTITY = """Organization Corporation LocalBusiness Store Restaurant NGO NewsMediaOrganization EducationalOrganization CollegeOrUniversity School GovernmentOrganization MedicalOrganization
SportsOrganization PerformingGroup Airline OnlineBusiness OnlineStore Brand Person WebSite""".split()
SUBJECT = """Product IndividualProduct SomeProducts ProductGroup Offer AggregateOffer Article NewsArticle BlogPosting TechArticle ScholarlyArticle Report Blog Recipe Event BusinessEvent MusicEvent
ExhibitionEvent SoftwareApplication MobileApplication WebApplication SoftwareSourceCode Service Course JobPosting VideoObject AudioObject Podcast PodcastEpisode Book Dataset FAQPage HowTo QAPage Review
MedicalWebPage RealEstateListing Vehicle Place TouristAttraction""".split()
STRUCTURAL = """PostalAddress ContactPoint GeoCoordinates GeoShape OpeningHoursSpecification QuantitativeValue PropertyValue AggregateRating Rating MonetaryAmount PriceSpecification UnitPriceSpecification
Duration Distance Language DefinedTerm Thing BreadcrumbList ListItem ItemList SiteNavigationElement WebPage CollectionPage ProfilePage AboutPage ContactPage SearchResultsPage CheckoutPage WebPageElement
WPHeader WPFooter WPSideBar SearchAction ReadAction EntryPoint ImageObject""".split()
NOT_DESCRIBABLE = ["WebSite", "Offer", "AggregateOffer", "ListItem"]
DESCRIPTION_MIN = 25
#: Words that say nothing about a topic. Fixed values.
STOPWORDS = """a an the and or but is are was were be been being to of in on at for with by from as that this these those it its you your we our they their he she his her do does did can could will would
should may might not no yes if then so than also about into over more most some any all each other such only just very up down out off have has had there here what which who when where how why""".split()
#: Names that a content system leaves behind. Fixed values.
PLACEHOLDER_AUTHORS = "admin administrator webmaster support unknown anonymous n/a na test testuser guest default user system".split()
#: What each kind of entity should have. Fixed values.
COMPLETE = {
    "organization": (["Organization", "Corporation", "LocalBusiness", "Store", "Restaurant"], ["name", "url", "logo", "telephone"]),
    "article": (["Article", "NewsArticle", "BlogPosting"], ["headline|name", "author", "datePublished", "image"]),
    "recipe": (["Recipe"], ["name", "recipeIngredient", "recipeInstructions", "image"]),
    "event": (["Event", "BusinessEvent", "MusicEvent", "ExhibitionEvent"], ["name", "startDate", "location"]),
    "software": (["SoftwareApplication", "MobileApplication", "WebApplication"], ["name", "operatingSystem", "offers"]),
    "video": (["VideoObject"], ["name", "thumbnailUrl", "uploadDate"]),
}

_OPEN = re.compile(r"<script\b[^>]*ld\+json[^>]*>", re.I)
_LEAD = re.compile(r"(?:\s*(?://|/\*)?\s*<!\[CDATA\[\s*(?:\*/)?|\s*<!--)*")
_WRAPPERS = re.compile(r"^\s*(?:<!--|//\s*<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/|<!\[CDATA\[)|(?:-->|//\s*\]\]>|/\*\s*\]\]>\s*\*/|\]\]>)\s*$")


def json_blocks(page: str) -> list[str]:
    """The JSON of each ld+json script: up to where its first bracket closes, strings respected, else to the script's end."""
    out = []
    for m in _OPEN.finditer(page or ""):
        at, n = _LEAD.match(page, m.end()).end(), len(page)
        stop = page.find("</script", at)
        first = re.compile(r"[{\[]").search(page, at, n)
        if first is None or (stop >= 0 and first.start() > stop):
            body = page[at : stop if stop >= 0 else n]
        else:
            depth, i, quoted, end = 0, first.start(), False, None
            while i < n:
                c = page[i]
                if quoted:
                    if c == "\\":
                        i += 1
                    elif c == '"':
                        quoted = False
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    depth += 1
                elif c in "}]":
                    depth -= 1
                    if not depth:
                        end = i + 1
                        break
                i += 1
            body = page[first.start() : end if end is not None else (stop if stop >= 0 else n)]
        body = _WRAPPERS.sub("", _WRAPPERS.sub("", body)).strip()
        if body:
            out.append(body)
    return out


def lenient(body: str):
    """(value, None) or (None, error): as it stands, with entities decoded, with control characters allowed, with both."""
    error = None
    for text, strict in ((body, True), (html_lib.unescape(body), True), (body, False), (html_lib.unescape(body), False)):
        try:
            return json.loads(text, strict=strict), None
        except (ValueError, RecursionError) as e:
            error = str(e)
    return None, error


def type_names(raw) -> list[str]:
    values = raw if isinstance(raw, list) else [raw]
    return [re.sub(r"^https?://schema\.org/", "", str(v).strip(), flags=re.I).rsplit("/", 1)[-1] for v in values if v]


def _walk(value, found: list) -> None:
    """Every object of a value, outer ones first, however deep."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            found.append(v)
        if isinstance(v, (dict, list)):
            stack += reversed([v[k] for k in sorted(v)] if isinstance(v, dict) else v)  # by name, as Spark keeps an object's fields


NODES = "page_id long, block int, n int, error string, id string, types array<string>, props string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "block", "n", "error", "id", "types", "props"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for b, body in enumerate(json_blocks(page or "")):
                value, error = lenient(body)
                found: list[dict] = []
                _walk(value, found)
                rows.append((page_id, b, -1, error, None, None, None))
                for n, node in enumerate(found):
                    node_id = node.get("@id")
                    rows.append((page_id, b, n, None, node_id if isinstance(node_id, str) else None, type_names(node["@type"]) if node.get("@type") else [], json.dumps(node, ensure_ascii=False)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


#: A block that begins and ends as JSON does once its wrapper is off.
_BLOCK = r"(?is)<script\b[^>]*ld\+json[^>]*>(.*?)</script"
_OPENS = r"(?i)<script\b[^>]*ld\+json[^>]*>"
_BEFORE = r"^\s*(?:<!--|//\s*<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/|<!\[CDATA\[)?\s*"
_AFTER = r"\s*(?:-->|//\s*\]\]>|/\*\s*\]\]>\s*\*/|\]\]>)?\s*$"


def _walked(blocks: DataFrame) -> DataFrame:
    """(page_id, block, n, v) of every object in (page_id, block, v), outer ones first: one step of ``variant_explode`` a level, each written."""
    spark = blocks.sparkSession
    kind = F.schema_of_variant("v")
    level = written(blocks.select("page_id", "block", F.array().cast("array<int>").alias("path"), "v"), "json-0")
    every = level
    while level.where(kind.rlike("^(OBJECT|ARRAY)")).limit(1).count():
        below = spark.sql("select page_id, block, array_append(path, t.pos) as path, t.value as v from {level}, lateral variant_explode(v) t where schema_of_variant(t.value) rlike '^(OBJECT|ARRAY)'", level=level)
        level = written(below, "json")
        every = every.unionByName(level)
    n = F.row_number().over(Window.partitionBy("page_id", "block").orderBy("path")) - 1  # the objects of one block
    return every.where(kind.startswith("OBJECT")).select("page_id", "block", n.cast("int").alias("n"), "v")


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, block, n, error, id, types, props): n is -1 for the block itself, whose error is null if it parsed.

    Blocks are parsed and walked as variants. Only pages with a block that is no JSON as it stands go to Python, which
    mends what it can; pages without blocks go nowhere.
    """
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html")).where(F.lower(html).contains("ld+json"))
    bodies = F.transform(F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1)), lambda b: F.regexp_replace(F.regexp_replace(b, _BEFORE, ""), _AFTER, ""))
    fine = lambda b: b.rlike(r"(?s)^[{\[].*[}\]]$") & F.try_parse_json(b).isNotNull()
    split = own.withColumn("bodies", bodies).withColumn("well", (F.size("bodies") == F.regexp_count("html", F.lit(_OPENS))) & F.forall("bodies", fine))
    split = written(split.select("page_id", "bodies", "well", F.when(~F.col("well"), F.col("html")).alias("html")), "json-blocks")
    blocks = split.where("well").select("page_id", F.posexplode("bodies").alias("block", "body"))
    parsed = blocks.select("page_id", F.col("block").cast("int").alias("block"), F.try_parse_json("body").alias("v"))
    declared = F.expr("try_variant_get(v, \"$['@type']\", 'variant')")
    listed = F.when(F.schema_of_variant(declared).startswith("ARRAY"), F.expr("try_variant_get(v, \"$['@type']\", 'array<string>')")).otherwise(F.array(F.expr("try_variant_get(v, \"$['@type']\", 'string')")))
    bare = F.transform(F.filter(listed, lambda x: x.isNotNull() & (x != "")), lambda x: F.element_at(F.split(F.regexp_replace(F.trim(x), r"(?i)^https?://schema\.org/", ""), "/"), -1))
    types = F.when(declared.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(bare, F.array().cast("array<string>")))
    named = F.when(F.schema_of_variant(F.expr("try_variant_get(v, \"$['@id']\", 'variant')")) == "STRING", F.expr("try_variant_get(v, \"$['@id']\", 'string')"))
    none = F.lit(None).cast("string")
    objects = _walked(parsed).select("page_id", "block", "n", none.alias("error"), named.alias("id"), types.alias("types"), F.to_json("v").alias("props"))
    heads = blocks.select("page_id", F.col("block").cast("int").alias("block"), F.lit(-1).alias("n"), none.alias("error"), none.alias("id"), F.lit(None).cast("array<string>").alias("types"), none.alias("props"))
    return heads.unionByName(objects).unionByName(split.where(~F.col("well")).select("page_id", "html").mapInArrow(_run, NODES))


def nodes_in_python(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The same by the mending parser alone."""
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(_run, NODES)


def entities(n: DataFrame) -> DataFrame:
    return n.where("n >= 0 and size(types) > 0")


def prop(path: str, props: Column | str = "props") -> Column:
    return F.get_json_object(props, f"$['{path}']")


def has(path: str, props: Column | str = "props") -> Column:
    """The property is there and says something; a bar separates alternatives."""
    out = F.lit(False)
    for p in path.split("|"):
        out = out | F.coalesce(~F.trim(prop(p, props)).isin("", "[]", "{}", "false", "0", "null"), F.lit(False))
    return out


def is_a(names: list[str]) -> Column:
    return F.arrays_overlap("types", F.array(*[F.lit(x) for x in names]))


def completeness(e: DataFrame) -> DataFrame:
    """(page_id, block, n, kind, missing): what entities of a known kind lack; nothing lacking gives an empty list."""
    kinds = [F.when(is_a(types), F.struct(F.lit(kind).alias("kind"), F.array_compact(F.array(*[F.when(~has(w), w.split("|")[0]) for w in wanted])).alias("missing"))) for kind, (types, wanted) in COMPLETE.items()]
    return e.select("page_id", "block", "n", F.explode(F.array_compact(F.array(*kinds))).alias("k")).select("page_id", "block", "n", "k.kind", "k.missing")


def listed(path: str) -> Column:
    """A property as an array of JSON texts, whether it is one value or a list."""
    v = prop(path)
    return F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v))


def resolved(rows: DataFrame, n: DataFrame, ref: str) -> DataFrame:
    """Adds ``<ref>_target``: the node that a JSON text refers to by @id within its page, null if none."""
    ids = n.where("id is not null").groupBy("page_id", F.col("id").alias("ref_id")).agg(F.max_by("props", F.struct("block", "n")).alias(f"{ref}_target"))
    key = F.coalesce(F.get_json_object(ref, "$['@id']"), F.col(ref))
    return rows.withColumn("ref_id", key).join(ids, ["page_id", "ref_id"], "left").drop("ref_id")


def offers(e: DataFrame, n: DataFrame) -> DataFrame:
    """(page_id, block, n, has_name, has_offers, price, availability) of products: an offer's own values before those it refers to."""
    p = e.where(is_a(["Product", "IndividualProduct", "SomeProducts"]))
    rows = p.select("page_id", "block", "n", has("name").alias("has_name"), F.posexplode_outer(listed("offers")).alias("pos", "offer"))
    rows = resolved(rows, n, "offer")

    def own(name: str) -> Column:
        return F.coalesce(F.get_json_object("offer", name), F.get_json_object("offer_target", name))

    price = F.coalesce(own("$.priceSpecification.price"), own("$.price"), own("$.lowPrice"), own("$.highPrice"))
    rows = rows.select("page_id", "block", "n", "has_name", "pos", F.col("offer").isNotNull().alias("offered"), price.alias("price"), own("$.availability").alias("availability"))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("pos")))
    return rows.groupBy("page_id", "block", "n").agg(F.first("has_name").alias("has_name"), F.bool_or("offered").alias("has_offers"), first("price").alias("price"), first("availability").alias("availability"))


def role() -> Column:
    """What an entity is to its page."""
    all_structural = F.size(F.array_except("types", F.array(*[F.lit(x) for x in STRUCTURAL]))) == 0
    return F.when(is_a(IDENTITY), "identity").when(is_a(SUBJECT), "subject").when(all_structural, "structural").otherwise("unclassified")


def grounding(e: DataFrame) -> DataFrame:
    """(page_id, identity, subject, structural, unclassified, structural_only): the types in each role."""
    r = e.withColumn("role", role())

    def types(name: str, only: list[str] | None) -> Column:
        own = F.col("types") if only is None else F.array_intersect("types", F.array(*[F.lit(x) for x in only]))
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == name, own)))))

    out = r.groupBy("page_id").agg(types("identity", IDENTITY).alias("identity"), types("subject", SUBJECT).alias("subject"), types("structural", None).alias("structural"), types("unclassified", None).alias("unclassified"))
    return out.withColumn("structural_only", (F.size("identity") == 0) & (F.size("subject") == 0) & (F.size("unclassified") == 0))


def descriptions(e: DataFrame) -> DataFrame:
    """(page_id, describable, described, short, missing): how entities with something to describe do it."""
    able = [t for t in [*IDENTITY, *SUBJECT] if t not in NOT_DESCRIBABLE]
    raw = prop("description")
    text = F.trim(F.regexp_replace(F.coalesce(F.when(F.startswith(raw, F.lit("{")), F.coalesce(F.get_json_object("props", "$.description['@value']"), F.get_json_object("props", "$.description.name"))).when(F.startswith(raw, F.lit("[")), F.get_json_object("props", "$.description[0]")).otherwise(raw), F.lit("")), r"\s+", " "))
    rows = e.where(is_a(able)).select("page_id", F.get("types", F.lit(0)).alias("type"), F.length(text).alias("n"))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("describable"), F.count_if(F.col("n") >= DESCRIPTION_MIN).alias("described"), F.count_if((F.col("n") > 0) & (F.col("n") < DESCRIPTION_MIN)).alias("short"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") == 0, F.col("type")))), ",").alias("missing")
    )


def significant(text: Column) -> Column:
    """The distinct words of a text that may carry its topic."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(x) for x in STOPWORDS]))


def rough_text(html: Column) -> Column:
    """What a page may show, without parsing it: scripts, styles, comments and tags gone. Entities stay as they are."""
    t = html
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), "<[^>]+>", " ")


def overlap(words: Column, page_words: Column) -> Column:
    return F.size(F.array_intersect(words, page_words)) / F.size(words)


def faq_pairs(e: DataFrame, n: DataFrame) -> DataFrame:
    """(page_id, block, n, pos, question, answer): questions of FAQ pages, references resolved."""
    rows = e.where(is_a(["FAQPage"])).select("page_id", "block", "n", F.posexplode(listed("mainEntity")).alias("pos", "q"))
    rows = resolved(rows, n, "q")
    get = lambda p: F.coalesce(F.get_json_object("q", p), F.get_json_object("q_target", p))
    rows = resolved(rows.withColumn("question", get("$.name")).withColumn("a", get("$.acceptedAnswer")), n, "a")
    return rows.select("page_id", "block", "n", "pos", F.nullif("question", F.lit("")).alias("question"), F.nullif(F.coalesce(F.get_json_object("a", "$.text"), F.get_json_object("a_target", "$.text")), F.lit("")).alias("answer"))


def faq_overlap(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, question, ratio): answers that share hardly a word with their page; answers and pages too short are left out."""
    words = pages.select("page_id", significant(rough_text(F.col("html"))).alias("page_words")).where("size(page_words) >= 20")
    own = pairs.where("question is not null and answer is not null").withColumn("words", significant(F.col("answer"))).where("size(words) >= 4")
    return own.join(words, "page_id").withColumn("ratio", F.bround(overlap(F.col("words"), F.col("page_words")), 3)).where("ratio < 0.25").select("page_id", "question", "ratio")


def contact_mismatches(e: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, field, value): telephone numbers and addresses of organisations that their page does not show."""
    text = rough_text(F.col("html"))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[+(]?\d[\d\-.()\s]{6,}\d"), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", ""))
    p = pages.select("page_id", significant(text).alias("page_words"), F.filter(numbers, lambda x: F.length(x) >= 7).alias("numbers")).where("size(page_words) >= 20")
    org = e.where(is_a(COMPLETE["organization"][0]))
    address = F.when(F.startswith(prop("address"), F.lit("{")), F.concat_ws(" ", *[F.get_json_object("props", f"$.address.{k}") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")])).otherwise(prop("address"))
    j = org.select("page_id", prop("telephone").alias("telephone"), address.alias("address")).join(p, "page_id")
    digits = F.regexp_replace("telephone", r"\D", "")
    shown = F.exists("numbers", lambda x: F.contains(x, digits) | F.contains(digits, x))
    phones = j.where(F.length(digits) >= 7).where(~shown).select("page_id", F.lit("telephone").alias("field"), F.col("telephone").alias("value"))
    words = significant(F.col("address"))
    places = j.where(F.size(words) >= 3).where(overlap(words, F.col("page_words")) < 0.3).select("page_id", F.lit("address").alias("field"), F.col("address").alias("value"))
    return phones.unionByName(places)


def authors(e: DataFrame) -> DataFrame:
    """(page_id, block, n, names, placeholder): who articles say wrote them, and whether that is a system's default only."""
    rows = e.where(is_a(COMPLETE["article"][0])).select("page_id", "block", "n", listed("author").alias("a"))
    names = F.filter(F.transform(F.coalesce("a", F.array().cast("array<string>")), lambda x: F.trim(F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.name")).otherwise(x))), lambda x: x.isNotNull() & (x != ""))
    known = F.array(*[F.lit(x) for x in PLACEHOLDER_AUTHORS])
    return rows.withColumn("names", names).select("page_id", "block", "n", "names", ((F.size("names") > 0) & F.forall("names", lambda x: F.array_contains(known, F.lower(x)))).alias("placeholder"))


#: How availability is written. Fixed values.
AVAILABILITY = {"http://schema.org/instock": "in stock", "https://schema.org/instock": "in stock", "instock": "in stock", "in stock": "in stock", "available": "in stock", "http://schema.org/outofstock": "out of stock", "https://schema.org/outofstock": "out of stock", "outofstock": "out of stock", "out of stock": "out of stock", "http://schema.org/preorder": "pre order", "https://schema.org/preorder": "pre order", "preorder": "pre order", "pre order": "pre order"}


def price_value(raw: Column) -> Column:
    """A price as a number, whichever of point and comma separates its cents."""
    s = F.trim(raw)
    continental = s.rlike(r"\.[0-9]{3},[0-9]{2}$")
    plain = F.when(continental, F.translate(s, ".,", " .")).otherwise(F.replace(s, F.lit(","), F.lit("")))
    return F.regexp_replace(plain, "[^0-9.]", "").try_cast("double")


#: Words that a fact's wording may lack. Fixed values.
FACT_STOPWORDS = "a an the and or in on at to for with by of https http com www schema org".split()


def fact_shown(value: Column, text: Column) -> Column:
    """Whether a page's text states a fact: by its usual wording, as it is, by its number, or by most of its words."""
    v, t = F.lower(F.trim(value)), F.lower(text)
    wording = F.create_map(*[F.lit(x) for kv in AVAILABILITY.items() for x in kv])[v]
    number = F.regexp_extract(v, r"[0-9]+(?:\.[0-9]+)?", 0)
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    words = F.array_except(tokens(v), F.array(*[F.lit(x) for x in FACT_STOPWORDS]))
    shared = F.size(F.array_intersect(words, tokens(t)))
    said = F.coalesce(F.contains(t, wording), F.lit(False)) | F.contains(t, v) | F.contains(t, F.replace(v, F.lit("_"), F.lit(" ")))
    return F.coalesce((v != "") & (t != "") & (said | ((number != "") & F.contains(t, number)) | ((F.size(words) > 0) & (shared >= 0.7 * F.size(words)))), F.lit(False))


def consistency(facts: DataFrame) -> DataFrame:
    """(page_id, evaluated, verified, ratio, inconsistent) from (page_id, value, text): null values are no facts."""
    f = facts.where("value is not null").withColumn("shown", fact_shown(F.col("value"), F.col("text")))
    c = f.groupBy("page_id").agg(F.count("*").alias("evaluated"), F.count_if("shown").alias("verified"))
    c = c.withColumn("ratio", F.bround(F.col("verified") / F.col("evaluated"), 2))
    return c.withColumn("inconsistent", (F.col("evaluated") >= 3) & (F.col("ratio") < 0.5))
