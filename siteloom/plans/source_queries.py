"""Queries over the project's own sources and over the supplied event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path
from ..sources import seeds
from ..streaming import recordings
from .page_queries import BANDS, path_intent
from .registry import pages, query

#: What is recorded of each page, by its number: a code or a word, and how often it was sent on.
_STATES = ["200", "timeout", "301", "404", "robots_skipped"]


def page_recordings(p: DataFrame) -> DataFrame:
    """Pages as recordings: every one by two identities, with statuses and redirects of all kinds."""
    status = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.pmod("page_id", F.lit(len(_STATES))) + 1).cast("int"))
    both = p.select("page_id", "url", "html", F.explode(F.array(F.lit("browser"), F.lit("bot"))).alias("identity"))
    return both.select("page_id", "url", "identity", F.when(F.col("identity") == "browser", F.lit("200")).otherwise(status).alias("status"), F.col("url").alias("final_url"), F.pmod("page_id", F.lit(13)).cast("int").alias("redirects"), F.col("html").alias("content"))


@query(
    "recorded_fetches",
    f"""with r as (select page_id, url, html, identity, case when identity = 'browser' then '200' else ([{", ".join(f"'{s}'" for s in _STATES)}])[page_id % {len(_STATES)} + 1] end as status, cast(page_id % 13 as int) as redirects from pages, (values ('browser'), ('bot')) as i(identity))
    select url, identity, case when redirects <= 10 then try_cast(status as int) end as status, case when redirects > 10 then 'too_many_redirects' when try_cast(status as int) is null then status end as state, least(length(html), 500000) as chars, redirects from r""",
)
def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of every page, made in two batches of files and read as a stream that is stopped and started again in between."""
    folder, out, marks = (new_path(spark, f"recordings-{x}") for x in ("in", "out", "marks"))
    rows = page_recordings(pages(spark, sf_dir))
    for batch in (0, 1):
        rows.where(F.pmod("page_id", F.lit(2)) == batch).drop("page_id").write.mode("append").json(folder)
        recordings.into_table(spark, folder, out, marks)
    return spark.read.schema(recordings.FETCH_SCHEMA).parquet(out).select("url", "identity", "status", "state", F.length("content").alias("chars"), "redirects")


@query("word_bands", f"""with b as (select * from (values {", ".join(f"('{n}', {w})" for n, w in BANDS)}) as t(intent, advisory)) select p.page_id, b.advisory from pages p join b on b.intent = case when regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1) in ('', '/') then 'homepage' else 'content' end""")
def word_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that are advised for each page, by the kind of page that its path says it is."""
    p = pages(spark, sf_dir).select("page_id", F.coalesce(path_intent(F.col("url")), F.lit("content")).alias("intent"))
    return p.join(seeds.lookup(spark, "word_bands"), "intent").select("page_id", "advisory")


@query(
    "document_contacts",
    r"select doc_id, cast(len(regexp_extract_all(text, '[+(]?\d[\d\-.()\s]{6,}\d')) as bigint) as phone_like, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as bigint) as mail_like from documents",
)
def document_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone-shaped and address-shaped texts of every document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda rx: F.regexp_count("text", F.lit(rx)).cast("long")
    return d.select("doc_id", count(r"[+(]?\d[\d\-.()\s]{6,}\d").alias("phone_like"), count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").alias("mail_like"))


@query(
    "document_sentences",
    r"""with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[\x01\n]+')) as s from documents), t as (select doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from s)
    select doc_id, count(*) as sentences from t where length(s) >= 25 and len(string_split(s, ' ')) >= 4 and not regexp_matches(s, '[{}<>|\\]|\)\s*;|=>|function\s*\(') group by doc_id""",
)
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of 25 characters and four words a document has, code left out."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    ok = F.filter(raw, lambda s: (F.length(s) >= 25) & (F.size(F.split(s, " ")) >= 4) & ~s.rlike(r"[{}<>|\\]|\)\s*;|=>|function\s*\("))
    return d.select("doc_id", F.size(ok).cast("long").alias("sentences")).where("sentences > 0")
