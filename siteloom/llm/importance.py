"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of words. Each document's features are counted where it lies; their strings are counted over the
corpus and over the target texts; each distinct string is hashed once, and buckets add up its counts. A bucket's gain
is the log ratio of its smoothed shares; strings take their bucket's gain, and gains come back to the documents'
feature counts. A weight is the floored mean gain; Gumbel noise from a hash of the id turns weights into a draw
without replacement of the documents with the highest scores.

Strings that make up over 1 / ``COMMON`` of all occurrences - fewer than ``COMMON`` of them, whatever the size - meet
their gains by broadcast, where the document lies; only the others are shuffled, and none of those is hot.

Result for odd input: null and word-less texts have no features and weight 0 and are not drawn; rows that repeat each
have a row and a rank; a null doc_id counts as an empty one in the noise and comes last among equal scores; without
target texts, or without documents, all counts are smoothed ones; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, partitions, sql, table

#: Words of a feature at most, buckets, seed of the noise, words that a drawn document has at least, percent drawn.
RUN, BUCKETS, SEED, LEAST, SHARE = 1, 10000, 2024, 20, 10
#: Strings with a share over 1 / COMMON of all occurrences are common.
COMMON = 1 << 16
#: Features that a task gathers before it sends them on.
FLUSH = 1 << 16
#: Bytes that are part of words stay, with A-Z lower-cased; all others end a word. Bytes from 0x80 are parts of letters.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO).split()


def feature_counts(texts: DataFrame, run: int = RUN) -> DataFrame:
    """(d, feature, n, doc_id) of each distinct feature of a row; one row more with a null feature, whose n is the number of words.

    ``texts`` has doc_id and text; d numbers its rows, and doc_id stands in the row without a feature only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]

        def flushed() -> pa.RecordBatch:
            d, feature, n, doc = held
            out = pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(feature, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(doc, pa.int64())], ["d", "feature", "n", "doc_id"])
            for x in held:
                x.clear()
            return out

        for batch in batches:
            for d, doc, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                d, doc, own = d.as_py(), doc.as_py(), words(text.as_py())
                seen = Counter(own)
                for k in range(2, run + 1):
                    seen.update(b" ".join(own[i : i + k]) for i in range(len(own) - k + 1))
                held[0] += [d] * (len(seen) + 1)
                held[1] += [None, *seen]
                held[2] += [len(own), *seen.values()]
                held[3] += [doc] + [None] * len(seen)
                if len(held[0]) >= FLUSH:
                    yield flushed()
        if held[0]:
            yield flushed()

    rows = texts.select(F.monotonically_increasing_id().alias("d"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "d long, feature string, n long, doc_id long")


def dictionary(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, s, gain) of each distinct string of the documents' ``counts``; s is its number of occurrences.

    ``target`` are the counts of the target texts.
    """
    spark = counts.sparkSession
    strings = sql(
        spark,
        f"""
        with both as (select feature, n as s, 0L as t from {{counts}} where feature is not null union all select feature, 0L as s, n as t from {{target}} where feature is not null),
        one as (select feature, sum(s) as s, sum(t) as t from both group by feature)
        select feature, s, t, crc32(encode(feature, 'UTF-8')) % {buckets} as bucket from one""",
        counts=counts,
        target=target,
    )
    strings = materialize(strings, "strings")
    return sql(
        spark,
        f"""
        with b as (select bucket, sum(s) as s, sum(t) as t from {{strings}} group by bucket),
        z as (select *, sum(s) over () as all_s, sum(t) over () as all_t from b),
        g as (select bucket, cast(floor(1000e0 * ln((t + 1e0) * (all_s + {buckets}e0) / ((s + 1e0) * (all_t + {buckets}e0)))) as bigint) as gain from z)
        select /*+ broadcast(g) */ feature, s, gain from {{strings}} d join g on d.bucket = g.bucket where s > 0""",  # b, z and g have a row a bucket
        strings=strings,
    )


def weighted(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(d, doc_id, n_words, n_features, weight): a row for each row of ``docs``, numbered by d."""
    spark = docs.sparkSession
    counts = materialize(feature_counts(docs, run), "feature-counts")
    known = materialize(dictionary(counts, feature_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), run), buckets), "dictionary")
    total = known.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    common, rare = known.where(F.col("s") > total // COMMON), known.where(F.col("s") <= total // COMMON)  # fewer than COMMON strings; the rest
    met = sql(
        spark,
        """
        select /*+ broadcast(k) */ c.d, c.n, c.n * k.gain as gained, null as doc_id, 0L as words from {counts} c join {common} k on c.feature = k.feature
        union all
        select r.d, r.n, r.n * k.gain as gained, null as doc_id, 0L as words
        from (select /*+ broadcast(k) */ c.d, c.feature, c.n from {counts} c left anti join {common} k on c.feature = k.feature where c.feature is not null) r join {rare} k on r.feature = k.feature
        union all
        select d, 0L as n, 0L as gained, doc_id, n as words from {counts} where feature is null""",
        counts=counts,
        common=common,
        rare=rare,
    )
    return sql(
        spark,
        """
        with x as (select d, sum(n) as n, sum(gained) as gained, max(doc_id) as doc_id, sum(words) as words from {met} group by d)
        select d, doc_id, words as n_words, n as n_features, case when n = 0 then 0L else (gained - pmod(gained, n)) div n end as weight from x""",
        met=met,
    )


def resampled(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Drawn are ``share`` percent of the documents with at least ``least`` words: those with the highest scores, ties to
    the smaller doc_id. Ranks are places in a range sort of the drawn alone.
    """
    spark = docs.sparkSession
    scored = sql(
        spark,
        f"""
        with h as (select *, cast(conv(substring(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as bigint) as h from {{weighted}})
        select d, doc_id, n_words, n_features, weight, weight + cast(floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) as bigint) as score from h""",
        weighted=weighted(docs, target, run, buckets),
    )
    rows = materialize(scored, "scored")
    # Scores are whole numbers in a narrow range: the least one drawn follows from the number of documents at each.
    least_drawn = sql(
        spark,
        f"""
        with n as (select score, count(*) as n from {{rows}} where n_words >= {least} group by score),
        c as (select score, sum(n) over (order by score desc) as so_far, sum(n) over () as of_all from n)
        select max(of_all) * {share} div 100 as drawn, max(case when so_far >= of_all * {share} div 100 then score end) as least from c""",
        rows=rows,
    ).first()
    drawn, floor = least_drawn["drawn"] or 0, least_drawn["least"]
    in_reach = (F.col("n_words") >= least) & (F.col("score") >= F.lit(floor)) if drawn else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("d")]
    ranked = rows.where(in_reach).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranked = materialize(ranked, "drawn")
    out = sql(
        spark,
        f"""
        with p as (select shiftright(place, 33) as part, count(*) as n from {{ranked}} group by 1),
        o as (select part, sum(n) over (order by part) - n as before from p)
        select /*+ broadcast(o) */ doc_id, n_features, weight, score, o.before + (place & 8589934591L) + 1 as rank from {{ranked}} r join o on shiftright(r.place, 33) = o.part""",  # o: a row a partition
        ranked=ranked,
    )
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~in_reach).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: CTEs of DuckDB SQL for crc32: its table by rule, and the checksum of a string column named in the place of {}.
CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as ubigint), cast(range(8) as ubigint[])), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc)"
CRC = "cast(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: cast('0x' || x as ubigint))), lambda c, b: xor(c >> 8, crc[cast(xor(c, b) & 255 as bigint) + 1])), 4294967295) as bigint)"


def oracle() -> str:
    """The same for DuckDB; rows that repeat apart."""
    split = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with {CRC_TABLE},
    d as (select doc_id, coalesce({split}, []) as w from documents),
    u as (select doc_id, unnest(w) as feature from d),
    s as (select feature, count(*) as n from u group by feature),
    t as (select feature, count(*) as n from (select unnest({split}) as feature from benchmark) group by feature),
    one as (select feature, coalesce(s.n, 0) as s, coalesce(t.n, 0) as t from s full join t using (feature)),
    k as (select feature, s, t, {CRC.format("feature")} % {BUCKETS} as bucket from one cross join crc),
    b as (select bucket, sum(s) as s, sum(t) as t from k group by bucket),
    z as (select sum(s) as all_s, sum(t) as all_t from b),
    g as (select bucket, cast(floor(1000::double * ln((t + 1)::double * (all_s + {BUCKETS})::double / ((s + 1)::double * (all_t + {BUCKETS})::double))) as bigint) as gain from b cross join z),
    m as (select doc_id, count(*) as n, sum(gain) as gained from u join k using (feature) join g using (bucket) group by doc_id),
    w as (select d.doc_id, len(w) as n_features, cast(coalesce((gained - ((gained % n) + n) % n) // n, 0) as bigint) as weight from d left join m on d.doc_id is not distinct from m.doc_id),
    x as (select *, weight + cast(floor(-1000::double * ln(-ln((cast('0x' || substr(sha256(concat('{SEED}:', doc_id)), 1, 8) as bigint) + 0.5)::double / 4294967296::double))) as bigint) as score from w),
    r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from x where n_features >= {LEAST})
    select x.doc_id, x.n_features, weight, score, case when rank <= n * {SHARE} // 100 then rank end as rank from x left join r on x.doc_id is not distinct from r.doc_id"""
