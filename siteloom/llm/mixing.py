"""Mixing sources to target weights by a low-discrepancy source schedule, in SQL functions only.

Result for odd input: a null text has size 0; a null source is a source of its own, ordered last; rows that repeat
are each a document; a null doc_id is shuffled like an empty name; sources without words have target 0; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, partitions, sql, table

#: Words of a block, and slots of a chunk in which ranks are counted on their own.
BLOCK, CHUNK = 512, 4096
#: 2**31 over the golden ratio, odd: multiples of it modulo 2**31 are the schedule's points.
GOLDEN, SPAN = 1327217885, 2147483648
#: Stretches of the unit interval by which points meet the sources' intervals: so many at least, and so many slots of each at most.
STRETCHES, CROWD = 1024, 65536
WEIGHTS = (3, 1, 2)
#: Slots of the schedule, for all sources together.
_SLOTS = f"cast(floor(cast(total as double) * 1.02e0 / {BLOCK}) as bigint) + 257"
WORD = r"[^\x20\x09-\x0D]+"


def _weight_case(weights: tuple[int, ...]) -> str:
    return f"case sidx % {len(weights)} " + " ".join(f"when {i} then {w}" for i, w in enumerate(weights)) + " end"


def source_targets_sql(sized: str, weights: tuple[int, ...], share: float, cap: float) -> str:
    """CTEs that end in ``src``: each source's target, by which a common level fills all sources up to their caps.

    Sources in order of cap over weight: the level that fills the rest when all before are full, at the first source
    that it does not overfill, is what repeated resharing by weight comes to.
    """
    order = "order by cap / w, sidx rows between unbounded preceding and 1 preceding"
    return f"""
    by_source as (select source, sum(size) as s from {sized} group by source),
    numbered as (select source, s, row_number() over (order by source asc nulls last) - 1 as sidx from by_source),
    weighed as (select *, {_weight_case(weights)} as w, cast(s as double) * {cap}e0 as cap from numbered),
    filled as (select *, coalesce(sum(s) over ({order}), 0) as s_before, coalesce(sum(w) over ({order}), 0) as w_before,
                      sum(s) over () as s_all, sum(w) over () as w_all from weighed),
    levels as (select *, (cast(s_all as double) * {share}e0 - cast(s_before as double) * {cap}e0) / cast(w_all - w_before as double) as level from filled),
    chosen as (select level as common from levels where level <= cap / w order by cap / w, sidx limit 1),
    src0 as (select source, sidx, s as source_size, least(cap, common * w) as target, cast(floor(least(cap, common * w)) as bigint) as most from weighed cross join chosen),
    src as (select *, sum(most) over (order by sidx) - most as lo, sum(most) over (order by sidx) as hi, sum(most) over () as total from src0)"""


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot) of every document.

    Slot i takes the source in whose stretch of the cumulative targets the point frac(i / golden ratio) falls, and its
    rank there names the block it takes: a source's documents, shuffled by a hash of their doc_id and laid end to end
    as often as needed, cut into blocks of equal words. The last block of a source is cut at its target. In the order
    of slots, which ``first_slot`` has for each document that is taken, any run of blocks has the sources by their targets. Blocks below
    a target that got no slot, as those of a small source beside large ones may, have slots after all others.
    Ranks and running sums are counted in chunks first and then shifted by the sums of the chunks before, so no task
    holds a source. Slots come of one row, from which the planner would take them for few: hints keep their joins
    from broadcasting them.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    sized = materialize(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hk")), "sizes")
    src = materialize(sql(spark, f"with {source_targets_sql('{sized}', weights, share, cap)} select * from src", sized=sized), "targets")
    total = src.agg(F.max("total")).first()[0] or 0
    stretches = STRETCHES
    while stretches * CROWD < total // BLOCK and stretches < 1 << 22:
        stretches *= 2
    # One row to chunks, chunks dealt out, chunks to slots: points are made where they are used.
    chunks = sql(
        spark,
        f"""select explode(sequence(cast(0 as bigint), cast(floor(slots / {CHUNK}) as bigint))) as chunk, slots, total
            from (select max(total) as total, {_SLOTS.replace("total", "max(total)")} as slots from {{src}}) where total > 0""",
        src=src,
    ).repartition(n, "chunk")
    slots = sql(
        spark,
        f"""
        with points as (select i, chunk, pmod(i, {SPAN}) * {GOLDEN} % {SPAN} as x, total
                        from (select chunk, slots, total, explode(sequence(chunk * {CHUNK}, chunk * {CHUNK} + {CHUNK - 1})) as i from {{chunks}}) where i < slots),
        at as (select i, chunk, cast(x as double) / {SPAN} * cast(total as double) as p, cast(floor(x / {SPAN // stretches}) as bigint) as stretch from points),
        spans as (select sidx, lo, hi, explode(sequence(greatest(cast(0 as bigint), cast(floor(cast(lo as double) / total * {stretches}) as bigint) - 1), least(cast({stretches - 1} as bigint), cast(floor(cast(hi as double) / total * {stretches}) as bigint) + 1))) as stretch
                  from {{src}} where most > 0)
        select /*+ MERGE(at, spans) */ sidx, i, chunk from at join spans using (stretch) where p >= lo and p < hi""",
        chunks=chunks,
        src=src,
    )
    ranked = sql(
        spark,
        """
        with n as (select sidx, chunk, count(*) as n from {slots} group by sidx, chunk),
        o as (select sidx, chunk, sum(n) over (partition by sidx order by chunk) - n as before from n)
        select /*+ MERGE(s, o) */ s.sidx, s.i as slot, o.before + row_number() over (partition by s.sidx, s.chunk order by s.i) - 1 as blk from {slots} s join o on s.sidx = o.sidx and s.chunk = o.chunk""",
        slots=slots,
    )
    ranked = materialize(ranked, "slots")
    # Blocks that the points left out, a range at the end of each source.
    late = sql(
        spark,
        f"""
        with n as (select sidx, count(*) as n from {{ranked}} group by sidx),
        m as (select s.sidx, s.total, coalesce(n.n, 0) as had, greatest(cast(0 as bigint), cast(ceil(s.most / {BLOCK}) as bigint) - coalesce(n.n, 0)) as lacks from {{src}} s left join n on s.sidx = n.sidx where s.most > 0),
        o as (select *, {_SLOTS} + sum(lacks) over (order by sidx) - lacks as first from m)
        select sidx, first + k as slot, had + k as blk from (select *, explode(sequence(cast(0 as bigint), lacks - 1)) as k from o where lacks > 0)""",
        ranked=ranked,
        src=src,
    )
    ranked = ranked.unionByName(late)
    placed = sql(
        spark,
        """
        with d as (select t.doc_id, t.size, t.hk, substring(t.hk, 1, 3) as g, s.sidx from {sized} t join {src} s on t.source <=> s.source),
        n as (select sidx, g, sum(size) as n from d group by sidx, g),
        o as (select sidx, g, sum(n) over (partition by sidx order by g) - n as before from n)
        select d.sidx, d.g, d.doc_id, d.size, row_number() over w as rn, o.before + (sum(d.size) over w) - d.size as at
        from d join o on d.sidx = o.sidx and d.g = o.g window w as (partition by d.sidx, d.g order by d.hk, d.doc_id, d.size rows between unbounded preceding and current row)""",
        sized=sized,
        src=src,
    )
    taken = sql(
        spark,
        f"""
        with p as (select /*+ BROADCAST(e) */ d.*, s.most, d.at + e.epoch * s.source_size as lo from {{placed}} d join {{src}} s on d.sidx = s.sidx cross join (select explode(sequence(0, {int(-(-cap // 1)) - 1})) as epoch) e),
        q as (select *, least(lo + size, most) as hi from p),
        b as (select sidx, g, rn, doc_id, size, lo, hi, explode_outer(case when hi > lo then sequence(cast(floor(lo / {BLOCK}) as bigint), cast(floor((hi - 1) / {BLOCK}) as bigint)) end) as blk from q),
        t as (select /*+ MERGE(b, r) */ b.sidx, b.g, b.rn, b.doc_id, b.size, case when r.blk is null then 0 else least(b.hi, (b.blk + 1) * {BLOCK}) - greatest(b.lo, b.blk * {BLOCK}) end as got, r.slot
              from b left join {{ranked}} r on b.sidx = r.sidx and b.blk = r.blk)
        select sidx, doc_id, size, sum(got) as taken, min(slot) as first_slot from t group by sidx, g, rn, doc_id, size""",
        placed=placed,
        src=src,
        ranked=ranked,
    )
    return sql(spark, "select t.doc_id, s.source, t.size, s.source_size, s.target, cast(t.taken as bigint) as taken, t.first_slot from {taken} t join {src} s on t.sidx = s.sidx", taken=taken, src=src)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each time the mix takes a document; the columns stay.

    A document taken in part, as the last of a source is, comes with as many of its first words, joined by a space, and
    ``n_chars``, where there is one, is that of what comes. So the words of a source are those that the mix takes.
    """
    plan = mix_sources(docs).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.floor(F.sum("taken") / F.count("*")).alias("taken"))
    own = docs.select(F.struct(*docs.columns).alias("d"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    met = own.join(plan, own["d.doc_id"].eqNullSafe(plan["doc_id"]) & own["d.source"].eqNullSafe(plan["source"]) & (own["n"] == plan["size"]))
    met = met.select("d", F.expr("taken % size").alias("rest"), F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")).alias("copy"), F.expr("cast(ceil(taken / size) as int)").alias("copies"))
    part = F.col("copy").eqNullSafe(F.col("copies")) & (F.col("rest") > 0)
    words = F.array_join(F.slice(F.filter(F.split("d.text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col("rest").cast("int")), " ")
    text = F.when(part, words).otherwise(F.col("d.text"))
    n_chars = lambda c: F.when(part, F.length(text)).otherwise(F.col("d.n_chars")).cast(docs.schema[c].dataType)
    return met.select(*[text.alias(c) if c == "text" else n_chars(c).alias(c) if c == "n_chars" else F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def oracle() -> str:
    """The same mix for DuckDB: global windows in place of chunks."""
    return f"""
    with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as hk from documents),
    {source_targets_sql("sized", WEIGHTS, 1.5, 2.0)},
    n as (select cast(max(total) as bigint) as total, cast(floor(cast(max(total) as double) * 1.02e0 / {BLOCK}) as bigint) + 257 as slots from src),
    points as (select i, (i % {SPAN}) * {GOLDEN} % {SPAN} as x, total from (select unnest(range(slots)) as i, total from n where total > 0)),
    falls as (select i, cast(x as double) / {SPAN} * cast(total as double) as p from points),
    ranked as (select s.sidx, i, row_number() over (partition by s.sidx order by i) - 1 as blk from falls join src s on p >= s.lo and p < s.hi),
    had as (select s.sidx, count(r.i) as had, greatest(0, cast(ceil(s.most / {BLOCK}) as bigint) - count(r.i)) as lacks from src s left join ranked r on r.sidx = s.sidx where s.most > 0 group by s.sidx, s.most),
    late as (select sidx, first + k as i, had + k as blk from (select *, unnest(range(lacks)) as k from (select had.*, slots + cast(sum(lacks) over (order by sidx) as bigint) - lacks as first from had, n))),
    scheduled as (select sidx, i, blk from ranked union all select sidx, i, blk from late),
    placed as (select d.doc_id, d.size, s.*, row_number() over (order by d.hk, d.doc_id, d.size) as rn, sum(d.size) over (partition by s.sidx order by d.hk, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as start
               from sized d join src s on d.source is not distinct from s.source),
    spread as (select *, start + e.epoch * source_size as a, least(start + e.epoch * source_size + size, most) as b from placed cross join (select unnest([0, 1]) as epoch) e),
    blocks as (select *, unnest(case when b > a then range(cast(a // {BLOCK} as bigint), cast((b - 1) // {BLOCK} + 1 as bigint)) else [] end) as blk from spread where b > a),
    got as (select rn, sum(least(b, (x.blk + 1) * {BLOCK}) - greatest(a, x.blk * {BLOCK})) as taken, min(r.i) as first_slot from blocks x join scheduled r on x.sidx = r.sidx and x.blk = r.blk group by rn)
    select doc_id, size, cast(source_size as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken, first_slot from placed left join got using (rn)"""
