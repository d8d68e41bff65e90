"""Conversation structure repair: cheapest edits to the grammar ``(s?(ua)+)?`` of role initials.

A conversation's rows get their places from one range sort of the whole table, so a conversation of any length is cut
into pieces of ``PIECE`` rows that lie anywhere. Pieces are dealt by hash; in each batch of them a DuckDB recursive query
advances one turn of all pieces at a time and keeps, for each grammar state a piece may start in and each that it is in
now, the minimum cost and its least audit. A piece then is one step of its conversation: the same query goes over steps
until one is left for each conversation. Edits are costed by row, so of two equally cheap audits of the same rows none is
the beginning of the other, and the least of a whole is made of the least of its parts.

States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. Audits hold D(elete), I(nsert), K(eep), R(erole).

Result for odd input: nulls count as one space (a null conv_id is one conversation, and stays null in the result); rows
of one turn are ordered by role, then text; rows that repeat are duplicates after the first; a conversation without
rows after damage has zeros, an empty audit and the hash of an empty string; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .importance import CRC, CRC_TABLE
from .shared import discard, materialize, partitions, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Steps of a piece, a power of two; steps that one DuckDB query goes over, at least.
PIECE, BATCH = 128, 1 << 14
BLANKS = " \t\n\x0b\x0c\r"
#: (state, initial, state after): what the grammar lets follow.
GRAMMAR = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3))
_STEPS = "g string, piece long, at long, first string, last string, illegal long, moves array<struct<src:int,dst:int,cost:long,audit:string,path:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """(g, conv_id, turn, role, text, n): rows after damage, n times each; g is the conversation's key."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    x = F.crc32(F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), x.alias("x")).where("x <> 0")
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("x") == 4, "user").otherwise(F.col("role"))
    return rows.select(key.alias("g"), "conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("x") == 3, 2).otherwise(1).alias("n"))


def placed(rows: DataFrame) -> DataFrame:
    """One row for equal rows, with their number and an ``id`` that orders the table by conversation, turn, role, text."""
    one = rows.groupBy("g", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = [F.col("g"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = one.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.withColumn("id", F.monotonically_increasing_id())


def faults(rows: DataFrame) -> DataFrame:
    """(g, id, n, role, blank, duplicate, truncated) of placed rows: flags of their first copy's first fault.

    Further copies are duplicates, unless blank.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    slim = rows.select("g", "id", "n", "role", said.alias("said"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    earliest = slim.groupBy("g", "said").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))  # ids are spread evenly, whatever is said
    flags = slim.join(earliest, "id", "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    return flags.select("g", "id", "n", "role", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("cut")).alias("truncated"))


#: One recursion advances all pieces by a step; ``steps`` and ``moves`` are the batch's.
_FOLD = """
with recursive sizes as (select unit, count(*) as n from steps group by unit),
best(unit, place, src, state, w) as (
    select unit, 0::bigint, s::int, s::int, {'cost': 0::bigint, 'audit': '', 'path': ''} from sizes, range(4) r(s)
    union all
    select unit, place, src, dst, min(w) from (
        select b.unit, b.place + 1 as place, b.src, m.dst, {'cost': b.w.cost + m.cost, 'audit': b.w.audit || m.audit, 'path': b.w.path || m.dst} as w
        from best b join moves m on m.unit = b.unit and m.place = b.place and m.src = b.state) group by unit, place, src, dst),
ends as (select unit, list({'src': src, 'dst': state, 'cost': w.cost, 'audit': w.audit, 'path': w.path} order by src, state) as moves from best join sizes using (unit) where place = n group by unit),
beside as (select *, lag(last) over (partition by unit order by place) as before from steps),
seen as (select unit, min_by(first, place) as first, max_by(last, place) as last, sum(illegal + case when before is not null and before || first not in ('su', 'ua', 'au') then 1 else 0 end) as illegal from beside group by unit)
select unit, first, last, illegal::bigint as illegal, moves from seen join ends using (unit) order by unit"""

#: The moves of single rows: what follows of a row's initial and faults.
_ROW_MOVES = f"""
with edges(src, initial, dst) as (values {", ".join(map(str, GRAMMAR))}),
inserted as (select src, initial as i, dst from edges where initial in ('u', 'a')),
via as (select src, src as now, '' as audit, 0 as cost from (select distinct src from edges) union all select src, dst, 'I', {INSERT} from inserted),
used as (
    select unit, place, v.src, e.dst, v.cost + {KEEP} + case when truncated then {TRUNCATED} else 0 end as cost, v.audit || 'K' as audit, copies from rows r join edges e on e.initial = r.first join via v on v.now = e.src where not deleted
    union all
    select unit, place, v.src, e.dst, v.cost + {REROLE} + case when truncated then {TRUNCATED} else 0 end, v.audit || 'R', copies from rows r, edges e join via v on v.now = e.src where not deleted and e.initial in ('u', 'a')
    union all
    select unit, place, s::int, s::int, {DELETE}, 'D', copies from rows r, range(4) t(s))
select unit, place, src, dst, (cost + {DELETE} * (copies - 1))::bigint as cost, audit || repeat('D', copies - 1) as audit from used"""


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over steps sorted by (g, piece, at): one step for each piece."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})

    def folded(part: pa.Table) -> pa.RecordBatch:
        n = part.num_rows
        con.register("part", part.add_column(0, "row", pa.array(range(n), pa.int64())))
        con.execute("create or replace temp table units as select *, dense_rank() over (order by g, piece) as unit, row_number() over (partition by g, piece order by \"at\") - 1 as place from part")
        if "moves" in part.column_names:
            con.execute("create or replace temp table steps as select unit, place, first, last, illegal from units")
            con.execute("create or replace temp table moves as select unit, place, m.src, m.dst, m.cost, m.audit from (select unit, place, unnest(moves) as m from units)")
        else:
            con.execute("create or replace temp table rows as select unit, place, role[1] as first, n::int as copies, truncated, blank or duplicate as deleted from units")
            con.execute("create or replace temp table steps as select unit, place, first, first as last, copies - 1 as illegal from rows")
            con.execute("create or replace temp table moves as " + _ROW_MOVES)
        con.execute(f"create or replace temp table folded as {_FOLD}")
        out = con.sql("select g, piece, \"at\", first, last, illegal, moves from folded join (select unit, g, piece, min(\"at\") as \"at\" from units group by all) using (unit) order by unit").to_arrow_table()
        con.unregister("part")
        return out

    held: list[pa.Table] = []
    schema = None
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows = sum(t.num_rows for t in held)
        if rows < BATCH:
            continue
        whole = pa.concat_tables(held)
        g, piece = whole.column("g"), whole.column("piece")
        last = (g[rows - 1], piece[rows - 1])
        cut = rows
        while cut and (g[cut - 1], piece[cut - 1]) == last:  # the last piece may go on; it has PIECE steps at most
            cut -= 1
        if cut:
            yield from _shaped(folded(whole.slice(0, cut)))
        held = [whole.slice(cut)]
    if held and sum(t.num_rows for t in held):
        yield from _shaped(folded(pa.concat_tables(held)))


_MOVES = pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))
_SHAPE = pa.schema([("g", pa.string()), ("piece", pa.int64()), ("at", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("moves", _MOVES)])


def _shaped(t: pa.Table) -> list[pa.RecordBatch]:
    return t.cast(_SHAPE).combine_chunks().to_batches()


def _pieces(steps: DataFrame) -> DataFrame:
    ordered = steps.repartition(partitions(steps.sparkSession), "g", "piece").sortWithinPartitions("g", "piece", "at")
    return ordered.mapInArrow(_fold, _STEPS)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces of conversations that have several, with ``k``, their place in the conversation.

    Places in a partition of the range sort follow from ids; only one row for each partition and conversation is summed up over.
    """
    part = F.shiftright("piece", 33 - PIECE.bit_length() + 1)
    spans = pieces.groupBy("g", part.alias("part")).agg(F.min("piece").alias("least"), F.count("*").alias("n"))
    before = spans.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("of", F.sum("n").over(Window.partitionBy("g"))).where("of > 1").select("g", "part", "least", "before")
    return pieces.withColumn("part", part).join(before, ["g", "part"]).withColumn("k", F.col("before") + F.col("piece") - F.col("least")).drop("part", "least", "before")


#: The cheapest way from nothing to an end, an insertion at the end included.
_BEST = f"array_min(transform(filter(moves, m -> m.src = 0), m -> struct(m.cost + case m.dst when 2 then {INSERT} when 1 then {2 * INSERT} else 0 end as cost, concat(m.audit, case m.dst when 2 then 'I' when 1 then 'II' else '' end) as audit, m.dst as dst, m.path as path)))"


def repaired_structure(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows with faults: (g, illegal, cost, audit) of each conversation, and (g, id, src, audit) of each of its pieces.

    A piece's id is that of its first row; src is the state that the cheapest way is in there; the audit of the last
    piece includes what is inserted after it.
    """
    steps = rows.withColumnRenamed("id", "at").withColumn("piece", F.shiftright("at", PIECE.bit_length() - 1))
    pieces = materialize(_pieces(steps.select("g", "piece", "at", "n", "role", "blank", "duplicate", "truncated")), "pieces")
    numbered = materialize(_numbered(pieces), "numbered")
    levels = [numbered.select("g", F.col("k").alias("piece"), "at", "first", "last", "illegal", "moves")]
    while levels[-1].where("piece > 0").limit(1).count():
        now = levels[-1].select("g", F.col("piece").alias("at"), F.shiftright("piece", PIECE.bit_length() - 1).alias("piece"), "first", "last", "illegal", "moves")
        levels.append(materialize(_pieces(now), "pieces"))
    alone = pieces.join(numbered.select("g").distinct(), "g", "left_anti")
    tops = alone.select("g", "illegal", F.expr(_BEST).alias("b")).unionByName(levels[-1].select("g", "illegal", F.expr(_BEST).alias("b")))
    # Down again: each level's path names the states between its steps.
    chosen = levels[-1].select("g", F.lit(0).cast("long").alias("piece"), F.lit(0).alias("src"), F.expr(_BEST).alias("b")).select("g", "piece", "src", F.col("b.dst").alias("dst"), F.col("b.path").alias("path"))
    for level in reversed(levels[:-1]):
        states = chosen.select("g", "piece", "src", F.posexplode(F.split("path", "")).alias("i", "to"), "path").where("to <> ''")
        step = states.select("g", (F.col("piece") * PIECE + F.col("i")).alias("piece"), F.when(F.col("i") == 0, F.col("src")).otherwise(F.substring("path", F.col("i"), F.lit(1)).cast("int")).alias("src"), F.col("to").cast("int").alias("dst"))
        met = level.join(step, ["g", "piece"])
        chosen = met.select("g", "piece", "at", "src", "dst", F.expr("filter(moves, m -> m.src = src and m.dst = dst)[0]").alias("m")).select("g", "piece", "at", "src", "dst", F.col("m.path").alias("path"), F.col("m.audit").alias("audit"))
    parts = alone.select("g", F.col("at").alias("id"), F.lit(0).alias("src"), F.expr(_BEST)["audit"].alias("audit"))
    if len(levels) > 1:
        parts = parts.unionByName(chosen.select("g", F.col("at").alias("id"), "src", "audit"))
    return tops.select("g", "illegal", F.col("b.cost").alias("cost"), F.col("b.audit").alias("audit")), parts


def _spoken(digest: bool):
    """Over rows and piece marks, sorted by (g, id, mark first): the repaired messages as they stream by, or their hash."""
    after = {"s": 1, "u": 2, "a": 3}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sha = None
        audit, at, state, place = "", 0, 0, 0
        out: list[tuple] = []

        def say(role: str, text: str, keep: bool) -> None:
            nonlocal state, place
            state = after[role[0]]
            if digest:
                sha.update((("\n" if place else "") + role + ":" + text).encode())
            else:
                out.append((g, place, role, text, keep))
            place += 1

        def turn() -> str:
            return "assistant" if state == 2 else "user"

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                say(turn(), "", False)
                at += 1

        def ended() -> None:
            inserts()
            if g is not None and state == 2:  # a piece's end is its conversation's: what is inserted there is in no audit of several pieces
                say("assistant", "", False)
            elif g is not None and state == 1:
                say("user", "", False)
                say("assistant", "", False)
            if g is not None and digest:
                out.append((g, sha.hexdigest()))

        def flushed() -> pa.RecordBatch:
            names = ["g", "repaired_sha256"] if digest else ["g", "place", "role", "text", "original"]
            b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
            out.clear()
            return b

        for batch in batches:
            for own, mark, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("g", "audit", "role", "text", "n")), strict=True):
                if own != g:
                    ended()
                    g, audit, at, state, place = own, "", 0, 0, 0
                    sha = hashlib.sha256()
                if mark is not None:
                    inserts()
                    audit, at = mark, 0
                    continue
                inserts()
                letter = audit[at]
                at += n
                if letter != "D":
                    say(role if letter == "K" else turn(), text, True)
            if out:
                yield flushed()
        ended()
        if out:
            yield flushed()

    return run


def _stream(rows: DataFrame, parts: DataFrame) -> DataFrame:
    marks = parts.select("g", "id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    own = rows.select("g", "id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "role", "text", F.col("n").cast("long").alias("n"))
    return own.unionByName(marks).repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "id", "kind").select("g", "audit", "role", "text", "n")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, original) of the messages of undamaged conversations after repair; original is false where one was inserted."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = conversations.select(key.alias("g"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("n"))
    rows = materialize(placed(rows), "turns")
    parts = repaired_structure(faults(rows))[1]
    said = _stream(rows, parts).mapInArrow(_spoken(False), "g string, place long, role string, text string, original boolean")
    ids = rows.select("g", "conv_id").distinct()
    return said.join(ids, "g").select("conv_id", "place", "role", "text", "original")


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the damaged table: its faults, the cheapest repair and a hash of what it comes to."""
    all_ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("g"), "conv_id").distinct()
    rows = materialize(placed(damaged(conversations)), "turns")
    flagged = materialize(faults(rows), "faults")
    turns = rows.groupBy("g").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    n = F.col("n")
    counts = flagged.groupBy("g").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("duplicate"), n).when(~F.col("blank"), n - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    tops, parts = repaired_structure(flagged)
    hashes = _stream(rows, parts).mapInArrow(_spoken(True), "g string, repaired_sha256 string")
    out = all_ids.join(turns, "g", "left").join(counts, "g", "left").join(tops, "g", "left").join(hashes, "g", "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    """The same for DuckDB, by one recursion over turns of whole conversations."""
    edges = ", ".join(map(str, GRAMMAR))
    ws = "'[^\\x20\\x09-\\x0D]'"
    return f"""
    with recursive {CRC_TABLE},
    keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as k from conversations),
    x as (select conv_id, turn, role, text, {CRC.format("k")} % 20 as x from keyed cross join crc),
    y as (select conv_id, turn, case when x = 4 then 'user' else role end as role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when x = 3 then 2 else 1 end)) as copy from x where x <> 0),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again from y),
    f as (select *, substr(role, 1, 1) as c, not regexp_matches(text, {ws}) as blank, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) as tail from o),
    v as (select *, not blank and again > 1 as dup, not blank and again = 1 and tail not in ('.', '!', '?') as cut, lag(c) over (partition by conv_id order by i) as before from f),
    sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated,
                    count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal, count(*) as n from v group by conv_id),
    edges(src, c, dst) as (values {edges}),
    best(conv_id, i, state, w) as (
        select conv_id, 0::bigint, 0, {{'cost': 0, 'audit': '', 'said': ''}} from sums
        union all
        select conv_id, i, dst, min(w) from (
            select b.conv_id, v.i, e.dst, {{'cost': b.w.cost + h.cost + case when v.c = e.c then {KEEP} else {REROLE} end + case when v.cut then {TRUNCATED} else 0 end, 'audit': b.w.audit || h.audit || case when v.c = e.c then 'K' else 'R' end,
                   'said': b.w.said || h.said || chr(10) || case when v.c = e.c then v.role when e.c = 'u' then 'user' else 'assistant' end || ':' || v.text}} as w
            from best b join v on v.conv_id is not distinct from b.conv_id and v.i = b.i + 1 and not v.blank and not v.dup
            join (select src, src as now, 0 as cost, '' as audit, '' as said from (select distinct src from edges)
                  union all select src, dst, {INSERT}, 'I', chr(10) || case when c = 'u' then 'user:' else 'assistant:' end from edges where c <> 's') h on h.src = b.state
            join edges e on e.src = h.now and (e.c <> 's' or v.c = 's')
            union all
            select b.conv_id, v.i, b.state, {{'cost': b.w.cost + {DELETE}, 'audit': b.w.audit || 'D', 'said': b.w.said}} from best b join v on v.conv_id is not distinct from b.conv_id and v.i = b.i + 1
        ) group by conv_id, i, dst),
    ends as (select b.conv_id, min(case b.state when 2 then {{'cost': w.cost + {INSERT}, 'audit': w.audit || 'I', 'said': w.said || chr(10) || 'assistant:'}} else w end) as w from best b join sums s on s.conv_id is not distinct from b.conv_id and s.n = b.i where b.state <> 1 group by b.conv_id)
    select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(w.cost, 0)::bigint as cost, coalesce(w.audit, '') as audit, sha256(coalesce(substr(w.said, 2), '')) as repaired_sha256
    from (select distinct conv_id from conversations) d left join sums s on d.conv_id is not distinct from s.conv_id left join ends e on d.conv_id is not distinct from e.conv_id"""
