"""Personal data and the terms that give it away, in SQL functions only.

Base spans come from four patterns. Outside of them, corpus co-occurrence estimates how much of a protected entity
(one address, number or card) a term reveals: PMI(term; entity) over the entity's own information -log2 p(entity), both
counted over whole documents. A term that reveals at least ``THRESHOLD`` of it, seen with it in at least ``SUPPORT``
unlike texts that are at least ``SURE`` of the documents it stands in, is a span wherever it stands, in documents
without the entity too. Copies of one text are no evidence: all their rare words come together. Redaction puts a kind's name in place of
base spans; revealing terms are generalised to their shape (a number, a name) or removed.

Result for odd input: null and empty texts have no spans; rows that repeat have the same spans each (where a term
stands, and how many documents there are, is counted by row; what holds an entity, by text); a null doc_id is a
document named null; an empty table gives an empty result; extra columns are ignored by ``find_spans`` and kept by
``redact``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, sql, table

KINDS = ("email", "ip", "card", "phone")
SUPPORT, THRESHOLD, SURE = 2, 0.8, 0.75
#: Equal in what they match to the plain patterns, but never tried twice over one run of characters: a match can only
#: begin where a run does or where the last one ended, and no part is given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern can't match.
HINTS = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'", "card": r"text rlike '[0-9](?:[\\x20-]?[0-9]){12}'", "phone": "contains(text, '+')"}
#: What RE2 takes; the counts of digits are checked afterwards, as above.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What a text with a base span fulfils.
_MAY_HOLD = " or ".join("({} and text rlike '{}')".format(HINTS[k], PATTERNS[k].replace("\\", "\\\\")) for k in KINDS)

_VALID = r"""case kind
    when 'email' then true
    when 'ip' then hit rlike '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.|$)){4}$'
    when 'phone' then length(digits) between 9 and 15
    else length(digits) between 13 and 19 and aggregate(transform(sequence(1, greatest(length(digits), 1)), i -> cast(substring(digits, length(digits) + 1 - i, 1) as int) * (case when i % 2 = 0 then 2 else 1 end)), 0, (a, x) -> a + x - (case when x > 9 then 9 else 0 end)) % 10 = 0
  end"""


def _base(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, hit, digits) of every valid base span; th tells texts of one doc_id apart.

    The lengths of what lies between matches, summed, are the places of the matches; sums run over rows of one text.
    """
    parts = []
    for kind in KINDS:
        p = PATTERNS[kind].replace("\\", "\\\\")
        parts.append(f"struct('{kind}' as kind, case when {HINTS[kind]} then regexp_extract_all(text, '{p}', 0) end as hits, case when {HINTS[kind]} then split(text, '{p}', -1) end as gaps)")
    found = sql(
        spark,
        f"""
        with k as (select doc_id, xxhash64(text) as th, explode(array({", ".join(parts)})) as k from {{docs}} where text is not null),
        z as (select doc_id, th, k.kind as kind, posexplode(transform(k.hits, (h, i) -> struct(h as hit, length(k.gaps[i]) as gap))) as (k, m) from k where size(k.hits) > 0)
        select distinct doc_id, th, kind, k, m.hit as hit, m.gap as gap from z""",
        docs=docs,
    )
    return sql(
        spark,
        f"""
        with s as (select *, sum(gap + length(hit)) over (partition by doc_id, th, kind order by k) as end, regexp_replace(hit, '[^0-9]', '') as digits from {{found}})
        select doc_id, th, kind, end - length(hit) as start, end, hit, digits from s where {_VALID}""",
        found=found,
    )


def spans_of_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of every document."""
    spark = docs.sparkSession
    spans = find_spans(docs)
    return sql(
        spark,
        """
        with s as (select doc_id, th, sort_array(collect_set(struct(case kind when 'email' then 0 when 'ip' then 1 when 'card' then 2 when 'phone' then 3 else 4 end as o, start, end, kind))) as spans from {spans} group by doc_id, th),
        d as (select doc_id, xxhash64(text) as th from {docs}),
        j as (select d.doc_id, coalesce(s.spans, array()) as spans from d left join s on d.doc_id <=> s.doc_id and d.th = s.th)
        select doc_id, cast(size(filter(spans, x -> x.o = 0)) as bigint) as n_email, cast(size(filter(spans, x -> x.o = 1)) as bigint) as n_ip,
               cast(size(filter(spans, x -> x.o = 2)) as bigint) as n_card, cast(size(filter(spans, x -> x.o = 3)) as bigint) as n_phone,
               cast(size(filter(spans, x -> x.o = 4)) as bigint) as n_term,
               sha2(array_join(transform(filter(spans, x -> x.o < 4), x -> concat_ws(':', x.kind, x.start, x.end)), ','), 256) as base_sha256,
               array_join(transform(spans, x -> concat_ws(':', x.kind, x.start, x.end)), ',') as spans
        from j""",
        spans=spans,
        docs=docs.select("doc_id", "text"),
    )


def _merged(spans: DataFrame) -> DataFrame:
    """(doc_id, th, spans) of every text with spans: overlapping spans are one, named after the first."""
    return sql(
        spans.sparkSession,
        """
        with o as (select distinct doc_id, th, kind, start, end from {spans}),
        b as (select *, coalesce(max(end) over (partition by doc_id, th order by start, end desc, kind rows between unbounded preceding and 1 preceding), -1) as before from o),
        g as (select *, sum(case when start >= before then 1 else 0 end) over (partition by doc_id, th order by start, end desc, kind) as grp from b),
        m as (select doc_id, th, grp, min(start) as start, max(end) as end, min_by(kind, struct(start, -end, kind)) as kind from g group by doc_id, th, grp)
        select doc_id, th, sort_array(collect_list(struct(start, end, kind))) as spans from m group by doc_id, th""",
        spans=spans,
    )


#: What lies before, between and after the spans of a text.
_GAPS = "transform(sequence(0, size(spans)), i -> substring(text, cast(case when i = 0 then 0 else spans[i - 1].end end + 1 as int), cast(case when i = size(spans) then length(text) else spans[i].start end - case when i = 0 then 0 else spans[i - 1].end end as int)))"


def _hashes(text: str) -> str:
    """The distinct terms of a text, by a 64-bit hash."""
    return f"array_distinct(transform(regexp_extract_all({text}, '[\\\\p{{L}}\\\\p{{N}}]{{3,}}', 0), t -> xxhash64(lower(t))))"


def _revealing(docs: DataFrame, base: DataFrame, covered: DataFrame, threshold: float, support: int) -> DataFrame:
    """(doc_id, th, hs): the revealing terms in each text that has any, by hash.

    A term is counted where it stands outside of base spans, once a document; term and entity together, and the entity,
    once for equal texts. Only texts with base spans are read with these taken out; the counts of all texts are put
    right by what differs there.
    """
    spark = docs.sparkSession
    entity = "concat(kind, ':', case when kind = 'email' or kind = 'ip' then lower(hit) else digits end)"
    entities = sql(spark, f"select distinct th, xxhash64({entity}) as e from {{base}}", base=base)
    counts = materialize(sql(spark, f"select e, count(*) as n from {{entities}} group by e having count(*) >= {support}", entities=entities), "entities")
    protected = sql(
        spark,
        f"""
        with e as (select th, collect_list(struct(x.e, c.n)) as entities from {{entities}} x join {{counts}} c on x.e = c.e group by th),
        d as (select c.th, c.spans, d.text from (select * from {{docs}} where {_MAY_HOLD}) d join {{covered}} c on d.doc_id <=> c.doc_id and xxhash64(d.text) = c.th),
        t as (select th, first(spans) as spans, first(text) as text, count(*) as rows from d group by th)
        select t.th, t.rows, e.entities, {_hashes("text")} as was, {_hashes(f"array_join({_GAPS}, ' ')")} as terms from t left join e on t.th = e.th""",
        entities=entities,
        counts=counts,
        covered=covered,
        docs=docs,
    )
    protected = materialize(protected, "protected")
    chosen = sql(
        spark,
        f"""
        with x as (select explode(entities) as e, terms from {{protected}}),
        y as (select e.e as e, e.n as n_entity, explode(terms) as h from x),
        b as (select h, e, n_entity, count(*) as n_both from y group by h, e, n_entity having count(*) >= {support}),
        w as (select explode({_hashes("text")}) as h, 1L as c from {{docs}} where text is not null
              union all select explode(was) as h, -rows as c from {{protected}} union all select explode(terms) as h, rows as c from {{protected}}),
        f as (select h, sum(c) as n_term from w group by h),
        n as (select count(*) as n from {{docs}})
        select distinct b.h from b join f on b.h = f.h cross join n
        where n.n > b.n_entity and b.n_both >= {SURE}D * f.n_term and log2(cast(n.n as double) * b.n_both / (cast(f.n_term as double) * b.n_entity)) >= {threshold}D * log2(cast(n.n as double) / b.n_entity)""",
        protected=protected,
        docs=docs,
    )
    return sql(
        spark,
        f"""
        with w as (select doc_id, xxhash64(text) as th, explode({_hashes("text")}) as h from {{docs}} where text is not null
                   union all select c.doc_id, c.th, explode(p.terms) as h from {{covered}} c join {{protected}} p on c.th = p.th)
        select doc_id, th, collect_set(w.h) as hs from w left semi join {{chosen}} c on w.h = c.h group by doc_id, th""",
        docs=docs,
        covered=covered,
        protected=protected,
        chosen=materialize(chosen, "revealing-terms"),
    )


def find_spans(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(doc_id, th, kind, start, end): base spans, and 'term' spans of revealing terms; code points, end exclusive."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    base = materialize(_base(spark, docs), "base-spans")
    covered = materialize(_merged(base), "covered")
    terms = materialize(_revealing(docs, base, covered, threshold, support), "terms-of-texts")
    run = "'[\\\\p{L}\\\\p{N}]+'"
    marked = sql(
        spark,
        """
        select d.doc_id, t.th, d.text, t.hs, coalesce(c.spans, cast(array() as array<struct<start:bigint,end:bigint,kind:string>>)) as spans
        from {docs} d join {terms} t on d.doc_id <=> t.doc_id and xxhash64(d.text) = t.th left join {covered} c on t.doc_id <=> c.doc_id and t.th = c.th""",
        docs=docs,
        terms=terms,
        covered=covered,
    ).dropDuplicates(["doc_id", "th"])
    # What lies between base spans, then the words in it; the lengths of what comes before a word, summed, are its place.
    found = sql(
        spark,
        f"""
        with g as (select doc_id, th, hs, spans, posexplode({_GAPS}) as (i, g) from {{marked}}),
        w as (select doc_id, th, i, case when i = 0 then 0 else spans[i - 1].end end as at, posexplode(zip_with(regexp_extract_all(g, {run}, 0), split(g, {run}, -1), (w, b) -> struct(length(w) as n, length(b) as gap, w is not null and length(w) >= 3 and array_contains(hs, xxhash64(lower(w))) as on))) as (k, w) from g),
        p as (select doc_id, th, w.n as n, w.on as on, at + sum(w.gap + w.n) over (partition by doc_id, th, i order by k) as end from w where w.n is not null)
        select doc_id, th, 'term' as kind, end - n as start, end from p where on""",
        marked=marked,
    )
    return base.select("doc_id", "th", "kind", "start", "end").unionByName(found)


def redact(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The documents with base spans replaced by their kind's name, revealing numbers and names by their shape, and other revealing terms removed.

    Terms are revealing by their counts over whole documents, and go wherever they stand, in documents without the
    entity too. Overlapping spans are one, named after the first. ``n_chars``, where there is one, is counted anew.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    base = materialize(_base(spark, texts), "base-spans")
    covered = materialize(_merged(base), "covered")
    # Names of its own for what it adds, so that no column of the documents can clash.
    id_, th, spans, hs, own_hash = (f"siteloom_{x}_{uuid.uuid4().hex}" for x in ("id", "th", "spans", "hs", "own"))
    marks = sql(
        spark,
        f"""
        with m as (select doc_id, th, spans, cast(null as array<bigint>) as hs from {{covered}} union all select doc_id, th, null as spans, hs from {{terms}})
        select doc_id as {id_}, th as {th}, coalesce(first(spans, true), array()) as {spans}, first(hs, true) as {hs} from m group by doc_id, th""",
        covered=covered,
        terms=_revealing(texts, base, covered, threshold, support),
    )
    own = docs.withColumn(own_hash, F.xxhash64("text"))
    met = own.join(marks, own["doc_id"].eqNullSafe(marks[id_]) & (own[own_hash] == marks[th]), "left")
    shape = "case when w rlike '^[0-9]' then '[NUMBER]' when w rlike '^\\\\p{Lu}' then '[NAME]' else '' end"
    run = "'[\\\\p{L}\\\\p{N}]+'"
    word = f"case when w is null then '' when length(w) >= 3 and array_contains({hs}, xxhash64(lower(w))) then {shape} else w end"
    gap = f"case when {hs} is null then g else array_join(zip_with(split(g, {run}, -1), regexp_extract_all(g, {run}, 0), (b, w) -> concat(b, {word})), '') end"
    cut = F.expr(f"case when {spans} is null then text else array_join(zip_with({_GAPS.replace('spans', spans)}, {spans}, (g, s) -> concat({gap}, case when s is null then '' else concat('[', upper(s.kind), ']') end)), '') end")
    return met.select(*[cut.alias("text") if c == "text" else F.length(cut).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own[c] for c in docs.columns])


def oracle() -> str:
    """The same for DuckDB."""
    kinds = " union all ".join(f"select doc_id, md5(text) as th, {i} as o, '{k}' as kind, regexp_extract_all(text, '{PLAIN[k]}') as hits, regexp_split_to_array(text, '{PLAIN[k]}') as gaps from documents where text is not null" for i, k in enumerate(KINDS))
    word = r"[\p{L}\p{N}]+"
    order = 'partition by doc_id, th order by start, "end" desc, kind'
    return f"""
    with k as ({kinds}),
    z as (select distinct doc_id, th, o, kind, i, hits[i] as hit, length(gaps[i]) as gap from (select *, unnest(generate_series(1, len(hits))) as i from k where len(hits) > 0)),
    s as (select *, sum(gap + length(hit)) over (partition by doc_id, th, kind order by i) as "end", regexp_replace(hit, '[^0-9]', '', 'g') as digits from z),
    base as (select *, cast("end" - length(hit) as bigint) as start from s where case kind when 'email' then true
        when 'ip' then list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 and cast('0' || right(ltrim(x, '0'), 3) as int) <= 255))
        when 'phone' then length(digits) between 9 and 15
        else length(digits) between 13 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda j: case when j % 2 = 0 then (cast(digits[length(digits) + 1 - j] as int) * 2) // 10 + (cast(digits[length(digits) + 1 - j] as int) * 2) % 10 else cast(digits[length(digits) + 1 - j] as int) end)) % 10 = 0 end),
    e as (select distinct th, concat(kind, ':', case when kind in ('email', 'ip') then lower(hit) else digits end) as entity from base),
    b as (select *, coalesce(max("end") over ({order} rows between unbounded preceding and 1 preceding), -1) as before from base),
    g as (select *, sum(case when start >= before then 1 else 0 end) over ({order}) as grp from b),
    merged as (select doc_id, th, min(start) as start, max("end") as "end" from g group by doc_id, th, grp),
    texts as (select doc_id, md5(text) as th, any_value(text) as text, count(*) as rows from documents where text is not null group by doc_id, md5(text)),
    gaps as (select doc_id, th, lag("end", 1, 0) over (partition by doc_id, th order by start) as at, start as till from merged
             union all select t.doc_id, t.th, coalesce(max(m."end"), 0), length(any_value(t.text)) from texts t left join merged m on m.doc_id is not distinct from t.doc_id and m.th = t.th group by t.doc_id, t.th),
    parts as (select g.doc_id, g.th, g.at as "from", substr(t.text, cast(g.at + 1 as bigint), cast(g.till - g.at as bigint)) as part from gaps g join texts t on g.doc_id is not distinct from t.doc_id and g.th = t.th),
    split as (select *, regexp_extract_all(part, '{word}') as words, regexp_split_to_array(part, '{word}') as between from parts),
    each as (select doc_id, th, "from", i, words[i] as word, length(between[i]) as gap from (select *, unnest(generate_series(1, len(words))) as i from split where len(words) > 0)),
    placed as (select doc_id, th, lower(word) as term, length(word) as n, cast("from" + sum(gap + length(word)) over (partition by doc_id, th, "from" order by i) as bigint) as "end" from each),
    tokens as (select distinct doc_id, th, term from placed where n >= 3),
    frequency as (select term, sum(rows) as n_term from tokens k join texts t on k.doc_id is not distinct from t.doc_id and k.th = t.th group by term),
    entities as (select entity, count(*) as n_entity from e group by entity),
    pairs as (select term, entity, count(*) as n_both from (select distinct th, term from tokens) join e using (th) group by term, entity having count(*) >= {SUPPORT}),
    n as (select count(*) as n from documents),
    chosen as (select distinct b.term from pairs b join frequency using (term) join entities using (entity) cross join n
               where n > n_entity and n_both >= {SURE}::double * n_term and log2(cast(n as double) * n_both / (cast(n_term as double) * n_entity)) >= {THRESHOLD}::double * log2(cast(n as double) / n_entity)),
    spans as (select doc_id, th, o, kind, start, cast("end" as bigint) as "end" from base union all
              select doc_id, th, 4, 'term', "end" - n, "end" from placed where n >= 3 and term in (select term from chosen)),
    by_doc as (select doc_id, th, count(*) filter (o = 0) as n_email, count(*) filter (o = 1) as n_ip, count(*) filter (o = 2) as n_card, count(*) filter (o = 3) as n_phone, count(*) filter (o = 4) as n_term,
                 string_agg(concat(kind, ':', start, ':', "end"), ',' order by o, start) filter (o < 4) as b, string_agg(concat(kind, ':', start, ':', "end"), ',' order by o, start) as s from spans group by doc_id, th)
    select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, coalesce(n_term, 0) as n_term,
           sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans
    from documents d left join by_doc g on d.doc_id is not distinct from g.doc_id and md5(d.text) = g.th"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of_documents(table(spark, sf_dir, "documents"))
