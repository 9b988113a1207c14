"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import encode, groups, languages, leaks, names, pieces, reference_values, same_writing, survivors
from spindrift.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivors.claim_survivors(table(spark, d, "triples"))
    return best.select("event_id", *[F.coalesce(f"{f}_from", F.lit(-1)).alias(f"{f}_seq") for f in ("confidence", "evidence", "status")])


def p1_layers(spark: SparkSession, d: str) -> DataFrame:
    """Survivors by completeness, trust and recency of whole records, filled from deeper layers."""
    best = survivors.whole_survivors(table(spark, d, "triples"))
    return best.select("event_id", "n", *[F.coalesce(f"{f}_from", F.lit(-1)).alias(f"{f}_seq") for f in ("confidence", "evidence", "status")])


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(table(spark, d, "triples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = same_writing.claim_records(table(spark, d, "triples"), table(spark, d, "raw_triples"))
    return same_writing.collapse(records, "seq", same_writing.FIELDS).where("seq <> first").select(F.col("first").alias("first_seq"), "seq")


def p3_claims(spark: SparkSession, d: str) -> DataFrame:
    return same_writing.claims(table(spark, d, "triples"), table(spark, d, "raw_triples"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.node_groups(*[table(spark, d, t) for t in ("entities", "match_pairs", "provenance")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).where("node_id <> group_node_id").select("group_node_id", "node_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_paragraphs(table(spark, d, "documents"))


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "documents")).drop("inside_start", "inside_end")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pieces.coverage(table(spark, d, "documents"))


def _entered(spark: SparkSession, d: str) -> DataFrame:
    return reference_values.entered_values(*[table(spark, d, t) for t in ("triples", "entities", "ref_values")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _entered(spark, d).drop("score")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return _entered(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_names(table(spark, d, "entities"), table(spark, d, "triples"))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities_of(names.names_of(table(spark, d, "entities"), table(spark, d, "triples")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(encode.encode(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.held(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.labelled(table(spark, d, "documents")).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


QUERIES = {
    "p1_found": p1_found,
    "p1_layers": p1_layers,
    "p1_survivors": p1_survivors,
    "p3_found": p3_found,
    "p3_claims": p3_claims,
    "p4_found": p4_found,
    "p4_chunks": p4_chunks,
    "p4_coverage": p4_coverage,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_found": p7_found,
    "p7_entities": p7_entities,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_languages": p10_languages,
    "p10_segments": p10_segments,
}

#: White space as RE2 writes it.
_WS = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_SURVIVORS = f"""
with t as (select seq, event_id, loaded_at, coalesce(lower(regexp_replace(regexp_replace(validation_status,'^{_WS}+',''),'{_WS}+$','')),'') as st,
 case when confidence>=0 and confidence<=1 and not isnan(confidence) then confidence end as conf,
 nullif(length(regexp_replace(evidence_text,'{_WS}+','','g')),0) as ev from triples where event_id is not null),
g as (select *, bool_and(st='rejected') over (partition by event_id) as allrej, count(*) over (partition by event_id) as n from t),
u as (select *, case when st<>'rejected' or allrej then conf end as c, case when st<>'rejected' or allrej then ev end as e,
 case st when 'validated' then 4 when 'repaired' then 3 when 'raw' then 2 when 'rejected' then 1 end as s from g where n>=2)
select event_id,
 coalesce(first(seq order by c desc, loaded_at desc nulls last, seq desc) filter (c is not null), -1) as confidence_seq,
 coalesce(first(seq order by e desc, loaded_at desc nulls last, seq desc) filter (e is not null), -1) as evidence_seq,
 coalesce(first(seq order by s desc, loaded_at desc nulls last, seq desc) filter (s is not null), -1) as status_seq
from u group by event_id"""

#: Peeling by longest chains of dominance: a record's layer is the length of the longest one that ends at it.
_LAYERS = f"""
with recursive t as materialized (select seq, event_id, coalesce(epoch_us(loaded_at), -9223372036854775808) as ts, coalesce(lower(regexp_replace(regexp_replace(validation_status,'^{_WS}+',''),'{_WS}+$','')),'') as st,
 case when confidence>=0 and confidence<=1 and not isnan(confidence) then confidence end as conf, nullif(length(regexp_replace(evidence_text,'{_WS}+','','g')),0) as ev,
 count(*) over (partition by event_id) as n from triples where event_id is not null),
u as materialized (select *, case st when 'validated' then 4 when 'repaired' then 3 when 'raw' then 2 when 'rejected' then 1 end as s, bool_and(st='rejected') over (partition by event_id) as allrej from t where n >= 2),
v as materialized (select *, (conf is not null)::int + (ev is not null)::int + (s is not null)::int as full_, coalesce(s, 0) as trust from u),
over_ as materialized (select a.seq as hi, b.seq as lo from v a join v b on a.event_id = b.event_id and a.full_ >= b.full_ and a.trust >= b.trust and (a.ts > b.ts or (a.ts = b.ts and a.seq > b.seq))),
chain(seq, l) as (select seq, 1 from v union select o.lo, c.l + 1 from chain c join over_ o on o.hi = c.seq where c.l < {survivors.LAYERS + 1}),
d as (select v.*, -l as l from v join (select seq, max(l) as l from chain group by 1) using (seq)),
w as (select *, case when st<>'rejected' or allrej then conf end as c, case when st<>'rejected' or allrej then ev end as e from d)
select event_id, count(*) as n, coalesce(first(seq order by l desc, c desc, ts desc, seq desc) filter (c is not null), -1) as confidence_seq,
 coalesce(first(seq order by l desc, e desc, ts desc, seq desc) filter (e is not null), -1) as evidence_seq, coalesce(first(seq order by l desc, s desc, ts desc, seq desc) filter (s is not null), -1) as status_seq
from w group by event_id"""

_PARAGRAPHS = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
p as (select *, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as start, length(ltrim(line, ' ' || chr(9) || chr(13))) as l_left, length(rtrim(line, ' ' || chr(9) || chr(13))) as l_right from l),
g as (select *, sum(cast(l_left = 0 as integer)) over (partition by doc_id order by i) as run from p)
select doc_id, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end
from (select doc_id, arg_min(start + length(line) - l_left, i) as char_start, arg_max(start + l_right, i) as char_end from g where l_left > 0 group by doc_id, run) where char_end - char_start > 2000"""

_GROUPS = rf"""
with recursive said as (select element_id as e, hash(merge_history) as h, unnest(merge_history) as m, generate_subscripts(merge_history, 1) as i from provenance where element_type = 'node'),
kinds as (select e, h, i, case when regexp_matches(m, '{groups.TAKEN_BACK}') then -1 when regexp_matches(m, '{groups.REFUSED}') then 0 when regexp_matches(m, '{groups.STATED}') then 1 else 0 end as kind,
  list_distinct(list_transform(regexp_extract_all(m, '([a-z_]+:[^\s",;()]+)', 1), lambda x: rtrim(x, ':'))) as ids from said where m is not null),
owned as (select *, case when len(ids) = 1 or list_contains(ids, e) then e else ids[1] end as x from kinds where kind <> 0 and len(ids) > 0),
pr as (select e, h, i, kind, x, unnest(ids) as y from owned),
merges as (select a, b from (select least(x, y) as a, greatest(x, y) as b, arg_max(kind, i) as kind from pr where x <> y group by e, h, least(x, y), greatest(x, y)) where kind = 1),
al as (select distinct node_id, entity_type, lower(trim(alias)) as alias from (select node_id, entity_type, unnest(aliases) as alias from entities) where alias is not null and entity_type is not null),
named as (select node_id, min(node_id) over (partition by entity_type, alias) as first from al where alias not in ('', 'n/a', 'unknown', '-')),
edges as (select node_id_1 as a, node_id_2 as b from match_pairs where node_id_1 <> node_id_2 union select a, b from merges union select node_id, first from named where node_id <> first),
adj as (select a, b from edges union select b, a from edges),
reach(n, m) as (select a, b from adj union select r.n, x.b from reach r join adj x on x.a = r.m)
select min(m) as group_node_id, n as node_id from reach group by n having min(m) < n"""

_LEAKS = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where text is not null),
d as (select distinct doc_id, array_to_string(ws[i:i + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from w)),
v as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from eval_items where text is not null),
e as (select distinct item_id, array_to_string(ws[i:i + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from v))
select distinct item_id, doc_id from e join d using (g)"""

SQL = {
    "p1_found": _SURVIVORS,
    "p1_layers": _LAYERS,
    "p1_survivors": f"""
with best as ({_SURVIVORS}), counted as (select event_id, count(*) as n from triples group by 1)
select b.event_id, c.n as deliveries, x.confidence, y.evidence_text, z.validation_status from best b join counted c on c.event_id = b.event_id
  left join triples x on x.seq = b.confidence_seq left join triples y on y.seq = b.evidence_seq left join triples z on z.seq = b.status_seq""",
    "p4_found": _PARAGRAPHS,
    "p4_coverage": f"select doc_id, cast(length(text) as bigint) as chars, cast(0 as bigint) as gaps, cast(0 as bigint) as too_long, cast(0 as bigint) as apart from documents where regexp_replace(text, '{_WS}+', '', 'g') <> ''",
    "p5_found": _GROUPS,
    "p5_groups": _GROUPS[: _GROUPS.rindex("select min(m)")] + "select n as node_id, min(m) as group_node_id from (select n, m from reach union all select node_id, node_id from entities where node_id is not null union all select node_id_1, node_id_1 from match_pairs where node_id_1 = node_id_2) group by n",
    "p9_found": _LEAKS,
    "p8_decoded": "select doc_id, case when text is null then '' else text end as text from documents",
}
