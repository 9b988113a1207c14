"""Queries on responses of models and what follows from them, with their SQL.

No table holds responses: they are made from the stored triples, in every shape that models give
them, so that what comes out is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift import schema
from spindrift.operators import extract, validate
from spindrift.plans import duck
from spindrift.plans.base import kg
from spindrift.plans.duck import listed, with_kg
from spindrift.plans.quality import MAIN
from spindrift.plans.validation import POLICY, VALIDATED
from spindrift.sources import responses
from spindrift.tables import table

LIST = ("subject", "subject_type", "relation", "object", "object_type", "evidence_text")
#: Triples of one answer at most: rows of an unnamed chunk are as many as there are.
PAGE = 200


def stored_answers(spark: SparkSession, d: str, page: int = PAGE) -> DataFrame:
    """chunk_id, start and response: each chunk's triples as JSON, plain, in a fence, in prose or cut off at
    the end of the list; beyond ``page`` triples in several answers, ``start`` the place of the first one."""
    place = F.row_number().over(Window.partitionBy("source_chunk_id").orderBy("seq")) - 1
    numbered = table(spark, d, "triples").where("source_chunk_id is not null").select(F.col("source_chunk_id").alias("chunk_id"), "seq", *LIST, (place - place % page).alias("start"))
    # Spread by answer: the window leaves all answers of a chunk in one task.
    rows = numbered.repartition("chunk_id", "start").groupBy("chunk_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", *LIST))).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in LIST])).alias("triples")))
    shape = F.length("chunk_id") % 4
    said = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.concat(F.lit("Here is what I found:\n"), body, F.lit("\nThat is all.")))
    return rows.select("chunk_id", "start", said.otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 2), F.lit(', {"subject": "cut'))).alias("response"))


def extracted_triples(spark: SparkSession, d: str) -> DataFrame:
    return extract.extracted(stored_answers(spark, d)).drop("event_id", "conf", "status")


def first_triples(spark: SparkSession, d: str) -> DataFrame:
    """The first five triples of each chunk: the limit is the feature."""
    return extract.extracted(stored_answers(spark, d), 5).select("chunk_id", "i", "part")


def second_pass(spark: SparkSession, d: str) -> DataFrame:
    """Validated triples, and what a second pass (the raw ones) adds at a capped confidence."""
    rows = kg(spark, d)
    return extract.with_pass(rows.where("status = 'validated'"), rows.where("status = 'raw'"), extract.CAPS["low_yield"]).select("seq", "conf")


def low_yield_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = kg(spark, d)
    return extract.low_yield(rows, table(spark, d, "chunks").select(F.col("doc_id").alias("doc"), "chunk_id"), validate.validate(rows, POLICY), 40, 30)


def link_requests(spark: SparkSession, d: str) -> DataFrame:
    return extract.link_requests(kg(spark, d))


def predicted_links(spark: SparkSession, d: str) -> DataFrame:
    """Answers to the link requests, by a rule: a link, a link to someone else, or none."""
    asked = extract.link_requests(kg(spark, d))
    body = F.to_json(F.struct(F.col("name_a").alias("subject"), F.col("type_a").alias("subject_type"), F.lit("works with").alias("relation"), F.when(F.col("n") == 2, "no one").otherwise(F.col("name_b")).alias("object"), F.col("type_b").alias("object_type")))
    strange = F.to_json(F.struct(F.lit("someone").alias("subject"), F.lit("no one").alias("object")))
    answer = F.when(F.col("n") == 3, '{"skip": true}').when(F.col("n") == 4, strange).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return extract.predicted_links(asked.withColumn("response", answer)).select("doc", "n", "s", "st", "rel", "o", "ot", "conf")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A rendered prompt for each chunk and the key that its answer is stored under."""
    text = responses.render("Known names: {names}\n\nText:\n{text}\n", names=F.col("chunk_id"), text=F.col("text"))
    rows = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", F.length(text).alias("length"), responses.prompt_key(F.lit("model"), text).alias("key"))


QUERIES = {f.__name__: f for f in (extracted_triples, first_triples, second_pass, low_yield_documents, link_requests, predicted_links, prompts)}

_RESOLVED = f"case when k0 in {listed(x.replace('_', '') for x in schema.RELATIONS)} then " + duck.mapped("k0", {x.replace("_", ""): x for x in schema.RELATIONS}, "null") + " else " + duck.ladder("k", schema.MODEL_RELATION_STEMS, "'related_to'") + " end"


def _type(col: str) -> str:
    k = f"translate(lower({duck.strip(col)}), ' _', '')"
    return duck.mapped(k, {t.lower(): t for t in schema.ENTITY_TYPES}, duck.ladder(k, schema.MODEL_TYPE_STEMS, "'Other'"))


def _clean(col: str) -> str:
    """A name without its article, qualifier and lead-in: nested so that each step reads the one before."""
    out = col
    for lead in ("the ", "a ", "an "):
        out = f"list_transform([{out}], lambda y: case when starts_with(lower(y), '{lead}') and length(y) > {len(lead) + 2} then substr(y, {len(lead) + 1}) else y end)[1]"
    out = f"regexp_replace({out}, '\\s+(?:for|from|against|on|in|of|by|via|through|within|across)\\s+(?:the\\s+)?(?:[A-Z]|\\w{{2,}}).*$', '')"
    out = f"regexp_replace({out}, '(?i)^(?:threat actors? to execute|attackers? to execute|allows? (?:attackers?|threat actors?) to (?:execute|run|deploy))\\s+', '')"
    return duck.strip(out)


_NUMBER = " or ".join(f"regexp_matches(ol, {duck.lit(p)})" for p in extract.MERE_NUMBERS)
_EXTRACTED = f"""a0 as (select *, row_number() over (partition by source_chunk_id order by seq) - 1 as i from triples where source_chunk_id is not null),
a1 as (select source_chunk_id as chunk_id, i, {_clean(duck.strip("coalesce(subject, '')"))} as s, {_clean(duck.strip("coalesce(object, '')"))} as o, {_type("coalesce(nullif(subject_type, ''), 'Other')")} as st, {_type("coalesce(nullif(object_type, ''), 'Other')")} as ot,
  {duck.strip("coalesce(nullif(relation, ''), 'related_to')")} as said, {duck.strip("coalesce(evidence_text, '')")} as ev from a0),
a2 as (select *, replace(lower(said), ' ', '_') as k, replace(replace(lower(said), ' ', '_'), '_', '') as k0, {duck.strip("replace(lower(said), '-', '_')")} as w from a1 where s <> '' and o <> ''),
a3 as (select *, {_RESOLVED} as rel, {duck.any_of('w', extract.PASSIVE_TARGETS)} as pt, {duck.any_of('w', extract.PASSIVE_USES)} as pu, {duck.any_of('w', extract.PASSIVE_ATTRIBUTION)} as pa from a2),
a4 as (select *, case when pt then case when st in {listed(extract.SUFFERS)} and ot in {listed(extract.ACTS)} then 't' end when pu then case when st in {listed(extract.USED)} and ot in {listed(extract.USES)} then 'u' end
  when pa then case when st in {listed(extract.RUN)} and ot in {listed(extract.RUNS)} then 'a' end end as act from a3),
a5 as (select chunk_id, i, ev, case act when 't' then 'targets' when 'u' then 'uses' when 'a' then 'attributed_to' else rel end as rel, case when act in ('t', 'u') then o else s end as s, case when act in ('t', 'u') then s else o end as o,
  case when act in ('t', 'u') then ot else st end as st, case when act in ('t', 'u') then st else ot end as ot from a4),
a6 as (select *, list_filter(list_transform(string_split_regex(replace(replace(o, ', and ', ', '), ' and ', ', '), '\\s*[,;]\\s*'), lambda x: trim(x)), lambda x: x <> '') as ps from a5),
a7 as (select *, case when ot in {listed(extract.LISTABLE)} and (len(ps) >= 3 or (len(ps) = 2 and len(list_filter(ps, lambda x: len(string_split_regex(x, '\\s+')) > 6)) = 0)) then ps else [o] end as l from a6),
a8 as (select * exclude (o, ps, l), l[p] as o, cast(p - 1 as integer) as part from (select *, unnest(range(1, len(l) + 1)) as p from a7)),
a9 as (select *, lower({duck.strip('o')}) as ol from a8),
kept as (select * from a9 where not (ol = '' or (ol in {listed(extract.GENERIC_OBJECTS)} and rel in ('related_to', 'associated_with', 'variant_of', 'targets')) or ((starts_with(ol, 'to ') or starts_with(ol, 'on ') or starts_with(ol, 'as ')) and rel in ('related_to', 'associated_with', 'targets', 'drops', 'variant_of'))
  or (({_NUMBER}) and rel in ('related_to', 'associated_with', 'targets')) or (rel = 'variant_of' and ot = 'Other' and ol in {listed(extract.GENERIC_MALWARE)})))"""
_PN = listed(schema.PRONOUNS)
_PRONOUNS = f"""w as (select *, coalesce(case when lower(o) not in {_PN} and ot in ('ThreatActor', 'Campaign') then o end, case when lower(s) not in {_PN} and st in ('ThreatActor', 'Campaign') then s end) as na,
  coalesce(case when lower(o) not in {_PN} and ot in ('Malware', 'Tool') then o end, case when lower(s) not in {_PN} and st in ('Malware', 'Tool') then s end) as nmw from kept),
l as (select *, last_value(na ignore nulls) over p as a, last_value(nmw ignore nulls) over p as m from w window p as (partition by chunk_id order by i, part rows between unbounded preceding and current row))
select chunk_id, cast(i as integer) as i, part, case when lower(s) in {_PN} then coalesce(case when st = 'ThreatActor' then a when st in ('Malware', 'Tool') then m end, a, m, s) else s end as s, st, rel,
  case when lower(o) in {_PN} then coalesce(case when ot = 'ThreatActor' then a when ot in ('Malware', 'Tool') then m end, a, m, o) else o end as o, ot, ev from l"""
_REQUESTS = """rk as (select *, cast(row_number() over (partition by doc order by size desc, component) as integer) as rank from t),
rq as (select b.doc, b.rank - 1 as n, split_part(a.main_node, '::', 1) as type_a, substr(a.main_node, strpos(a.main_node, '::') + 2) as name_a, split_part(b.main_node, '::', 1) as type_b, substr(b.main_node, strpos(b.main_node, '::') + 2) as name_b
  from rk a join rk b on a.doc = b.doc and a.rank = 1 and b.rank between 2 and 6)"""


SQL = {
    "extracted_triples": f"with {_EXTRACTED}, {_PRONOUNS}",
    "first_triples": f"with {_EXTRACTED} select chunk_id, cast(i as integer) as i, part from (select *, row_number() over (partition by chunk_id order by i, part) as n from kept) where n <= 5",
    "second_pass": with_kg(f""", old as (select doc, lower(s) as a, rel, lower(o) as b from kg where status = 'validated'), fresh as (select *, lower(s) as a, lower(o) as b from kg where status = 'raw')
select seq, conf from kg where status = 'validated' union all select seq, least(conf, {extract.CAPS['low_yield']}) from (select *, row_number() over (partition by doc, a, rel, b order by seq) as k from fresh f
  where not exists (select 1 from old where old.doc = f.doc and old.rel = f.rel and ((old.a = f.a and old.b = f.b) or (old.a = f.b and old.b = f.a)))) where k = 1""".lstrip()),
    "low_yield_documents": f"""with {VALIDATED}, a as (select doc_id as doc from chunks where doc_id is not null group by 1 having count(distinct chunk_id) = 1),
r as (select doc, count(*) as raw, count(*) filter (status <> 'rejected') as valid from validated group by 1) select a.doc, coalesce(raw, 0) as raw, coalesce(valid, 0) as valid from a left join r using (doc) where coalesce(raw, 0) <= 40 and coalesce(valid, 0) <= 30""",
    "link_requests": f"with recursive {duck.KG}, {MAIN}, {_REQUESTS} select * from rq",
    "predicted_links": f"with recursive {duck.KG}, {MAIN}, {_REQUESTS} select doc, n, {duck.strip('name_a')} as s, type_a as st, 'related_to' as rel, case when n = 2 then 'no one' else {duck.strip('name_b')} end as o, type_b as ot, cast(0.7 as double) as conf from rq where n not in (3, 4) and {duck.strip('name_a')} <> '' and {duck.strip('name_b')} <> ''",
    "prompts": "select chunk_id, length(p) as length, substr(sha256('model' || chr(0) || p), 1, 32) as key from (select distinct chunk_id, 'Known names: ' || chunk_id || chr(10) || chr(10) || 'Text:' || chr(10) || coalesce(text, '') || chr(10) as p from chunks where chunk_id is not null)",
}
