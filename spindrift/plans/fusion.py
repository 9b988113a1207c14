"""Queries on names, grounding, fusion and pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions import names as nm
from spindrift.functions import relations as rl
from spindrift.operators import extract, fuse, ground, pairs
from spindrift.plans import duck
from spindrift.plans.base import kg
from spindrift.plans.duck import listed, with_kg
from spindrift.tables import table


def relation_resolve(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "triples").select("relation").where("relation is not null").distinct()
    return raw.select("relation", rl.normalize_relation(F.col("relation")).alias("normalized"), rl.resolve_relation(F.col("relation")).alias("resolved"))


def entity_type_resolve(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "triples").select(F.explode(F.array("subject_type", "object_type", "object")).alias("raw")).where("raw is not null").distinct()
    return raw.select("raw", rl.resolve_entity_type(F.col("raw")).alias("resolved"))


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = kg(spark, d).select(F.explode(F.array(F.struct(F.col("st").alias("t"), F.col("s").alias("n")), F.struct(F.col("ot").alias("t"), F.col("o").alias("n")))).alias("e")).select("e.*").distinct()
    n = F.col("n")
    return rows.select("t", "n", nm.node_id(F.col("t"), n).alias("node_id"), nm.for_match(n).alias("match_form"), nm.for_comparison(n).alias("compare_form"), nm.alnum_words(n).alias("words"), nm.clean_name(n).alias("clean"))


def compound_split(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d).select("seq", F.posexplode(extract.compound(F.col("o"), F.col("ot"))).alias("i", "part"))


def alias_table(spark: SparkSession, d: str) -> DataFrame:
    return ground.alias_table(table(spark, d, "mitre"))


def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    return ground.canonical_names(kg(spark, d), ground.alias_table(table(spark, d, "mitre")))


def technique_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return ground.technique_catalogue(table(spark, d, "mitre")).select("technique_id", "name", "description", F.array_join("tactics", "|").alias("tactics"))


def technique_ground(spark: SparkSession, d: str) -> DataFrame:
    """Names of nodes and of catalogue entries' titles against the catalogue."""
    m = table(spark, d, "mitre")
    called = ground.records(m).select("name")
    names = kg(spark, d).select(F.col("o").alias("name")).unionByName(called.select(F.concat("name", F.lit(" (variant)")).alias("name"))).unionByName(called).where("name is not null")
    return ground.ground_techniques(names, ground.technique_records(m))


def alias_lists(spark: SparkSession, d: str) -> DataFrame:
    """The inverse of the alias table: all aliases of each group."""
    return ground.known_aliases(ground.alias_table(table(spark, d, "mitre")), "group").select("canonical", F.array_join("aliases", "|").alias("aliases"))


def canonical_triples(spark: SparkSession, d: str) -> DataFrame:
    return ground.canonicalized(kg(spark, d), ground.alias_table(table(spark, d, "mitre"))).select("seq", "s", "o")


def grounded_triples(spark: SparkSession, d: str) -> DataFrame:
    return ground.with_techniques(kg(spark, d), table(spark, d, "mitre")).select("seq", "s", "o", F.array_join("aids", "|").alias("aids"))


def entity_map(spark: SparkSession, d: str) -> DataFrame:
    return fuse.entity_map(kg(spark, d))


def fuse_edges(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fuse_edges(kg(spark, d))


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    return fuse.edge_evidence(kg(spark, d))


def node_provenance(spark: SparkSession, d: str) -> DataFrame:
    return fuse.provenance(kg(spark, d))


def retention_rate(spark: SparkSession, d: str) -> DataFrame:
    return fuse.retention(table(spark, d, "provenance"))


def swap_aware_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = kg(spark, d)
    return pairs.additions(rows.where("status = 'validated'"), rows.where("status in ('raw', 'repaired')")).select("seq")


def guided_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.guided_pairs(kg(spark, d))


def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.duplicate_candidates(table(spark, d, "entities"))


def pronoun_fill(spark: SparkSession, d: str) -> DataFrame:
    return pairs.resolve_pronouns(kg(spark, d)).select("seq", "s", "o")


_MATCH = """m0 as (select distinct *, lower(trim(n)) as x0 from ends), """ + ", ".join(
    f"m{i + 1} as (select *, case when starts_with(x{i}, '{lead}') then substr(x{i}, {len(lead) + 1}) else x{i} end as x{i + 1} from m{i})" for i, lead in enumerate(nm.LEADS))
_CLEAN = ", ".join(
    f"k{i + 1} as (select *, case when starts_with(lower(y{i}), '{lead}') and length(y{i}) > {len(lead) + 2} then substr(y{i}, {len(lead) + 1}) else y{i} end as y{i + 1} from k{i})" for i, lead in enumerate(("the ", "a ", "an ")))
_ENDS = "ends as (select st as t, s as n, seq, 0 as side, doc, chunk, status from kg union all select ot, o, seq, 1, doc, chunk, status from kg)"
_NODE = "lower({t}) || ':' || translate(replace(lower(trim({n})), ' ', '_'), '()''\",;', '')"
_CMP0 = "case when starts_with({0}, 'the ') then substr({0}, 5) else {0} end"
_CMP = duck.strip("translate(case when starts_with(z, 'a ') then substr(z, 3) else z end, '()''\",;.-_', '')")
_RK = "case kind when 'intrusion-set' then 'group' when 'threat-actor' then 'group' when 'malware' then 'software' when 'tool' then 'software' end"
_AK = "case t when 'ThreatActor' then 'group' when 'Campaign' then 'group' when 'Malware' then 'software' when 'Tool' then 'software' when 'Software' then 'software' end"


def _list(field: str) -> str:
    return f"case json_type(c, '$.{field}') when 'ARRAY' then json_extract(c, '$.{field}[*]') else cast([] as json[]) end"


def _objects(field: str) -> str:
    """The objects of a list in contents after those of the column, as JSON."""
    inner = f"list_filter(case json_type(c, '$.{field}') when 'OBJECT' then [json_extract(c, '$.{field}')] else {_list(field)} end, lambda x: json_type(x) = 'OBJECT')"
    return f"list_concat(list_transform(list_filter(coalesce({field}, []), lambda x: x is not null), lambda x: to_json(x)), {inner})"


def _alias(field: str) -> str:
    return f"nullif(list_filter(list_transform({_list(field)}, lambda x: x ->> '$'), lambda x: x is not null), [])"


_RECORDS = f"""rc0 as (select *, case when json_valid(contents) then case when json_type(contents) = 'OBJECT' then cast(contents as json) end end as c from mitre),
rc as (select rec_id, coalesce(nullif(type, ''), nullif(object_type, '')) as kind, coalesce(nullif(trim(name), ''), nullif(trim(c ->> '$.name'), ''), nullif(trim(title), '')) as name, nullif(mitre_id, '') as mitre_id,
  substr(coalesce(c ->> '$.description', ''), 1, 200) as description, coalesce(nullif(list_filter(coalesce(aliases, []), lambda x: x is not null), []), {_alias('aliases')}, {_alias('x_mitre_aliases')}, []) as aliases,
  {_objects('external_references')} as refs, {_objects('kill_chain_phases')} as phases from rc0)"""
_ALIASES = f"""{_RECORDS}, al as (select distinct rec_id, kind, canonical, lower(trim(alias)) as alias from (select rec_id, {_RK} as kind, name as canonical, unnest(list_concat([name], aliases)) as alias from rc) where kind is not null and canonical is not null),
alias_table as (select kind, alias, canonical from (select *, row_number() over (partition by kind, alias order by rec_id desc) as k from al where alias is not null and alias <> '') where k = 1)"""
_TECHNIQUES = f"""{_RECORDS}, tr as (select rec_id, coalesce(mitre_id, nullif(list_filter(refs, lambda r: r ->> '$.source_name' = 'mitre-attack')[1] ->> '$.external_id', '')) as technique_id, name, description,
  list_transform(list_filter(phases, lambda p: p ->> '$.kill_chain_name' = 'mitre-attack'), lambda p: coalesce(p ->> '$.phase_name', '')) as tactics from rc where kind is null or kind = 'attack-pattern'),
techniques as (select * from tr where technique_id is not null and name is not null),
catalogue as (select * from (select *, row_number() over (partition by technique_id order by rec_id desc) as k from techniques) where k = 1)"""
_AN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CANONICAL = f"""{duck.KG}, {_ENDS}, {_ALIASES}, live as (select *, lower(n) as alias, {_AK} as kind from ends where status <> 'rejected'),
first as (select t, alias, arg_min(n, seq * 2 + side) as spelled from live group by 1, 2), plain as (select t, alias, {duck.strip("regexp_replace(spelled, '" + duck.WS + "+', ' ', 'g')")} as p from first),
canonical as (select seq, side, n, coalesce(a.canonical, {duck.mapped('lower(p)', schema.KNOWN_CASING, 'p')}) as canonical from live l join plain f on f.t = l.t and f.alias = l.alias left join alias_table a on a.kind = l.kind and a.alias = l.alias)"""
_GROUND = f"""asked as (select name, lower(trim(name)) as low, {_AN.format('name')} as norm from names),
lows as (select lower(name) as low, arg_max(technique_id, rec_id) as technique_id from techniques group by 1),
lst as (select t_norm, arg_max(technique_id, rec_id) as technique_id, min(rec_id) as place from (select *, {_AN.format('name')} as t_norm from techniques) where t_norm <> '' group by 1),
aw as (select name, norm, len(list_distinct(string_split(norm, ' '))) as n, unnest(list_distinct(string_split(norm, ' '))) as w from asked where norm <> ''),
lw as (select *, len(list_distinct(string_split(t_norm, ' '))) as t_n, unnest(list_distinct(string_split(t_norm, ' '))) as w from lst),
sc as (select name, 3 as level, cast(1 as double) as score, 0 as place, technique_id from asked join lows using (low) union all select name, 2, 1, place, technique_id from asked join lst on norm = t_norm
  union all select name, 1, count(*) / (n + t_n - count(*)) as score, place, technique_id from aw join lw using (w) group by name, norm, n, technique_id, place, t_norm, t_n having count(*) / (n + t_n - count(*)) >= 0.6),
found as (select name, technique_id, score from (select *, row_number() over (partition by name order by level desc, score desc, place) as k from sc) where k = 1)"""
_FITS = " ".join(f"when ta in {listed(a)} and tb in {listed(b)} then '{r}|f' when tb in {listed(a)} and ta in {listed(b)} then '{r}|t'" for r, (a, b) in schema.TYPE_PAIRS.items())
_PN = listed(schema.PRONOUNS)

QUERIES = {f.__name__: f for f in (
    relation_resolve, entity_type_resolve, name_forms, compound_split, alias_table, alias_lists, alias_resolve, canonical_triples, grounded_triples, technique_catalogue, technique_ground, entity_map, fuse_edges, edge_evidence,
    node_provenance, retention_rate, swap_aware_antijoin, guided_pairs, duplicate_candidates, pronoun_fill)}

SQL = {
    "relation_resolve": f"""with r as (select distinct relation, replace({duck.strip('lower(relation)')}, ' ', '_') as k from triples where relation is not null)
select relation, {duck.relation('relation')} as normalized, {duck.mapped("replace(k, '_', '')", {x.replace('_', ''): x for x in schema.RELATIONS}, duck.ladder('k', schema.MODEL_RELATION_STEMS, "'related_to'"))} as resolved from r""",
    "entity_type_resolve": f"""with r as (select distinct raw, translate({duck.strip('lower(raw)')}, ' _', '') as k from (select subject_type as raw from triples union all select object_type from triples union all select object from triples) where raw is not null)
select raw, {duck.mapped('k', {t.lower(): t for t in schema.ENTITY_TYPES}, duck.ladder('k', schema.MODEL_TYPE_STEMS, "'Other'"))} as resolved from r""",
    "name_forms": with_kg(f""", ends0 as (select st as t, s as n from kg union select ot, o from kg), ends as (select * from ends0), {_MATCH}, k0 as (select *, n as y0 from m{len(nm.LEADS)}), {_CLEAN},
z0 as (select *, {_CMP0.format('x0')} as z from k3)
select t, n, {_NODE.format(t='t', n='n')} as node_id, {duck.strip("regexp_replace(x6, '" + duck.WS + "+', ' ', 'g')")} as match_form, {_CMP} as compare_form, {_AN.format('n')} as words,
  {duck.strip("""regexp_replace(regexp_replace(y3, '\\s+(?:for|from|against|on|in|of|by|via|through|within|across)\\s+(?:the\\s+)?(?:[A-Z]|\\w{2,}).*$', ''),
  '(?i)^(?:threat actors? to execute|attackers? to execute|allows? (?:attackers?|threat actors?) to (?:execute|run|deploy))\\s+', '')""")} as clean from z0""".lstrip()),
    "compound_split": with_kg(""", p as (select seq, o, ot, list_filter(list_transform(string_split_regex(replace(replace(o, ', and ', ', '), ' and ', ', '), '\\s*[,;]\\s*'), lambda x: trim(x)), lambda x: x <> '') as parts from kg),
q as (select seq, case when ot in ('ThreatActor', 'Malware', 'Tool', 'Campaign', 'Organization', 'Location', 'Software', 'Technique') and (len(parts) >= 3 or (len(parts) = 2 and len(list_filter(parts, lambda x: len(string_split_regex(x, '\\s+')) > 6)) = 0)) then parts else [o] end as l from p)
select seq, cast(i - 1 as integer) as i, l[i] as part from (select seq, l, unnest(range(1, len(l) + 1)) as i from q)""".lstrip()),
    "alias_table": f"with {_ALIASES} select * from alias_table",
    "alias_lists": f"with {_ALIASES} select canonical, string_agg(alias, '|' order by alias) as aliases from alias_table where kind = 'group' and alias <> lower(canonical) group by 1",
    "alias_resolve": f"with {_CANONICAL} select seq, side, n as name, canonical from canonical",
    "canonical_triples": f"with {_CANONICAL} select k.seq, coalesce(a.canonical, k.s) as s, coalesce(b.canonical, k.o) as o from kg k left join canonical a on a.seq = k.seq and a.side = 0 left join canonical b on b.seq = k.seq and b.side = 1",
    "technique_catalogue": f"with {_TECHNIQUES} select technique_id, name, description, array_to_string(tactics, '|') as tactics from catalogue",
    "technique_ground": f"""with {duck.KG}, {_TECHNIQUES}, names as (select distinct name from (select o as name from kg union all select name || ' (variant)' from rc union all select name from rc) where name is not null), {_GROUND}
select name, technique_id, round(score, 6) as score from found""",
    "grounded_triples": f"""with {duck.KG}, {_TECHNIQUES}, names as (select s as name from kg where st = 'Technique' and status <> 'rejected' union select o from kg where ot = 'Technique' and status <> 'rejected'), {_GROUND},
called as (select f.name, f.technique_id, c.name as called from found f join catalogue c using (technique_id)),
j as (select k.seq, coalesce(a.called, k.s) as s, coalesce(b.called, k.o) as o, status, aids as own, list_filter(list_concat(aids, [a.technique_id, b.technique_id]), lambda x: x is not null) as l
  from kg k left join called a on k.status <> 'rejected' and k.st = 'Technique' and a.name = k.s left join called b on k.status <> 'rejected' and k.ot = 'Technique' and b.name = k.o)
select seq, s, o, array_to_string(case when status = 'rejected' then own else list_filter(l, lambda x, i: list_position(l, x) = i) end, '|') as aids from j""",
    "entity_map": with_kg(f""", {_ENDS}, live as (select *, {_NODE.format(t='t', n='n')} as node_id, concat_ws(':', doc, chunk) as mention, seq * 2 + side as pos from ends where status <> 'rejected'),
sp as (select node_id, n, min(pos) as pos, arg_min(t, pos) as t from live group by 1, 2), f as (select node_id, arg_min(n, pos) as canonical_name, arg_min(t, pos) as type from sp group by 1)
select f.node_id, canonical_name, type, (select count(distinct mention) from live l where l.node_id = f.node_id) as n_mentions,
  coalesce((select string_agg(n, ' | ' order by pos) from sp where sp.node_id = f.node_id and sp.n <> f.canonical_name), '') as aliases from f""".lstrip()),
    "fuse_edges": with_kg("""select ks, rel, ko, arg_max(seq, r) as seq, count(*) as rows, count(distinct coalesce(doc, '')) as docs, round(least(1.0, max(conf) + cast(0.05 as double) * greatest(count(distinct coalesce(doc, '')) - 1, 0)), 6) as conf
from (select lower(s) as ks, rel, lower(o) as ko, seq, doc, conf, row_number() over (partition by lower(s), rel, lower(o) order by conf, seq desc) as r from kg where status <> 'rejected' and conf >= 0.5) group by 1, 2, 3"""),
    "edge_evidence": with_kg(""", t as (select lower(s) as ks, rel, lower(o) as ko, ev as evidence, min(seq) as f from kg where status <> 'rejected' and ev <> '' group by 1, 2, 3, 4)
select ks, rel, ko, cast(row_number() over (partition by ks, rel, ko order by f) as integer) as position, evidence from t""".lstrip()),
    "node_provenance": with_kg(f""", {_ENDS} select {_NODE.format(t='t', n='n')} as node_id, count(distinct split_part(concat_ws(':', doc, chunk), ':', 1)) as docs, count(distinct concat_ws(':', doc, chunk)) as chunks, count(distinct seq) as triples from ends where status <> 'rejected' group by 1""".lstrip()),
    "retention_rate": "select element_type, count(*) as n, round(coalesce(avg(case when len(source_doc_ids) > 0 then 1.0 else 0.0 end), 0), 6) as retention from provenance group by 1",
    "swap_aware_antijoin": with_kg(""", old as (select doc, lower(s) as a, rel, lower(o) as b from kg where status = 'validated'), fresh as (select *, lower(s) as a, lower(o) as b from kg where status in ('raw', 'repaired'))
select seq from (select seq, row_number() over (partition by doc, a, rel, b order by seq) as k from fresh f
  where not exists (select 1 from old where old.doc = f.doc and old.rel = f.rel and ((old.a = f.a and old.b = f.b) or (old.a = f.b and old.b = f.a)))) where k = 1""".lstrip()),
    "guided_pairs": with_kg(f""", {_ENDS}, live as (select *, seq * 2 + side as pos from ends where status <> 'rejected' and chunk is not null), known as (select chunk, n, min(pos) as pos, arg_max(t, pos) as t from live group by 1, 2),
rel as (select distinct chunk, least(lower(s), lower(o)) as x, greatest(lower(s), lower(o)) as y from kg where status <> 'rejected'),
pr as (select p.chunk, p.n as a, q.n as b, p.pos as i, q.pos as j, p.t as ta, q.t as tb from known p join known q on p.chunk = q.chunk and p.pos < q.pos),
ch as (select *, case {_FITS} end as c from pr where not exists (select 1 from rel r where r.chunk = pr.chunk and r.x = least(lower(a), lower(b)) and r.y = greatest(lower(a), lower(b)))),
rk as (select *, row_number() over (partition by chunk order by i, j) as n from ch where c is not null)
select chunk, cast(n as integer) as n, case when c like '%|t' then b else a end as s, split_part(c, '|', 1) as rel, case when c like '%|t' then a else b end as o from rk where n <= 8""".lstrip()),
    "duplicate_candidates": f"""with z0 as (select node_id, entity_type, aliases, lower(trim(coalesce(canonical_name, ''))) as x0 from entities), z1 as (select *, {_CMP0.format('x0')} as z from z0), nd as (select node_id, entity_type, aliases, {_CMP} as n from z1),
al as (select distinct entity_type, node_id, lower(a) as a from (select entity_type, node_id, unnest(aliases) as a from nd) where a is not null and trim(lower(a)) not in ('', '-', 'n/a', 'unknown')),
f as (select least(p.node_id, q.node_id) as id_1, greatest(p.node_id, q.node_id) as id_2, 1 as r from nd p join nd q on p.entity_type = q.entity_type and p.n = q.n and p.node_id <> q.node_id and p.n <> ''
  union all select least(p.node_id, q.node_id), greatest(p.node_id, q.node_id), 2 from nd p join nd q on p.entity_type = q.entity_type and p.node_id <> q.node_id and contains(p.n, q.n) and length(q.n) >= 4
  union all select least(p.node_id, q.node_id), greatest(p.node_id, q.node_id), 3 from al p join al q on p.entity_type = q.entity_type and p.a = q.a and p.node_id <> q.node_id)
select id_1, id_2, case min(r) when 1 then 'name' when 2 then 'substring' else 'alias' end as reason from f group by 1, 2""",
    "pronoun_fill": with_kg(f""", w as (select *, coalesce(case when lower(o) not in {_PN} and ot in ('ThreatActor', 'Campaign') then o end, case when lower(s) not in {_PN} and st in ('ThreatActor', 'Campaign') then s end) as na,
  coalesce(case when lower(o) not in {_PN} and ot in ('Malware', 'Tool') then o end, case when lower(s) not in {_PN} and st in ('Malware', 'Tool') then s end) as nmw from kg),
l as (select *, last_value(na ignore nulls) over p as a, last_value(nmw ignore nulls) over p as m from w window p as (partition by coalesce(chunk, chr(1) || seq) order by seq rows between unbounded preceding and current row))
select seq, case when lower(s) in {_PN} then coalesce(case when st = 'ThreatActor' then a when st in ('Malware', 'Tool') then m end, a, m, s) else s end as s,
  case when lower(o) in {_PN} then coalesce(case when ot = 'ThreatActor' then a when ot in ('Malware', 'Tool') then m end, a, m, o) else o end as o from l""".lstrip()),
}
