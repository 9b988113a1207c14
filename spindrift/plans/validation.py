"""Queries on validation, repair, rescoring and saliency, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import pipeline, schema
from spindrift.functions import identifiers as ids
from spindrift.operators import relation_repair, salience, validate
from spindrift.plans import duck
from spindrift.tables import table
from spindrift.plans.base import kg
from spindrift.plans.duck import any_of, ladder, listed, pairs, with_kg

POLICY = validate.Policy(least_confidence=0.15)


def validate_core(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: validated triples of all documents, the best of each repeated one, by relation and status."""
    done = validate.keep_best(validate.validate(kg(spark, d), POLICY))
    return done.groupBy("rel", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs"))


def validate_full(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(kg(spark, d), POLICY).select("seq", "s", "st", "rel", "o", "ot", F.round("conf", 6).alias("conf"), "status", "reason", F.size("aids").alias("n_aids"), F.size("log").alias("n_log"))


def validation_log(spark: SparkSession, d: str) -> DataFrame:
    return validate.error_log(validate.validate(kg(spark, d), POLICY)).groupBy("category", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs"))


def pipeline_ablation(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.ablation(kg(spark, d), [pipeline.Steps(pronouns=False, repair=False, validation=False), pipeline.Steps(), pipeline.Steps(rescore_below=0.6, keep_per_document=5)])


def pipeline_nodes(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.graph(kg(spark, d), table(spark, d, "mitre"))[0]


def pipeline_edges(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.graph(kg(spark, d), table(spark, d, "mitre"))[1]


def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    return validate.keep_best(kg(spark, d)).select("seq", "status")


def relation_repaired(spark: SparkSession, d: str) -> DataFrame:
    return relation_repair.repair_relations(kg(spark, d)).select("seq", "rel", "status")


def confidence_rescore(spark: SparkSession, d: str) -> DataFrame:
    return salience.rescore_and_prune(kg(spark, d), 0.6).select("seq", "score", "status", F.round("conf", 6).alias("conf"))


def saliency_topk(spark: SparkSession, d: str) -> DataFrame:
    return salience.most_salient(kg(spark, d), 5).select("seq", "status", F.round("salience", 6).alias("salience"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    return kg(spark, d).select("o").distinct().select(
        "o", ids.refang(o).alias("refanged"), ids.ioc_subtype(o).alias("subtype"), ids.cve(o).alias("cve"), ids.ipv4(o).alias("ipv4"), ids.attack_id(o).alias("attack_id"), ids.type_of_untyped(o).alias("guess"), ids.normal_ioc(o).alias("normal"))


def _refang(c: str) -> str:
    plain = f"replace(replace(regexp_replace({c}, 'hxxp', 'http', 'gi'), '[.]', '.'), '[:]', ':')"
    return f"regexp_replace(regexp_replace({plain}, '\\[at\\]', '@', 'gi'), '\\[dot\\]', '.', 'gi')"


def _m(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {duck.lit(pattern.replace('^(?i)', '(?i)^'))})"


def _subtype(c: str) -> str:
    v = _refang(c)
    return "case " + " ".join(f"when {_m(v, p)} then '{k}'" for k, p in (("ip", ids.IPV4), ("url", ids.URL), ("email", ids.EMAIL), ("domain", ids.DOMAIN), ("hash", ids.HASH))) + " else 'unknown' end"


def _cve(c: str) -> str:
    part = lambda i: f"regexp_extract({c}, {duck.lit(ids.CVE_LOOSE)}, {i})"
    return f"case when {_m(c, ids.CVE)} then upper({c}) when {_m(c, ids.CVE_LOOSE)} then 'CVE-' || {part(1)} || '-' || {part(2)} end"


def _ipv4(c: str) -> str:
    parts = f"list_transform(string_split({_refang(c)}, '.'), lambda p: try_cast(p as integer))"
    return f"case when {_m(_refang(c), ids.IPV4)} and list_max({parts}) <= 255 then array_to_string({parts}, '.') end"


def _normal(c: str) -> str:
    return f"case {_subtype(c)} when 'ip' then coalesce({_ipv4(c)}, {c}) when 'domain' then lower({_refang(c)}) when 'hash' then case when {_m(f'trim({c})', ids.HASH)} then lower(trim({c})) else {c} end else {c} end"


def _guess(c: str) -> str:
    low = f"lower(trim({c}))"
    long = [t for t in schema.TECHNIQUE_NAMES if len(t) > 8]
    return (
        f"case when {_m(c, '(?i)CVE-[0-9]{4}-[0-9]+')} then 'Vulnerability' when {_m(c, ids.IPV4)} or {_m(c, ids.HASH)} or {_m(low, ids.PLAIN_DOMAIN)} or {_m(low, ids.FILE_NAME)} then 'IOC'"
        f" when {_m(f'trim({c})', '^T[0-9]{4}(?:[.][0-9]{3})?$')} then 'Technique' when {low} in {listed(schema.TECHNIQUE_NAMES)} or {any_of(low, long)} or {any_of(low, schema.CRYPTO_HINTS)} then 'Technique'"
        f" when contains({low}, 'extension') or starts_with({low}, '.') then 'File' when {any_of(low, schema.CAMPAIGN_HINTS)} then 'Campaign' when {any_of(low, schema.ACTOR_HINTS)} then 'ThreatActor'"
        f" when len(list_intersect(string_split_regex({low}, '\\s+'), [{listed(ids.SOFTWARE_WORDS)[1:-1]}])) > 0 then 'Software' end"
    )


_AN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _supports(e: str, n: str) -> str:
    e, n = _AN.format(e), _AN.format(n)
    parts, have = f"string_split({n}, ' ')", f"string_split({e}, ' ')"
    return f"({e} <> '' and {n} <> '' and (contains({e}, {n}) or case when len({parts}) = 1 then list_contains({have}, {n}) else len(list_filter({parts}, lambda w: list_contains({have}, w))) / len({parts}) >= 0.6 end))"


_P = schema.TYPE_PAIRS
VALIDATED = f"""{duck.KG},
v1 as (select *, case when s = '' or o = '' then 'empty_field' end as r1,
  contains(lower(s), 'cve') as s_named, contains(lower(o), 'cve') as o_named, {_cve('s')} as s_cve, {_cve('o')} as o_cve from kg),
v2 as (select *, r1 is null and s_named and s_cve is not null and s_cve <> s as s_ch, r1 is null and o_named and o_cve is not null and o_cve <> o as o_ch,
  case when r1 is null and s_named and s_cve is not null then s_cve else s end as s2, case when r1 is null and o_named and o_cve is not null then o_cve else o end as o2 from v1),
v3 as (select *, case when r1 is null and st = 'IOC' then {_normal('s2')} else s2 end as s3, case when r1 is null and ot = 'IOC' then {_normal('o2')} else o2 end as o3 from v2),
v4 as (select *, r1 is null and st = 'Other' as s_open, r1 is null and ot = 'Other' as o_open, {_guess('s3')} as s_guess, {_guess('o3')} as o_guess from v3),
v5 as (select *, case when s_open then coalesce(s_guess, st) else st end as st5, case when o_open then coalesce(o_guess, ot) else ot end as ot5,
  r1 is null and rel = 'communicates_with' and (contains(lower(o3), 'shadow') or contains(lower(o3), 'vss')) as shadow from v4),
v6 as (select *, case when shadow then 'targets' else rel end as rel5 from v5),
v7 as (select *, r1 is null and st5 = 'Organization' and rel5 = 'exploits' and ot5 = 'Vulnerability' and {any_of('lower(ev)', schema.DISCLOSURE_HINTS)} as disclosed from v6),
v8 as (select *, case when disclosed then 'associated_with' else rel5 end as rel8 from v7),
v9 as (select *, case when r1 is not null then r1 when rel8 in ('targets', 'communicates_with') and lower(o3) in {listed(schema.LOW_VALUE)} then 'generic_placeholder' end as r9 from v8),
v10 as (select *, r9 is null and not {pairs('st5', 'rel8', 'ot5', _P)} and {pairs('ot5', 'rel8', 'st5', _P)} as swap,
  r9 is null and not {pairs('st5', 'rel8', 'ot5', _P)} and not {pairs('ot5', 'rel8', 'st5', _P)} as bad from v9),
v11 as (select *, case when swap then o3 else s3 end as s11, case when swap then s3 else o3 end as o11, case when swap then ot5 else st5 end as st11, case when swap then st5 else ot5 end as ot11,
  case when r9 is not null then r9 when bad then 'impossible_type_pair' end as r11 from v10),
v12 as (select *, case when r11 is not null then r11 when lower(s11) = lower(o11) and rel8 in {listed(_P)} then 'self_loop' end as r12 from v11),
v13 as (select *, r12 is null and ev = '' as bare, r12 is null and lower(s11) in {listed(schema.PLACEHOLDERS)} as s_vague, r12 is null and lower(o11) in {listed(schema.PLACEHOLDERS)} as o_vague,
  case when r12 is not null then r12 when lower(o11) in {listed(schema.LOW_VALUE)} then 'generic_placeholder' end as r13 from v12),
v14 as (select *, case when bare then greatest(conf - 0.2, 0.1) else conf end as c1 from v13),
v15 as (select *, case when s_vague then greatest(c1 - 0.3, 0.1) else c1 end as c2 from v14),
v16 as (select *, case when o_vague then greatest(c2 - 0.3, 0.1) else c2 end as c3, length(s11) <= 3 or {_supports('ev', 's11')} as s_in, length(o11) <= 3 or {_supports('ev', 'o11')} as o_in from v15),
v17 as (select *, r13 is null and ev <> '' and not s_in and not o_in as neither, r13 is null and ev <> '' and s_in <> o_in as one_in,
  list_filter(aids, lambda a: {_m('trim(a)', ids.ATTACK_ID)}) as good from v16),
v18 as (select *, case when neither then greatest(c3 - 0.3, 0.1) when one_in then greatest(c3 - 0.1, 0.1) else c3 end as c4 from v17),
v19 as (select *, case when r13 is not null then r13 when c4 <= 0.15 then 'confidence_lowered' end as reason,
  s_ch or o_ch or (s_open and s_guess is not null) or (o_open and o_guess is not null) or shadow or disclosed or swap as fixed from v18),
validated as (select seq, doc, chunk, ev, s11 as s, st11 as st, rel8 as rel, o11 as o, ot11 as ot, c4 as conf, reason, case when reason is not null then 'rejected' when fixed then 'repaired' else 'validated' end as status,
  case when r13 is null then good else aids end as aids,
  list_filter([
    case when r1 is not null then 'empty_field|rejected' end, case when s_ch then 'repaired_identifier|repaired' end, case when r1 is null and s_named and s_cve is null then 'malformed_identifier|flagged' end,
    case when o_ch then 'repaired_identifier|repaired' end, case when r1 is null and o_named and o_cve is null then 'malformed_identifier|flagged' end,
    case when s_open then case when s_guess is null then 'type_misassignment|flagged' else 'repaired_identifier|repaired' end end,
    case when o_open then case when o_guess is null then 'type_misassignment|flagged' else 'repaired_identifier|repaired' end end,
    case when shadow then 'repaired_identifier|repaired' end, case when disclosed then 'repaired_identifier|repaired' end, case when r1 is null and r9 is not null then 'generic_placeholder|rejected' end,
    case when swap then 'repaired_identifier|repaired' end, case when bad then 'impossible_type_pair|rejected' end, case when r11 is null and r12 is not null then 'self_loop|rejected' end,
    case when bare then 'missing_evidence|flagged' end, case when s_vague then 'generic_placeholder|flagged' end, case when o_vague then 'generic_placeholder|flagged' end,
    case when r12 is null and r13 is not null then 'generic_placeholder|rejected' end, case when neither then 'hallucinated_entity|flagged' end, case when one_in then 'confidence_lowered|flagged' end,
    case when r13 is null and c4 <= 0.15 then 'confidence_lowered|rejected' end], lambda x: x is not null)
  || case when r13 is null then list_transform(list_filter(aids, lambda a: not {_m('trim(a)', ids.ATTACK_ID)}), lambda a: 'malformed_identifier|flagged') else [] end as log
  from v19)"""

_BEST = """select * exclude (n) from (select *, row_number() over (partition by doc, lower(s), rel, lower(o) order by conf desc, seq) as n from {0} where status <> 'rejected') where n = 1
  union all select * from {0} where status = 'rejected'"""

_H = schema.HINTS
_CARRIED, _USABLE = "('Malware', 'Tool', 'File')", listed(relation_repair._USABLE)


def _has(*names) -> str:
    return any_of("lower(ev)", [p for n in names for p in (_H[n] if isinstance(n, str) else n)])


_WEAK = "rel in ('associated_with', 'related_to')"
_ORG = "rel = 'exploits' and st = 'Organization' and ot = 'Vulnerability'"
_WRONG = f"""case
  when {_ORG} and {_has(schema.DISCLOSURE_HINTS)} then 'associated_with' when {_ORG} and {_has('mitigated_by', ['release'])} then 'mitigated_by'
  when {_ORG} and not {_has(['exploit', 'abuse', 'attack', 'compromise'])} then 'associated_with' when {_ORG} and {_has(['discover', 'found', 'report', 'analyz', 'identif', 'observ', 'track'])} then 'associated_with'
  when rel = 'exploits' and ot not in ('Vulnerability', 'Software', 'Infrastructure') then case when {_has('targets')} then 'targets' else 'uses' end
  when rel = 'exploits' and st = 'Vulnerability' and ot <> 'Vulnerability' then case when {_has('targets', ['impact'])} then 'targets' else 'associated_with' end
  when {_WEAK} and st in ('Malware', 'Campaign', 'Tool', 'ThreatActor') and ot = 'ThreatActor' and (st in ('Malware', 'Campaign') or {_has('attributed_to', ['linked', 'tied', 'connected', 'operated', 'backed'])}) then 'attributed_to'
  when {_WEAK} and st = 'ThreatActor' and (ot in ('Malware', 'Tool') or (ot = 'Technique' and {_has('uses', ['deploy', 'wield', 'operate'])})) then 'uses'
  when rel in ('related_to', 'exploits', 'associated_with') and st in ('Vulnerability', 'Malware') and ot in ('Technique', 'Other', 'Malware') and {_has('variant_of')} then 'variant_of'
  when rel = 'related_to' and st in ('Campaign', 'Infrastructure', 'IOC') and ot in ('Malware', 'Tool') and {_has('delivers')} then 'delivers'
  when {_WEAK} and st in ('Malware', 'ThreatActor', 'Campaign') and ot in ('Organization', 'Software', 'Location') and {_has('targets')} then 'targets'
  when {_WEAK} and st in ('Malware', 'Campaign') and ot in ('Tool', 'Software', 'Technique', 'File') and {_has('uses', 'drops', 'delivers')} then 'uses' end"""
_FAMILY = " or ".join(f"(ends_with(lower(s), '{e}') and ends_with(lower(o), '{e}'))" for e in relation_repair.FAMILY_ENDINGS)
_EVIDENCE = f"""case when {_has('exploits')} and ot in ('Vulnerability', 'Software', 'Infrastructure') then 'exploits' when {_has('communicates_with')} and ot in ('IOC', 'Infrastructure') then 'communicates_with'
  when {_has('drops')} and ot in {_CARRIED} then 'drops' when {_has('delivers')} and ot in {_CARRIED} then 'delivers' when {_has('uses')} and ot in {_USABLE} then 'uses'
  when {_has('attributed_to')} and ot in ('ThreatActor', 'Organization', 'Location') then 'attributed_to' when {_has('located_in')} and ot = 'Location' then 'located_in'
  when {_has('mitigated_by')} and st in ('Vulnerability', 'Software', 'Organization') then 'mitigated_by' when st = 'Malware' and ot = 'Malware' and ({_has('variant_of')} or (({_FAMILY}) and lower(s) <> lower(o))) then 'variant_of'
  when {_has('targets')} and ot in ('Organization', 'Location', 'Software', 'Infrastructure', 'IOC', 'File', 'Vulnerability', 'Other') then 'targets' end"""
_TYPES = """case when st in ('ThreatActor', 'Organization', 'Infrastructure') and ot = 'Location' then 'located_in' when st in ('ThreatActor', 'Malware', 'Campaign') and ot = 'Technique' then 'uses'
  when st in ('ThreatActor', 'Malware', 'Campaign') and ot in ('Organization', 'Software') then 'targets' when st = 'Malware' and ot = 'Malware' then 'variant_of'
  when st in ('Malware', 'Tool') and ot in ('IOC', 'Infrastructure') then 'communicates_with' end"""


def _squash(c: str) -> str:
    return f"regexp_replace(lower({c}), '{duck.WS}+', ' ', 'g')"


def _spec(c: str) -> str:
    n = f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
    return f"case when length({c}) <= 2 then 0.1 when {n} >= 3 then 1.0 when {n} = 2 then 0.8 when length({c}) >= 5 then 0.7 else 0.4 end"


def _seen(c: str) -> str:
    return f"(contains(lower(ev), lower({c})) or len(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(w) > 3 and contains(lower(ev), w))) > 0)"


_SCORED = f"""scored as (select *, round(cast(0.35 as double) * case when ev = '' then 0.0 when {_seen('s')} and {_seen('o')} then 1.0 when {_seen('s')} or {_seen('o')} then 0.5 else 0.1 end
  + cast(0.15 as double) * (({_spec('s')} + {_spec('o')}) / 2) + cast(0.15 as double) * case rel when 'related_to' then 0.2 when 'associated_with' then 0.4 else 1.0 end
  + cast(0.20 as double) * case when rel in ('related_to', 'associated_with') then 0.5 when {pairs('st', 'rel', 'ot', _P)} then 1.0 else 0.2 end
  + cast(0.15 as double) * (case st when 'Other' then 0.0 else 0.5 end + case ot when 'Other' then 0.0 else 0.5 end), 4) as score from kg)"""
_WEIGHT = "case rel " + " ".join(f"when '{r}' then cast({w} as double)" for r, w in schema.SALIENCE.items()) + " end"

_REPAIRED = f"""r1 as (select *, {_WRONG} as wrong, case when rel = 'uses' then 'uses' when rel = 'drops' then case when ot in {_CARRIED} then 'drops' else 'uses' end
  when ev <> '' and {_has('associated_with')} then 'associated_with' end as weak,
  s <> '' and o <> '' and contains(lower(ev), {_squash('s')}) and contains(lower(ev), {_squash('o')}) as named from kg),
r2 as (select *, case when status = 'rejected' or (ev <> '' and not named) then rel when wrong is not null and wrong <> rel then wrong when rel = 'associated_with' then rel
  when rel <> 'related_to' then coalesce(weak, rel) else coalesce({_EVIDENCE}, {_TYPES}, rel) end as better from r1),
repaired as materialized (select * exclude (better) replace (better as rel, case when better <> rel and status = 'validated' then 'repaired' else status end as status) from r2)"""
_SALIENT = f"""active as (select * replace (coalesce(doc, chr(1) || seq) as doc), lower(s) as sl, lower(o) as ol from kg where status <> 'rejected'),
freq as (select doc, name, count(*) as n from (select doc, sl as name from active union all select doc, ol from active) group by 1, 2), top as (select doc, max(n) as m from freq group by 1),
scored as (select a.seq, a.doc, a.status, round(cast(0.35 as double) * {_WEIGHT} + cast(0.30 as double) * ((f.n + g.n) / 2 / m) + cast(0.15 as double) * case when length(ev) > 0 then least(length(ev) / 200, 1.0) else 0.3 end + cast(0.20 as double) * conf, 9) as sal
  from active a join freq f on f.doc is not distinct from a.doc and f.name = a.sl join freq g on g.doc is not distinct from a.doc and g.name = a.ol join top t on t.doc is not distinct from a.doc),
kept as materialized (select *, row_number() over (partition by doc order by sal desc, seq) as k from scored)"""
_PN = listed(schema.PRONOUNS)
_NAMED = lambda n, t, kinds: f"case when lower({n}) not in {_PN} and {t} in {kinds} then {n} end"
_PUT = lambda n, t: f"case when lower({n}) in {_PN} then coalesce(case when {t} = 'ThreatActor' then a when {t} in ('Malware', 'Tool') then m end, a, m, {n}) else {n} end"
_FILLED = f"""pn as (select *, coalesce({_NAMED('o', 'ot', "('ThreatActor', 'Campaign')")}, {_NAMED('s', 'st', "('ThreatActor', 'Campaign')")}) as na, coalesce({_NAMED('o', 'ot', "('Malware', 'Tool')")}, {_NAMED('s', 'st', "('Malware', 'Tool')")}) as nm from kg),
pl as (select *, last_value(na ignore nulls) over p as a, last_value(nm ignore nulls) over p as m from pn window p as (partition by coalesce(chunk, chr(1) || seq) order by seq rows between unbounded preceding and current row)),
filled as materialized (select * exclude (na, nm, a, m) replace ({_PUT('s', 'st')} as s, {_PUT('o', 'ot')} as o) from pl)"""
#: The validator without a threshold, over the repaired rows.
_CHECKED = VALIDATED[VALIDATED.index("v1 as (") :].replace("from kg", "from repaired").replace("c4 <= 0.15", "false").replace("validated as (", "validated as materialized (")

QUERIES = {
    "validate_core": validate_core, "validate_full": validate_full, "validation_log": validation_log, "pipeline_ablation": pipeline_ablation, "pipeline_nodes": pipeline_nodes, "pipeline_edges": pipeline_edges, "dedup_keep_best": dedup_keep_best, "relation_repair": relation_repaired,
    "confidence_rescore": confidence_rescore, "saliency_topk": saliency_topk, "identifiers": identifiers,
}

SQL = {
    "validate_core": f"with {VALIDATED}\nselect rel, status, count(*) as n, count(distinct doc) as docs from ({_BEST.format('validated')}) group by 1, 2",
    "validate_full": f"with {VALIDATED}\nselect seq, s, st, rel, o, ot, round(conf, 6) as conf, status, reason, cast(len(aids) as integer) as n_aids, cast(len(log) as integer) as n_log from validated",
    "validation_log": f"with {VALIDATED}\nselect split_part(e, '|', 1) as category, split_part(e, '|', 2) as action, count(*) as n, count(distinct doc) as docs from (select doc, unnest(log) as e from validated) group by 1, 2",
    "dedup_keep_best": with_kg(f"select seq, status from ({_BEST.format('kg')})"),
    "relation_repair": f"with {duck.KG}, {_REPAIRED}\nselect seq, rel, status from repaired",
    "pipeline_ablation": f"""with {duck.KG}, {_FILLED}, {_REPAIRED.replace('from kg', 'from filled')}, {_CHECKED}, best as materialized ({_BEST.format('validated')}),
{_SCORED.replace('from kg', 'from best')}, pruned as materialized (select * replace (case when status <> 'rejected' and score < 0.6 then 'rejected' else status end as status, case when status <> 'rejected' and score >= 0.6 then score else conf end as conf) from scored),
{_SALIENT.replace('from kg', 'from pruned').replace('scored as', 'sals as').replace('from scored', 'from sals')}
select 'none' as arm, status, count(*) as n from kg group by all union all select 'P+R+V', status, count(*) from best group by all
union all select 'P+R+V+C+S', status, count(*) from (select status from kept where k <= 5 union all select status from pruned where status = 'rejected') group by all""",
    "confidence_rescore": f"with {duck.KG}, {_SCORED}\nselect seq, score, case when status <> 'rejected' and score < 0.6 then 'rejected' else status end as status, round(case when status <> 'rejected' and score >= 0.6 then score else conf end, 6) as conf from scored",
    "saliency_topk": f"with {duck.KG}, {_SALIENT}\nselect seq, status, round(sal, 6) as salience from kept where k <= 5 union all select seq, status, null from kg where status = 'rejected'",
    "identifiers": with_kg(f"select o, {_refang('o')} as refanged, {_subtype('o')} as subtype, {_cve('o')} as cve, {_ipv4('o')} as ipv4, {_m('trim(o)', ids.ATTACK_ID)} as attack_id, {_guess('o')} as guess, {_normal('o')} as normal from (select distinct o from kg)"),
}
