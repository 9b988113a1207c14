"""Queries on quality, logs, statistics, matching and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions import names as nm
from spindrift.operators import graphs, matching, quality, stats
from spindrift.plans import duck
from spindrift.plans.base import kg
from spindrift.plans.duck import listed, pairs, with_kg
from spindrift.tables import table


def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(kg(spark, d))


def stix_compliance(spark: SparkSession, d: str) -> DataFrame:
    return quality.stix_compliance(kg(spark, d))


def stix_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.stix_violations(kg(spark, d))


def normalization_loss(spark: SparkSession, d: str) -> DataFrame:
    return quality.normalization_loss(kg(spark, d))


def structure_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.structure(kg(spark, d))


def name_hygiene(spark: SparkSession, d: str) -> DataFrame:
    return quality.name_hygiene(kg(spark, d))


def cross_doc_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.cross_document(kg(spark, d))


def corpus_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.histogram(kg(spark, d))


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """The stored log: rejected and repaired deliveries with their reasons, others flagged if they have one."""
    status = F.lower(F.trim("validation_status"))
    return table(spark, d, "triples").where("rejection_reason is not null or lower(trim(validation_status)) in ('rejected', 'repaired')").select(
        F.coalesce("rejection_reason", F.lit("none given")).alias("category"), F.when(status.isin("rejected", "repaired"), status).otherwise("flagged").alias("action"), F.coalesce("source_doc_id", F.lit("")).alias("doc"))


def taxonomy_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.taxonomy(log_entries(spark, d))


def taxonomy_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return quality.taxonomy_crosstab(log_entries(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy(F.col("n_name").alias("system"), F.col("o_orderpriority").alias("protocol")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("score"))


def protocol_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.ranks(_scores(spark, d))


def rank_reversals(spark: SparkSession, d: str) -> DataFrame:
    return stats.reversals(_scores(spark, d))


def pass_variance(spark: SparkSession, d: str) -> DataFrame:
    passes = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("pass")).agg(F.avg(F.col("l_discount").cast("double")).alias("value"))
    return stats.pass_variance(passes)


def effect_2x2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("a"), (F.col("l_returnflag") == "R").cast("int").alias("b"), F.col("l_quantity").cast("double").alias("value"))
    return stats.effects(rows)


def matcher_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = kg(spark, d)
    items = rows.select(F.explode(F.array(*[F.struct(F.lit(f"conf{t}").alias("protocol"), (F.col("conf") >= t / 100).alias("judge")) for t in (50, 80, 95)])).alias("p"), F.when(F.col("rel").isin(schema.GENERIC), "generic").otherwise("specific").alias("type"), F.col("status").isin("validated", "repaired").alias("human"))
    return stats.agreement(items.select("p.protocol", "p.judge", "type", "human"))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions (raw and repaired deliveries) and gold (validated ones), keyed."""
    rows = kg(spark, d)
    return matching.keyed(rows.where("status in ('raw', 'repaired')")), matching.keyed(rows.where("status = 'validated'"))


def exact_match_prf(spark: SparkSession, d: str) -> DataFrame:
    return matching.micro(matching.exact_by_document(*sides(spark, d)))


def pooled_match_prf(spark: SparkSession, d: str) -> DataFrame:
    """The same matcher with all documents pooled: matches across documents count too."""
    pooled = [x.withColumn("doc", F.lit("all")) for x in sides(spark, d)]
    return matching.micro(matching.exact_by_document(*pooled))


def removal_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents' predictions, with and without repaired ones: matches and misses that the removal costs."""
    rows = kg(spark, d)
    gold = matching.keyed(rows.where("status = 'validated'"))
    arm = lambda cond: matching.micro(matching.exact_by_document(matching.keyed(rows.where(cond)), gold)).select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"))
    a, b = arm("status in ('raw', 'repaired')"), arm("status = 'raw'")
    both = a.select(F.col("tp").alias("tp_all"), F.col("fp").alias("fp_all")).crossJoin(b)
    lost, dropped = F.greatest(F.lit(0), F.col("tp_all") - F.col("tp")), F.greatest(F.lit(0), F.col("fp_all") - F.col("fp"))
    return both.select(lost.alias("lost_tp"), dropped.alias("dropped_fp"), F.round(F.when(lost + dropped > 0, dropped / (lost + dropped)).otherwise(0.0), 6).alias("rate"))


def _covered(protocol: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return matching.covered(*sides(spark, d), protocol)

    return run


def _greedy(matcher: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return matching.micro(matching.greedy_by_document(matching.sided(table(spark, d, "triples"), ["raw", "repaired"], ["validated"]), matcher))

    return run


def doc_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.document_components(kg(spark, d))


def main_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.main_nodes(kg(spark, d))


def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graphs.graph_metrics(kg(spark, d))


def simple_digraph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.simple_digraph(kg(spark, d))


def _share(part: str, whole: str, empty: str = "0.0") -> str:
    return f"round(case when {whole} > 0 then {part} / {whole} else {empty} end, 6)"


def _bound(t: dict) -> tuple[str, str]:
    return f"count(*) filter (rel in {listed(t)} and {pairs(chr(39) + 'x' + chr(39), 'rel', 'ot', {r: (['x'], o) for r, o in t.items()})})", f"count(*) filter (rel in {listed(t)})"


_DUP = "(count(*) - (select count(*) from (select distinct lower(s), lower(o) from kg)))"
_STIX = f"sx as (select *, {duck.mapped('st', schema.STIX_TYPES, 'null')} as sst, {duck.mapped('ot', schema.STIX_TYPES, 'null')} as sot, rel in {listed(schema.STIX_PAIRS)} as related from kg)"
_OK = f"(related and sst is not null and sot is not null and {pairs('sst', 'rel', 'sot', schema.STIX_PAIRS)})"
_KEY = "case when length({0}) >= 6 then substr(lower({0}), 1, 12) else lower({0}) end"
_FULL = "ev <> '' and s <> '' and o <> ''"
_ALIGNED = f"{_FULL} and contains(lower(ev), {_KEY.format('s')}) and contains(lower(ev), {_KEY.format('o')})"
_LOG = """lg as (select coalesce(rejection_reason, 'none given') as category, case when lower(trim(validation_status)) in ('rejected', 'repaired') then lower(trim(validation_status)) else 'flagged' end as action, coalesce(source_doc_id, '') as doc
  from triples where rejection_reason is not null or lower(trim(validation_status)) in ('rejected', 'repaired'))"""
_SCORES = "scores as (select n_name as system, o_orderpriority as protocol, round(avg(cast(o_totalprice as double)), 4) as score from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"


def _forms(src: str, dst: str, col: str, out: str) -> str:
    steps = [f"{dst}0 as (select *, lower(trim({col})) as {out}0 from {src})"]
    for i, lead in enumerate(nm.LEADS):
        steps.append(f"{dst}{i + 1} as (select * exclude ({out}{i}), case when starts_with({out}{i}, '{lead}') then substr({out}{i}, {len(lead) + 1}) else {out}{i} end as {out}{i + 1} from {dst}{i})")
    n = len(nm.LEADS)
    squashed = duck.strip(f"regexp_replace({out}{n}, '{duck.WS}+', ' ', 'g')")
    steps.append(f"{dst} as (select * exclude ({out}{n}), {squashed} as {out} from {dst}{n})")
    return ", ".join(steps)


_STEM = "case when ends_with(w, 'ies') and length(w) > 4 then substr(w, 1, length(w) - 3) || 'y' when ends_with(w, 'ses') or ends_with(w, 'xes') or ends_with(w, 'zes') then substr(w, 1, length(w) - 2) when ends_with(w, 's') and not ends_with(w, 'ss') and length(w) > 3 then substr(w, 1, length(w) - 1) else w end"


def _tokens(c: str) -> str:
    stems = f"list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), lambda w: {_STEM})"
    return f"list_distinct(list_transform({stems}, lambda w: {duck.mapped('w', nm.AGENTS, 'w')}))"


KEYED = f"{duck.KG}, {_forms('kg', 'fs', 's', 'ns')}, {_forms('fs', 'fo', 'o', 'no')}, keyed as (select seq, doc, rel, status, ns, no, {_tokens('ns')} as ts, {_tokens('no')} as tok from fo), pred as (select * from keyed where status in ('raw', 'repaired')), gold as (select * from keyed where status = 'validated')"


def _soft(a: str, ta: str, b: str, tb: str) -> str:
    small = f"least(len({ta}), len({tb}))"
    return f"({a} = {b} or contains({b}, {a}) or contains({a}, {b}) or ({small} > 0 and len(list_intersect({ta}, {tb})) / {small} >= 0.5))"


_FORTH = f"({_soft('p.ns', 'p.ts', 'g.ns', 'g.ts')} and {_soft('p.no', 'p.tok', 'g.no', 'g.tok')})"
_BACK = f"({_soft('p.ns', 'p.ts', 'g.no', 'g.tok')} and {_soft('p.no', 'p.tok', 'g.ns', 'g.ts')})"
_COMPAT = f"(p.rel = g.rel or least(p.rel, g.rel) || '/' || greatest(p.rel, g.rel) in {listed('/'.join(sorted(x)) for x in schema.COMPATIBLE_WIDE)})"
_TEST = {"exact": "p.rel = g.rel and p.ns = g.ns and p.no = g.no", "rel_eq": f"p.rel = g.rel and {_FORTH}", "compat": f"{_COMPAT} and ({_FORTH} or {_BACK})", "pair": f"({_FORTH} or {_BACK})"}


def _micro(source: str) -> str:
    p, r = "case when n_pred > 0 then tp / n_pred else 0 end", "case when n_gold > 0 then tp / n_gold else 0 end"
    return f"select tp, n_pred, n_gold, round({p}, 4) as precision, round({r}, 4) as recall, round(case when {p} + {r} > 0 then 2 * ({p}) * ({r}) / (({p}) + ({r})) else 0 end, 4) as f1 from (select cast(sum(tp) as bigint) as tp, cast(sum(n_pred) as bigint) as n_pred, cast(sum(n_gold) as bigint) as n_gold from {source})"


def _exact(where: str, doc: str = "doc") -> str:
    return f"(select doc, sum(case when doc is null then 0 else least(p, g) end) as tp, sum(p) as n_pred, sum(g) as n_gold from (select {doc} as doc, ns, rel, no, count(*) filter ({where}) as p, count(*) filter (status = 'validated') as g from keyed where {where} or status = 'validated' group by all) group by 1)"


def _greedy_sql(test: str) -> str:
    """One pass of the greedy matcher as recursion over each document's predictions in order."""
    return f"""with recursive {KEYED}, pr as (select *, row_number() over (partition by doc order by seq) as i from pred), gr as (select *, row_number() over (partition by doc order by seq) as j from gold),
hits as (select p.doc, p.i, list(g.j order by g.j) as js from pr p join gr g on p.doc = g.doc and {test} group by 1, 2),
walk(doc, i, used) as (select distinct doc, cast(0 as bigint), cast([] as bigint[]) from pr where doc is not null
  union all select w.doc, w.i + 1, case when h.js is null then w.used else w.used || list_filter(h.js, lambda j: not list_contains(w.used, j))[1:1] end
  from walk w join pr p on p.doc = w.doc and p.i = w.i + 1 left join hits h on h.doc = w.doc and h.i = w.i + 1),
tps as (select doc, max(len(used)) as tp from walk group by 1)
{_micro("(select (select sum(tp) from tps) as tp, (select count(*) from pred) as n_pred, (select count(*) from gold) as n_gold)")}"""


_ENDS2 = "ed as (select distinct doc, st || '::' || s as a, ot || '::' || o as b from kg where status <> 'rejected' and doc is not null)"
_CC = f"{_ENDS2}, adj as (select doc, a, b from ed union select doc, b, a from ed), reach(doc, n, m) as (select distinct doc, a, a from adj union select r.doc, r.n, adj.b from reach r join adj on adj.doc = r.doc and adj.a = r.m), cc as (select r.doc, n as node, min(m) as component, (select count(distinct b) from adj where adj.doc = r.doc and adj.a = n) as degree from reach r group by 1, 2)"

#: The components of documents with their sizes and main nodes (t), after ``duck.KG`` in a recursive query.
MAIN = f"{_CC}, t as (select doc, component, count(*) as size, arg_min(node, r) as main_node from (select *, row_number() over (partition by doc, component order by degree desc, node) as r from cc) group by 1, 2)"

QUERIES = {f.__name__: f for f in (
    quality_metrics, stix_compliance, stix_violations, normalization_loss, structure_metrics, name_hygiene, cross_doc_coverage, corpus_histogram, taxonomy_summary, taxonomy_crosstab,
    protocol_ranks, rank_reversals, pass_variance, effect_2x2, matcher_agreement, exact_match_prf, pooled_match_prf, removal_decomposition, doc_components, main_nodes, graph_metrics, simple_digraph)}
QUERIES |= {f"edge_covered_{p}": _covered(p) for p in _TEST} | {f"greedy_f1_{p}": _greedy(p) for p in _TEST} | {"triplet_f1": _greedy("triplet")}

SQL = {
    "quality_metrics": with_kg(f"select count(*) as n, {_share('count(*) filter (rel not in ' + listed(schema.GENERIC) + ')', 'count(*)')} as relation_specificity, {_share('(count(*) filter (st <> {0}) + count(*) filter (ot <> {0}))'.format(chr(39) + 'Other' + chr(39)), '(2 * count(*))')} as type_specificity, {_share(*_bound(schema.QUALITY_OBJECTS), '1.0')} as semantic_validity, {_share(_DUP, 'count(*)')} as duplicate_rate from kg"),
    "stix_compliance": f"with {duck.KG}, {_STIX} select n, no_relation, no_type, scored, compliant, {_share('compliant', 'scored')} as compliance, {_share('scored', 'n')} as coverage from (select count(*) as n, count(*) filter (not related) as no_relation, count(*) filter (related and (sst is null or sot is null)) as no_type, count(*) filter (related and sst is not null and sot is not null) as scored, count(*) filter ({_OK}) as compliant from sx)",
    "stix_violations": f"with {duck.KG}, kc as materialized (select st, rel, ot, count(*) as c from kg group by all), {_STIX.replace('from kg', 'from kc')} select sst || ' -[' || rel || ']-> ' || sot as violation, cast(sum(c) as bigint) as n from sx where related and sst is not null and sot is not null and not {_OK} group by 1 order by n desc, violation limit 10",
    "normalization_loss": with_kg(f"select count(*) as n, {_share('count(*) filter (rel in ' + listed(schema.GENERIC) + ')', 'count(*)')} as generic_rate, {_share('(count(*) filter (st = {0}) + count(*) filter (ot = {0}))'.format(chr(39) + 'Other' + chr(39)), '(2 * count(*))')} as other_rate from kg"),
    "structure_metrics": with_kg(f"select {_share(f'count(*) filter (ev <> {chr(39) * 2})', 'count(*)')} as evidence_presence, count(*) filter ({_ALIGNED}) as aligned, {_share(f'count(*) filter ({_ALIGNED})', f'count(*) filter ({_FULL})')} as alignment, {_share(*_bound(schema.STRUCTURAL_OBJECTS), '1.0')} as type_compliance, {_share(_DUP, 'count(*)')} as duplicate_pairs from kg"),
    "name_hygiene": with_kg(f", nn as (select n, lower(n) as l from (select s as n from kg union all select o from kg) where n <> '') select count(*) as n, round(avg(length(n)), 6) as mean_length, {_share('count(*) filter (length(n) < 3)', 'count(*)')} as too_short, {_share('count(*) filter (' + ' or '.join(f'starts_with(l, {duck.lit(x)})' for x in nm.LEADS) + ')', 'count(*)')} as article, {_share('count(*) filter (l in ' + listed(quality.VAGUE) + ')', 'count(*)')} as vague, {_share('count(*) filter (regexp_matches(n, ' + duck.lit('[:;,.][ ]*$') + '))', 'count(*)')} as punctuation, cast(list_sort(list(length(n)))[cast(floor(count(*) / 2) as bigint) + 1] as integer) as median_length from nn"),
    "cross_doc_coverage": with_kg(f", p as (select n, count(distinct doc) > 1 as many from (select doc, lower(s) as n from kg union all select doc, lower(o) from kg) group by 1) select count(*) as names, count(*) filter (many) as in_many, {_share('count(*) filter (many)', 'count(*)')} as rate from p"),
    "corpus_histogram": with_kg("select kind, value, count(*) as n from (select 'status' as kind, status as value from kg union all select 'relation', rel from kg union all select 'type', st from kg union all select 'type', ot from kg) group by 1, 2"),
    "taxonomy_summary": f"with {_LOG} select case grouping_id(category, action) when 1 then 'category' when 2 then 'action' else 'all' end as level, coalesce(category, action, '') as value, count(*) as n, {_share('count(*) filter (action = {0})'.format(duck.lit('rejected')), 'count(*)')} as rejection_rate, {_share('count(*) filter (action = {0})'.format(duck.lit('repaired')), 'count(*)')} as repair_rate from lg group by grouping sets ((category), (action), ())",
    "taxonomy_crosstab": f"with {_LOG} select category, count(*) filter (action = 'flagged') as flagged, count(*) filter (action = 'repaired') as repaired, count(*) filter (action = 'rejected') as rejected, count(distinct nullif(doc, '')) as docs from lg group by 1",
    "protocol_ranks": f"with {_SCORES} select system, protocol, score, cast(row_number() over (partition by protocol order by score desc, system) as integer) as rank, round(max(score) over (partition by protocol) - min(score) over (partition by protocol), 6) as spread from scores",
    "rank_reversals": f"with {_SCORES} select * from (select x.system as a, y.system as b, count(*) filter (x.score > y.score) as a_wins, count(*) filter (x.score < y.score) as b_wins, round(max(abs(x.score - y.score)), 6) as gap from scores x join scores y on x.protocol = y.protocol and x.system < y.system group by 1, 2) where a_wins > 0 and b_wins > 0",
    "pass_variance": "select arm, count(*) as passes, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as least, round(max(v), 6) as most, round(max(v) - min(v), 6) as range from (select l_linestatus as arm, l_linenumber, avg(cast(l_discount as double)) as v from lineitem group by 1, 2) group by 1",
    "effect_2x2": "with m as (select avg(q) filter (a = 0 and b = 0) as m00, avg(q) filter (a = 0 and b = 1) as m01, avg(q) filter (a = 1 and b = 0) as m10, avg(q) filter (a = 1 and b = 1) as m11 from (select cast(l_linestatus = 'O' as integer) as a, cast(l_returnflag = 'R' as integer) as b, cast(l_quantity as double) as q from lineitem)) select round((m10 + m11 - m00 - m01) / 2, 6) as effect_a, round((m01 + m11 - m00 - m10) / 2, 6) as effect_b, round(m11 - m10 - m01 + m00, 6) as interaction from m",
    "matcher_agreement": with_kg(f", it as (select 'conf' || t as protocol, conf >= t / 100 as judge, case when rel in {listed(schema.GENERIC)} then 'generic' else 'specific' end as type, status in ('validated', 'repaired') as human from kg, (select unnest([50, 80, 95]) as t)) select protocol, coalesce(type, 'all') as type, count(*) as n, count(*) filter (human and judge) as tp, count(*) filter (not human and judge) as fp, count(*) filter (human and not judge) as fn, count(*) filter (not human and not judge) as tn, round(count(*) filter (human = judge) / count(*), 6) as agreement from it group by grouping sets ((protocol), (protocol, type))"),
    "exact_match_prf": f"with {KEYED} {_micro(_exact(chr(115) + 'tatus in (' + duck.lit('raw') + ', ' + duck.lit('repaired') + ')'))}",
    "pooled_match_prf": f"with {KEYED} {_micro(_exact('status in (' + duck.lit('raw') + ', ' + duck.lit('repaired') + ')', duck.lit('all')))}",
    "removal_decomposition": f"with {KEYED}, x as (select sum(tp) as tp, sum(n_pred) as n from {_exact('status in (' + duck.lit('raw') + ', ' + duck.lit('repaired') + ')')}), y as (select sum(tp) as tp, sum(n_pred) as n from {_exact('status = ' + duck.lit('raw'))}), z as (select cast(greatest(0, x.tp - y.tp) as bigint) as lost_tp, cast(greatest(0, x.n - x.tp - (y.n - y.tp)) as bigint) as dropped_fp from x, y) select lost_tp, dropped_fp, {_share('dropped_fp', '(lost_tp + dropped_fp)')} as rate from z",
    "doc_components": f"with recursive {duck.KG}, {_CC} select * from cc",
    "main_nodes": f"with recursive {duck.KG}, {MAIN} select *, cast(row_number() over (partition by doc order by size desc, component) as integer) as rank from t",
    "graph_metrics": with_kg(f", e as (select count(*) as edges, count(*) filter (status in ('validated', 'repaired')) as accepted, count(*) filter (status = 'rejected') as rejected, round(avg(case when ev = '' then 0 else len(string_split(ev, ' | ')) end), 6) as evidence from kg), n as (select count(*) as nodes, count(*) filter (not linked) as isolated from (select n, max(status in ('validated', 'repaired')) as linked from (select lower(s) as n, status from kg union all select lower(o), status from kg) group by 1)) select nodes, edges, accepted, rejected, isolated, evidence, {_share('accepted', 'edges')} as accepted_rate, {_share('isolated', 'nodes')} as isolated_rate, round(accepted / (nodes * (nodes - 1)), 12) as density from e, n"),
    "simple_digraph": with_kg("select lower(s) as src, lower(o) as dst, arg_max(rel, seq) as rel, count(*) as parallel from kg where status in ('validated', 'repaired') group by 1, 2"),
} | {f"edge_covered_{p}": f"with {KEYED} select seq from pred p where exists (select 1 from gold g where g.doc = p.doc and {t})" for p, t in _TEST.items()} | {f"greedy_f1_{p}": _greedy_sql(t) for p, t in _TEST.items()}
