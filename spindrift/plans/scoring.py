"""Queries on scores of triples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.names import node_id
from spindrift.operators import matching, quality, scoring
from spindrift.plans import duck
from spindrift.plans.base import kg
from spindrift.plans.duck import listed, with_kg
from spindrift.plans.quality import _BACK, _COMPAT, _FORTH, KEYED, _forms, _micro, _tokens, log_entries, sides
from spindrift.sources import responses
from spindrift.tables import table

PREDICTED = "status in ('raw', 'repaired')"
GOLD = "status = 'validated'"
JUDGE, SCORER = "judge", "entailment"
EMBED_LEAST = 0.3


def extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = kg(spark, d)
    return scoring.extraction_metrics(rows.where(PREDICTED), rows.where(GOLD))


def entity_type_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = kg(spark, d)
    return scoring.entity_type_f1(rows.where(PREDICTED), rows.where(GOLD))


def document_f1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.document_scores(matching.exact_by_document(*sides(spark, d)))


def document_winners(spark: SparkSession, d: str) -> DataFrame:
    """Of three systems (raw, repaired, both) the best of each document with gold."""
    rows = matching.keyed(kg(spark, d).withColumn("doc", F.when(F.col("status") != "rejected", F.col("doc")))).join(kg(spark, d).select("seq", "status"), "seq")
    gold = rows.where(GOLD)
    systems = {"raw": "status = 'raw'", "repaired": "status = 'repaired'", "both": PREDICTED}
    out = None
    for name, cond in systems.items():
        part = scoring.document_scores(matching.exact_by_document(rows.where(cond), gold)).select("doc", F.lit(name).alias("system"), "f1")
        out = part if out is None else out.unionByName(part)
    return scoring.document_winners(out)


def _greedy(matcher: str, stemmed: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges = matching.sided(table(spark, d, "triples"), ["raw", "repaired"], ["validated"], named=False)
        return matching.micro(matching.greedy_by_document(edges, matcher, stemmed, named=False))

    return run


def judge_f1(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a judge by a rule: an edge is right if the other side of its document has it. Documents
    whose name ends in 7 have no answer, those in 3 an unreadable one."""
    rows = kg(spark, d)
    pred, gold = rows.where(PREDICTED), rows.where(GOLD)
    articles = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("doc"), "text")
    asked = scoring.payloads(pred, gold, articles, ("Judge the predictions.", "Judge what was found."))
    key = ["doc", "s", "rel", "o"]

    def said(these: DataFrame, those: DataFrame) -> DataFrame:
        marked = these.where("doc is not null").join(those.select(*key, F.lit(1).alias("hit")).distinct(), key, "left")
        verdict = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("hit") == 1, "TP").otherwise("FP").alias("result"))))
        body = F.to_json(F.transform(verdict, lambda x: F.struct(x["result"].alias("result"))))
        return marked.groupBy("doc").agg(F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))

    stored = None
    for side, these, those in (("precision", pred, gold), ("recall", gold, pred)):
        part = asked.join(said(these, those), "doc").where("doc not like '%7'").select(
            responses.prompt_key(F.lit(JUDGE), F.col(f"{side}_prompt")).alias("key"), F.when(F.col("doc").endswith("3"), "I cannot tell.").otherwise(F.col("response")).alias("response"))
        stored = part if stored is None else stored.unionByName(part)
    return scoring.judge_f1(asked, stored, JUDGE)


def entailed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Stored probabilities by a rule: equal subjects entail, equal objects less so; pairs whose edge is
    related_to have none."""
    rows = kg(spark, d)
    pred, gold = rows.where(PREDICTED), rows.where(GOLD)
    said = responses.verbalize(F.col("s"), F.col("rel"), F.col("o"))
    a = pred.where("doc is not null and rel <> 'related_to'").select("doc", said.alias("h"), F.lower("s").alias("s"), F.lower("o").alias("o")).distinct()
    b = gold.where("doc is not null").select("doc", said.alias("p"), F.lower("s").alias("gs"), F.lower("o").alias("go")).distinct()
    value = F.when(F.col("s") == F.col("gs"), 0.9).when(F.col("o") == F.col("go"), 0.6).otherwise(0.1)
    stored = a.join(b, "doc").groupBy(responses.pair_key(F.lit(SCORER), F.col("p"), F.col("h")).alias("key")).agg(F.max(value).alias("probability"))
    return scoring.entailed(pred, gold, stored, SCORER)


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as edges of items of twenty: even ids are predicted, odd ones gold."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("item"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


def embed_covered(spark: SparkSession, d: str) -> DataFrame:
    return matching.embed_covered(*_items(spark, d), EMBED_LEAST)


def max_matching(spark: SparkSession, d: str) -> DataFrame:
    return matching.embed_matches(*_items(spark, d), EMBED_LEAST)


def canonicalization_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of all triples against those of the accepted ones."""
    rows = kg(spark, d)
    ids = lambda df: df.select(F.explode(F.array(node_id(F.col("st"), F.col("s")), node_id(F.col("ot"), F.col("o")))).alias("node_id")).distinct()
    return scoring.canonicalization(ids(rows), ids(rows.where("status in ('validated', 'repaired')")))


def taxonomy_by_run(spark: SparkSession, d: str) -> DataFrame:
    """The stored log by the last digit of its document as the run, even and odd ones as two servings."""
    digit = F.right("doc", F.lit(1))
    log = log_entries(spark, d).where(digit.rlike("[0-9]")).select(digit.alias("run"), F.when(digit.cast("int") % 2 == 0, "hosted").otherwise("local").alias("serving"), "category", "action")
    return quality.taxonomy_by_run(log, ["impossible type pair"])


QUERIES = {f.__name__: f for f in (extraction_metrics, entity_type_f1, document_f1, document_winners, judge_f1, entailed_edges, embed_covered, max_matching, canonicalization_metrics, taxonomy_by_run)}
QUERIES |= {"swapped_pair_f1": _greedy("swapped", False), "strict_f1": _greedy("strict", False)}


def _soft(a: str, b: str, share: float) -> str:
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    small = f"least(len({words(a)}), len({words(b)}))"
    return f"({a} = {b} or contains({b}, {a}) or contains({a}, {b}) or ({small} > 0 and len(list_intersect({words(a)}, {words(b)})) / {small} >= {share}))"


def _class(col: str) -> str:
    return duck.mapped(col, schema.TYPE_CLASSES, col)


_NARROW = listed("/".join(sorted(x)) for x in schema.COMPATIBLE)
_SAME = lambda i, j: _soft(f"p.k{i}", f"g.k{j}", 0.6)
_REL = f"(p.k3 = g.k3 or p.level = 'triple_compat' and least(p.k3, g.k3) || '/' || greatest(p.k3, g.k3) in {_NARROW})"
_LEVEL = f"""case when p.level in ('entity', 'triple_relaxed') then p.k2 = g.k2 and {_SAME(1, 1)} when p.level = 'entity_name_only' then {_SAME(1, 1)}
  when p.level = 'relation' then p.k2 = g.k2 and ({_SAME(1, 1)} and {_SAME(3, 3)} or {_SAME(1, 3)} and {_SAME(3, 1)})
  else {_REL} and (p.k2 = g.k2 and p.k5 = g.k5 and {_SAME(1, 1)} and {_SAME(4, 4)} or p.k2 = g.k5 and p.k5 = g.k2 and {_SAME(1, 4)} and {_SAME(4, 1)}) end"""
_LEVEL_KEYS = " union ".join(
    f"select '{level}' as level, doc, gold, {', '.join(keys + ['cast(null as varchar)'] * (5 - len(keys)))} from ff"
    for level, keys in (
        ("entity", ["ns", "cs"]), ("entity", ["no", "co"]), ("entity_name_only", ["ns"]), ("entity_name_only", ["no"]), ("relation", ["ns", "rel", "no"]),
        ("triple", ["ns", "cs", "rel", "no", "co"]), ("triple_compat", ["ns", "cs", "rel", "no", "co"]), ("triple_relaxed", ["ns", "no"]),
    ))
_METRICS = f"""with recursive {duck.KG}, {_forms('kg', 'fs', 's', 'ns')}, {_forms('fs', 'fo', 'o', 'no')},
ff as (select doc, rel, ns, no, {_class('st')} as cs, {_class('ot')} as co, {GOLD} as gold from fo where doc is not null and ({PREDICTED} or {GOLD})),
keys(level, doc, gold, k1, k2, k3, k4, k5) as ({_LEVEL_KEYS}),
own as materialized (select level, doc, k1, k2, k3, k4, k5, bool_or(not gold) as p, bool_or(gold) as g from keys group by all),
pr as materialized (select *, row_number() over (partition by level, doc order by k1, k2, k3, k4, k5) as i from own where p and not g),
gr as materialized (select *, row_number() over (partition by level, doc order by k1, k2, k3, k4, k5) as j from own where g and not p),
hits as materialized (select p.level, p.doc, p.i, list(g.j order by g.j) as js from pr p join gr g on p.level = g.level and p.doc = g.doc and {_LEVEL} group by 1, 2, 3),
walk(level, doc, i, used) as (select distinct level, doc, cast(0 as bigint), cast([] as bigint[]) from pr
  union all select w.level, w.doc, w.i + 1, case when h.js is null then w.used else w.used || list_filter(h.js, lambda j: not list_contains(w.used, j))[1:1] end
  from walk w join pr p on p.level = w.level and p.doc = w.doc and p.i = w.i + 1 left join hits h on h.level = w.level and h.doc = w.doc and h.i = w.i + 1),
soft as (select level, sum(n) as n from (select level, doc, max(len(used)) as n from walk group by 1, 2) group by 1),
sums as (select level, count(*) filter (p and g) + coalesce(max(s.n), 0) as tp, count(*) filter (p) as n_pred, count(*) filter (g) as n_gold from own left join soft s using (level) group by 1)"""
_P, _R = "case when n_pred > 0 then tp / n_pred else 0 end", "case when n_gold > 0 then tp / n_gold else 0 end"
_PRF = f"round({_P}, 4) as precision, round({_R}, 4) as recall, round(case when {_P} + {_R} > 0 then 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) else 0 end, 4) as f1"


def chained(passes: list[str], keyed: str = KEYED) -> str:
    """The greedy matcher of several passes: each walks over what the passes before it left free."""
    ctes = ["p0 as (select *, row_number() over (partition by doc order by seq) as i0 from pred where doc is not null)", "g0 as (select *, row_number() over (partition by doc order by seq) as j0 from gold where doc is not null)"]
    for n, test in enumerate(passes):
        ctes += [
            f"pr{n} as materialized (select *, row_number() over (partition by doc order by i0) as i from p{n})", f"gr{n} as materialized (select *, row_number() over (partition by doc order by j0) as j from g{n})",
            f"hits{n} as materialized (select p.doc, p.i, list(g.j order by g.j) as js from pr{n} p join gr{n} g on p.doc = g.doc and {test} group by 1, 2)",
            f"""walk{n}(doc, i, used, hit) as (select distinct doc, cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]) from pr{n}
  union all select doc, i, used || new, case when len(new) > 0 then hit || [i] else hit end from (select w.doc, w.i + 1 as i, w.used, w.hit, coalesce(list_filter(h.js, lambda j: not list_contains(w.used, j))[1:1], cast([] as bigint[])) as new
  from walk{n} w join pr{n} p on p.doc = w.doc and p.i = w.i + 1 left join hits{n} h on h.doc = w.doc and h.i = w.i + 1))""",
            f"end{n} as (select doc, arg_max(used, i) as used, arg_max(hit, i) as hit from walk{n} group by 1)",
            f"p{n + 1} as (select p.* exclude (i) from pr{n} p join end{n} e using (doc) where not list_contains(e.hit, p.i))",
            f"g{n + 1} as (select g.* exclude (j) from gr{n} g left join end{n} e using (doc) where e.used is null or not list_contains(e.used, g.j))",
        ]
    tp = " + ".join(f"coalesce((select sum(len(used)) from end{n}), 0)" for n in range(len(passes)))
    return f"with recursive {keyed}, {', '.join(ctes)}\n" + _micro(f"(select {tp} as tp, (select count(*) from pred) as n_pred, (select count(*) from gold) as n_gold)")


_PLAIN = f"{duck.KG}, {_forms('kg', 'fs', 's', 'ns')}, {_forms('fs', 'fo', 'o', 'no')}, keyed as (select seq, doc, rel, status, ns, no from fo), pred as (select * from keyed where {PREDICTED}), gold as (select * from keyed where {GOLD})"
_N = lambda a, b: _soft(a, b, 0.5)
_TYPED = f"""{duck.KG}, {_forms('kg', 'fs', 's', 'ns')}, {_forms('fs', 'fo', 'o', 'no')},
e as (select doc, ns as name, {_class('st')} as class, seq * 2 as pos, status from fo where doc is not null union all select doc, no, {_class('ot')}, seq * 2 + 1, status from fo where doc is not null),
p as (select doc, name, arg_max(class, pos) as class from e where {PREDICTED} group by 1, 2), g as (select doc, name, min(pos) as pos, arg_max(class, pos) as class from e where {GOLD} group by 1, 2)"""


def _stem_soft(a: str, b: str) -> str:
    small = f"least(len({a}.w), len({b}.w))"
    return f"({a}.name = {b}.name or contains({b}.name, {a}.name) or contains({a}.name, {b}.name) or ({small} > 0 and len(list_intersect({a}.w, {b}.w)) / {small} >= 0.5))"


_SENT = "s || ' ' || " + duck.mapped("rel", responses.SENTENCES, "replace(rel, '_', ' ')") + " || ' ' || o || '.'"
_ITEM = "list_transform(embedding, lambda x: cast(x as double))"
_LOG_RUNS = """lg as (select coalesce(rejection_reason, 'none given') as category, case when lower(trim(validation_status)) in ('rejected', 'repaired') then lower(trim(validation_status)) else 'flagged' end as action, right(coalesce(source_doc_id, ''), 1) as run
  from triples where rejection_reason is not null or lower(trim(validation_status)) in ('rejected', 'repaired')), lr as (select * from lg where regexp_matches(run, '^[0-9]$')),
top as (select category from lr group by 1 order by count(*) desc, category limit 6),
rn as (select run, case when cast(run as integer) % 2 = 0 then 'hosted' else 'local' end as serving, count(*) as n, count(*) filter (action = 'rejected') / count(*) as rej, count(*) filter (category = 'impossible type pair') / count(*) as dis from lr group by 1, 2),
tp as (select run, string_agg(category || '=' || printf('%.3f', c / n), '|' order by category) as top from (select run, category, count(*) as c from lr where category in (select category from top) group by 1, 2) join rn using (run) group by 1)"""
SQL = {
    "extraction_metrics": f"{_METRICS} select level, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_gold - tp as bigint) as fn, {_PRF} from sums",
    "entity_type_f1": f"""with {_TYPED}, pw as (select *, {_tokens('name')} as w from p), gw as (select *, {_tokens('name')} as w from g),
took as (select p.doc, p.name, any_value(p.class) as class, arg_min(g.class, g.pos) as meant from pw p left join gw g on p.doc = g.doc and {_stem_soft('p', 'g')} group by 1, 2),
s as (select count(meant) as matched, count(*) filter (meant = class) as correct, count(*) as n, (select count(*) from gw g where not exists (select 1 from pw p where p.doc = g.doc and {_stem_soft('p', 'g')})) as missed from took),
t as (select *, correct as tp, n as n_pred, matched + missed as n_gold from s) select matched, correct, round(case when matched > 0 then correct / matched else 0 end, 4) as accuracy, {_PRF} from t""",
    "document_f1": f"with {KEYED}, t as (select doc, cast(sum(least(p, g)) as bigint) as tp, cast(sum(p) as bigint) as n_pred, cast(sum(g) as bigint) as n_gold from (select doc, ns, rel, no, count(*) filter ({PREDICTED}) as p, count(*) filter ({GOLD}) as g from keyed where doc is not null and ({PREDICTED} or {GOLD}) group by all) group by 1) select doc, tp, n_pred, n_gold, {_PRF} from t",
    "document_winners": f"""with {KEYED}, k as (select doc, ns, rel, no, count(*) filter ({GOLD}) as g, count(*) filter (status = 'raw') as a, count(*) filter (status = 'repaired') as b from keyed where doc is not null and status <> 'rejected' group by all),
t as (select doc, 'raw' as system, sum(least(a, g)) as tp, sum(a) as n_pred, sum(g) as n_gold from k group by 1 union all select doc, 'repaired', sum(least(b, g)), sum(b), sum(g) from k group by 1 union all select doc, 'both', sum(least(a + b, g)), sum(a + b), sum(g) from k group by 1),
f as (select doc, system, {_PRF} from t where n_pred > 0 or n_gold > 0), m as (select *, max(f1) over (partition by doc) as best from f)
select winner, count(*) as documents from (select doc, case when count(*) filter (f1 >= best - cast(0.01 as double)) = 1 and max(best) > 0 then arg_max(system, f1) else 'tie' end as winner from m group by 1) group by 1""",
    "judge_f1": with_kg(f""", p as (select * from kg where {PREDICTED}), g as (select * from kg where {GOLD} and doc is not null), docs as (select distinct doc from g),
t as (select (select count(*) from p where doc in (select doc from docs)) as n_pred, (select count(*) from g) as n_gold,
  (select count(*) from p where doc not like '%7' and doc not like '%3' and exists (select 1 from g where g.doc = p.doc and g.s = p.s and g.rel = p.rel and g.o = p.o)) as precision_tp,
  (select count(*) from g where doc not like '%7' and doc not like '%3' and exists (select 1 from p where g.doc = p.doc and g.s = p.s and g.rel = p.rel and g.o = p.o)) as recall_tp),
u as (select *, precision_tp / n_pred as a, recall_tp / n_gold as b from t) select precision_tp, recall_tp, n_pred, n_gold, round(a, 4) as precision, round(b, 4) as recall, round(case when a + b > 0 then 2 * a * b / (a + b) else 0 end, 4) as f1 from u""".lstrip()),
    "entailed_edges": with_kg(f""", p as (select *, {_SENT} as h from kg where {PREDICTED}), g as (select *, {_SENT} as e from kg where {GOLD} and doc is not null),
st as (select h, e, max(case when lower(p.s) = lower(g.s) then 0.9 when lower(p.o) = lower(g.o) then 0.6 else 0.1 end) as v from p join g on p.doc = g.doc where p.rel <> 'related_to' group by 1, 2),
m as (select p.seq, cast(max(v) as double) as top from p join g on p.doc = g.doc join st on st.h = p.h and st.e = g.e group by 1) select seq, top, coalesce(top >= 0.5, false) as covered from p left join m using (seq)""".lstrip()),
    "embed_covered": f"""with v as (select cast(floor(vec_id / 20) as bigint) as item, vec_id as id, {_ITEM} as v from embeddings), a as (select * from v where id % 2 = 0), b as (select * from v where id % 2 = 1)
select a.item, a.id as p, coalesce(round(max(list_cosine_similarity(a.v, b.v)), 6) >= {EMBED_LEAST}, false) as covered from a left join b on a.item = b.item group by 1, 2""",
    "canonicalization_metrics": with_kg(""", e as (select {0} as id, status from kg union all select {1}, status from kg), n as (select id, bool_or(status in ('validated', 'repaired')) as g from e group by 1),
t as (select count(*) filter (g) as tp, count(*) as n_pred, count(*) filter (g) as n_gold from n) select tp, n_pred, n_gold, {2}, n_pred - n_gold as reduction, round(100 * (n_pred - n_gold) / n_pred, 2) as reduction_percent from t""".format(
        *[f"lower({t}) || ':' || translate(replace(lower(trim({n})), ' ', '_'), '()''\",;', '')" for t, n in (("st", "s"), ("ot", "o"))], _PRF)),
    "taxonomy_by_run": f"with {_LOG_RUNS} select run, serving, n, round(rej, 6) as rejected, round(dis, 6) as disputed, round(avg(dis) over (partition by serving), 6) as serving_mean, coalesce(top, '') as top from rn left join tp using (run)",
    "swapped_pair_f1": chained([f"{_N('p.ns', 'g.ns')} and {_N('p.no', 'g.no')}", f"{_N('p.ns', 'g.no')} and {_N('p.no', 'g.ns')}"], _PLAIN),
    "strict_f1": chained([f"{_N('p.ns', 'g.ns')} and {_N('p.no', 'g.no')} and {_N('p.rel', 'g.rel')}"], _PLAIN),
    "triplet_f1": chained(["p.rel = g.rel and p.ns = g.ns and p.no = g.no", f"p.rel = g.rel and {_FORTH}", f"{_COMPAT} and ({_FORTH} or {_BACK})"]),
}
