"""Queries on texts, examples, vectors and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import retrieve, segment
from spindrift.plans import duck
from spindrift.streaming import flows
from spindrift.tables import table


def sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    parts = segment.sentences(F.col("text"))
    return docs.select("doc_id", F.size(parts).alias("n"), F.coalesce(F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s)), F.lit(0)).alias("chars"))


def focus_sentences(spark: SparkSession, d: str) -> DataFrame:
    return segment.focus_text(table(spark, d, "documents"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.chunks(table(spark, d, "documents"))


def evidence_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of triples that have none, from the text of their chunk."""
    t = table(spark, d, "triples").where("coalesce(trim(evidence_text), '') = '' and subject is not null and object is not null").select("seq", "subject", "object", "source_chunk_id")
    c = table(spark, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return t.join(c, t["source_chunk_id"] == c["chunk_id"]).select("seq", segment.inferred_evidence(F.col("text"), F.col("subject"), F.col("object")).alias("evidence"))


def fewshot_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every document whose id is divisible by 100, against all evaluation items."""
    q = table(spark, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("id"), "text")
    return retrieve.few_shot(q, table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "text"))


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.nearest(v, v.where("id % 100 = 0")).select("q", "e", F.col("rank").alias("place"), F.round("cosine", 4).alias("cosine"))


def nearest_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same by an index of cells."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.indexed_nearest(v, v.where("id % 100 = 0"), cells=16).select("q", "e", F.col("rank").alias("place"), F.round("cosine", 4).alias("cosine"))


def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return retrieve.leaders(v, "label", 0.35)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return flows.hourly_counts(table(spark, d, "events"))


_SENT = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {duck.strip('x')}), lambda x: x <> '')"
_WORDS = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.:\\-]*'), lambda w: lower(w)))"

QUERIES = {f.__name__: f for f in (sentences, focus_sentences, chunks, evidence_backfill, fewshot_topk, nearest_vectors, nearest_indexed, leader_clusters, event_windows)}

_PLAIN = duck.strip("text")
#: Sentences before a capital or a digit, cut where an end mark and white space precede one.
_FOCUS_SENT = f"list_filter(list_transform(string_split(regexp_replace({_PLAIN}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {duck.strip('x')}), lambda x: x <> '')"
_FOCUS_SCORE = "case when length(x) < 45 then -1 else 0 end + " + " + ".join(f"case when regexp_matches(lower(x), {duck.lit(p)}) then {n} else 0 end" for n, p in segment.FOCUS)
_ALL_SENT = f"list_transform(string_split(regexp_replace({duck.strip('c.text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x)"
_HELD = "contains(lower(x), lower({0}))"

SQL = {
    "focus_sentences": f"""with s as (select doc_id, l[i] as x, i from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, {_FOCUS_SENT} as l from documents where text is not null))),
r as (select doc_id, x, i, {_FOCUS_SCORE} as score from s), k as (select *, row_number() over (partition by doc_id order by score desc, i) as n, max(score) over (partition by doc_id) as best from r)
select doc_id, count(*) as n_sentences, string_agg(x, chr(10) order by i) as text from k where case when best > 0 then n <= 6 and score > 0 else i <= 3 end group by 1""",
    "evidence_backfill": f"""with c as (select chunk_id, min(text) as text from chunks where text is not null group by 1), t as (select seq, subject, object, source_chunk_id from triples where coalesce(trim(evidence_text), '') = '' and subject is not null and object is not null),
p as (select seq, subject as s, object as o, {_ALL_SENT} as l from t join c on c.chunk_id = t.source_chunk_id)
select seq, {duck.strip(f"coalesce(list_filter(l, lambda x: {_HELD.format('s')} and {_HELD.format('o')})[1], list_filter(l, lambda x: {_HELD.format('s')} or {_HELD.format('o')})[1], '')")} as evidence from p""",
    "sentences": f"select doc_id, cast(len(s) as integer) as n, cast(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) as integer) as chars from (select doc_id, {_SENT} as s from documents where text is not null)",
    "fewshot_topk": f"""with q as (select doc_id as q, unnest(ws) as w, len(ws) as qn from (select doc_id, {_WORDS} as ws from documents where doc_id % 100 = 0 and text is not null)),
e as (select item_id as e, len, unnest(ws) as w, len(ws) as en from (select item_id, length(text) as len, {_WORDS} as ws from eval_items)),
s as (select q, e, round(cast(0.7 as double) * (count(*) / (qn + en - count(*))) + cast(25 as double) / len, 9) as score from q join e using (w) group by q, e, qn, en, len)
select q, e, score, cast(k as integer) as rank from (select *, row_number() over (partition by q order by score desc, e) as k from s) where k <= 3""",
    "nearest_vectors": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), s as (select a.vec_id as q, b.vec_id as e, round(list_cosine_similarity(a.v, b.v), 6) as c from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
select q, e, cast(k as integer) as place, round(c, 4) as cosine from (select *, row_number() over (partition by q order by c desc, e) as k from s) where k <= 5""",
    "event_windows": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1, 2",
}
