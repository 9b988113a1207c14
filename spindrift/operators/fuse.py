"""Graphs of documents fused into one: nodes, edges, provenance. Nothing is gathered per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.names import node_id


def mentions(kg: DataFrame) -> DataFrame:
    """node_id, name, type, mention (document:chunk), seq and side of both ends of rows not rejected."""
    ends = [F.struct(F.lit(i).alias("side"), F.col(t).alias("type"), F.col(n).alias("name")) for i, t, n in ((0, "st", "s"), (1, "ot", "o"))]
    rows = kg.where("status <> 'rejected'").select("seq", F.concat_ws(":", "doc", "chunk").alias("mention"), F.explode(F.array(*ends)).alias("e"))
    return rows.select("seq", "mention", "e.*").withColumn("node_id", node_id(F.col("type"), F.col("name")))


def entity_map(kg: DataFrame) -> DataFrame:
    """node_id, canonical_name (its first spelling), type, n_mentions, aliases (other spellings, by
    first appearance).

    Spellings and mentions are made distinct by partial aggregation first: a node that a third of
    all rows name reaches the last step as a few rows.
    """
    rows = mentions(kg)
    spelled = rows.groupBy("node_id", "name").agg(F.min(F.struct("seq", "side", "type")).alias("at"))
    nodes = spelled.groupBy("node_id").agg(F.min_by("name", "at").alias("canonical_name"), F.min("at")["type"].alias("type"), F.array_sort(F.collect_list(F.struct("at", "name"))).alias("all"))
    counted = rows.select("node_id", "mention").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    names = F.transform("all", lambda x: x["name"])
    return nodes.join(counted, "node_id").select("node_id", "canonical_name", "type", "n_mentions", F.array_join(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), " | ").alias("aliases"))


def fuse_edges(kg: DataFrame, least: float = 0.5, bonus: float = 0.05) -> DataFrame:
    """One edge for each subject, relation and object (letter case ignored) of the rows not rejected
    with a confidence of ``least``: the row of highest confidence (the first of equals), the number
    of rows and documents (rows without one count as one document more), and its confidence raised by
    ``bonus`` for every further document."""
    kept = kg.where((F.col("status") != "rejected") & (F.col("conf") >= least))
    edges = kept.groupBy(F.lower("s").alias("ks"), "rel", F.lower("o").alias("ko")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.coalesce("doc", F.lit(""))).alias("docs"), F.max("conf").alias("top"), F.max_by("seq", F.struct("conf", -F.col("seq"))).alias("seq"))
    return edges.select("ks", "rel", "ko", "seq", "rows", "docs", F.round(F.least(F.lit(1.0), F.col("top") + bonus * F.greatest(F.col("docs") - 1, F.lit(0))), 6).alias("conf"))


def edge_evidence(kg: DataFrame) -> DataFrame:
    """ks, rel, ko, position and evidence: the distinct evidence of every edge by first appearance."""
    kept = kg.where("status <> 'rejected' and ev <> ''")
    texts = kept.groupBy(F.lower("s").alias("ks"), "rel", F.lower("o").alias("ko"), F.col("ev").alias("evidence")).agg(F.min("seq").alias("first"))
    return texts.select("ks", "rel", "ko", F.row_number().over(Window.partitionBy("ks", "rel", "ko").orderBy("first")).alias("position"), "evidence")


def provenance(kg: DataFrame) -> DataFrame:
    """node_id and the number of documents, chunks and triples that speak of it."""
    ends = mentions(kg).select("node_id", "seq", F.split_part("mention", F.lit(":"), F.lit(1)).alias("doc"), "mention")
    return ends.groupBy("node_id").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("mention").alias("chunks"), F.countDistinct("seq").alias("triples"))


def retention(records: DataFrame) -> DataFrame:
    """By element type: the number of records and the share of those with a source document; 0 if none."""
    has = F.coalesce(F.size("source_doc_ids") > 0, F.lit(False))
    return records.groupBy("element_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(has.cast("double")), F.lit(0.0)), 6).alias("retention"))
