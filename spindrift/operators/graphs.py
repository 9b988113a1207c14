"""Graphs of documents: components, main nodes, metrics of the whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators.quality import share


def document_edges(kg: DataFrame) -> DataFrame:
    """doc, a, b: the typed ends of the rows not rejected."""
    end = lambda t, n: F.concat(t, F.lit("::"), n)
    return kg.where("status <> 'rejected' and doc is not null").select("doc", end("st", "s").alias("a"), end("ot", "o").alias("b")).distinct()


def _components(doc: pd.DataFrame) -> pd.DataFrame:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(doc["a"], doc["b"]):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"doc": doc["doc"].iloc[0], "node": list(parent), "component": [root(x) for x in parent]})


def document_components(kg: DataFrame) -> DataFrame:
    """doc, node, component (its smallest node), degree (distinct neighbours). A document's graph is
    one text's triples; the union-find runs over it as a group."""
    edges = document_edges(kg)
    found = edges.groupBy("doc").applyInPandas(_components, "doc string, node string, component string")
    ends = edges.select("doc", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select("doc", F.col("b").alias("node"), F.col("a").alias("other")))
    degree = ends.groupBy("doc", "node").agg(F.countDistinct("other").alias("degree"))
    return found.join(degree, ["doc", "node"])


def main_nodes(kg: DataFrame) -> DataFrame:
    """For each document the size and main node (highest degree, then name) of its components, the
    largest first: rank 1 is the topic, others are candidates for links to it."""
    parts = document_components(kg)
    top = parts.groupBy("doc", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("degree")).alias("d"), "node"))["node"].alias("main_node"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("size"), "component")))


def graph_metrics(kg: DataFrame) -> DataFrame:
    """Nodes, edges and density of the whole, accepted share, mean pieces of evidence, isolated nodes."""
    n = F.count(F.lit(1))
    accepted = F.col("status").isin("validated", "repaired")
    edges = kg.agg(n.alias("edges"), F.count_if(accepted).alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.round(F.avg(F.when(F.col("ev") == "", 0).otherwise(F.size(F.split("ev", r" \| ")))), 6).alias("evidence"))
    ends = kg.select(accepted.alias("ok"), F.explode(F.array(F.lower("s"), F.lower("o"))).alias("n")).groupBy("n").agg(F.max("ok").alias("linked"))
    nodes = ends.agg(n.alias("nodes"), F.count_if(~F.col("linked")).alias("isolated"))
    both = edges.crossJoin(F.broadcast(nodes))
    return both.select("nodes", "edges", "accepted", "rejected", "isolated", "evidence", share(F.col("accepted"), F.col("edges")).alias("accepted_rate"), share(F.col("isolated"), F.col("nodes")).alias("isolated_rate"), F.round(F.when(F.col("nodes") > 1, F.col("accepted") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 12).alias("density"))


def simple_digraph(kg: DataFrame) -> DataFrame:
    """src, dst and relation of the accepted edges; of parallel ones the last."""
    return kg.where("status in ('validated', 'repaired')").groupBy(F.lower("s").alias("src"), F.lower("o").alias("dst")).agg(F.max_by("rel", "seq").alias("rel"), F.count(F.lit(1)).alias("parallel"))
