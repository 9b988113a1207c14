"""Confidence from symbolic signals, and the most salient triples of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift import schema
from spindrift.functions.columns import allowed_pair, words


def _specificity(name: Column) -> Column:
    n = F.size(words(name))
    return F.when(F.length(name) <= 2, 0.1).when(n >= 3, 1.0).when(n == 2, 0.8).when(F.length(name) >= 5, 0.7).otherwise(0.4)


def rescored(kg: DataFrame) -> DataFrame:
    """``kg`` with ``score``, the weighted signals of evidence, names, relation and types."""
    ev, rel = F.lower("ev"), F.col("rel")
    seen = lambda c: ev.contains(F.lower(c)) | F.exists(words(F.lower(c)), lambda w: (F.length(w) > 3) & ev.contains(w))
    evidence = F.when(ev == "", 0.0).when(seen("s") & seen("o"), 1.0).when(seen("s") | seen("o"), 0.5).otherwise(0.1)
    names = (_specificity(F.col("s")) + _specificity(F.col("o"))) / 2
    relation = F.when(rel == "related_to", 0.2).when(rel == "associated_with", 0.4).otherwise(1.0)
    pair = F.when(rel.isin(schema.GENERIC), 0.5).when(allowed_pair(F.col("st"), rel, F.col("ot"), schema.TYPE_PAIRS), 1.0).otherwise(0.2)
    types = F.when(F.col("st") == "Other", 0.0).otherwise(0.5) + F.when(F.col("ot") == "Other", 0.0).otherwise(0.5)
    return kg.withColumn("score", F.round(0.35 * evidence + 0.15 * names + 0.15 * relation + 0.20 * pair + 0.15 * types, 4))


def rescore_and_prune(kg: DataFrame, least: float = 0.35) -> DataFrame:
    """Rows below ``least`` become rejected and keep their confidence, others take the score for it."""
    df = rescored(kg)
    live, low = F.col("status") != "rejected", F.col("score") < least
    return df.withColumns({"status": F.when(live & low, "rejected").otherwise(F.col("status")), "conf": F.when(live & ~low, F.col("score")).otherwise(F.col("conf"))})


def saliency(kg: DataFrame) -> DataFrame:
    """The rows that are not rejected with their saliency within their document (column ``_doc``); a
    row without a document is one of its own."""
    active = kg.where("status <> 'rejected'").withColumns({"_s": F.lower("s"), "_o": F.lower("o"), "_doc": F.coalesce("doc", F.concat(F.lit("\x01"), "seq"))})
    # A document has few rows: its names are counted by a window over their two endpoints.
    ends = active.select("_doc", "seq", F.explode(F.array(F.col("_s"), F.col("_o"))).alias("name"))
    counted = ends.select("_doc", "seq", F.count(F.lit(1)).over(Window.partitionBy("_doc", "name")).alias("n"))
    per_row = counted.groupBy("_doc", "seq").agg(F.sum("n").alias("both"), F.max("n").alias("more"))
    joined = active.join(per_row, ["_doc", "seq"])
    top = F.max("more").over(Window.partitionBy("_doc"))
    weight = F.coalesce(*[F.when(F.col("rel") == r, w) for r, w in schema.SALIENCE.items()])
    strength = F.when(F.length("ev") > 0, F.least(F.length("ev") / 200, F.lit(1.0))).otherwise(0.3)
    return joined.withColumn("salience", F.round(0.35 * weight + 0.30 * (F.col("both") / 2 / top) + 0.15 * strength + 0.20 * F.col("conf"), 9)).drop("_s", "_o", "both", "more")


def most_salient(kg: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most salient rows of each document, ties to the earlier; rejected rows stay.

    Documents of up to ``k`` rows keep them all.
    """
    top = saliency(kg).withColumn("_n", F.row_number().over(Window.partitionBy("_doc").orderBy(F.desc("salience"), "seq"))).where(F.col("_n") <= k)
    return top.drop("_n", "_doc").unionByName(kg.where("status = 'rejected'").withColumn("salience", F.lit(None).cast("double")))
