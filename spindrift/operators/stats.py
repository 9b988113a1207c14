"""Comparisons of runs: ranks and their reversals, spread over passes, effects of two factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranks(scores: DataFrame) -> DataFrame:
    """protocol, system, score, rank (ties by system) and spread (best less worst) of a score table."""
    by = Window.partitionBy("protocol")
    return scores.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("score"), "system")), "spread": F.round(F.max("score").over(by) - F.min("score").over(by), 6)})


def reversals(scores: DataFrame) -> DataFrame:
    """Pairs of systems of which one wins under some protocols and the other under others: wins of
    either and the largest gap. A score table has one row a system and protocol, and few systems."""
    a, b = scores.select("protocol", F.col("system").alias("a"), F.col("score").alias("x")), scores.select("protocol", F.col("system").alias("b"), F.col("score").alias("y"))
    pairs = a.join(b, "protocol").where("a < b").groupBy("a", "b").agg(
        F.count_if(F.col("x") > F.col("y")).alias("a_wins"), F.count_if(F.col("x") < F.col("y")).alias("b_wins"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 6).alias("gap"))
    return pairs.where("a_wins > 0 and b_wins > 0")


def pass_variance(passes: DataFrame) -> DataFrame:
    """Mean, sample deviation (null below two passes), least, most and range of each arm's values."""
    v = F.col("value")
    return passes.groupBy("arm").agg(F.count(F.lit(1)).alias("passes"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.max(v) - F.min(v), 6).alias("range"))


def effects(cells: DataFrame) -> DataFrame:
    """Main effects and interaction of two factors (a, b: 0 or 1) on the mean of ``value``."""
    m = lambda a, b: F.avg(F.when((F.col("a") == a) & (F.col("b") == b), F.col("value")))
    means = cells.agg(m(0, 0).alias("m00"), m(0, 1).alias("m01"), m(1, 0).alias("m10"), m(1, 1).alias("m11"))
    return means.select(
        F.round((F.col("m10") + F.col("m11") - F.col("m00") - F.col("m01")) / 2, 6).alias("effect_a"), F.round((F.col("m01") + F.col("m11") - F.col("m00") - F.col("m10")) / 2, 6).alias("effect_b"),
        F.round(F.col("m11") - F.col("m10") - F.col("m01") + F.col("m00"), 6).alias("interaction"))


def agreement(items: DataFrame) -> DataFrame:
    """Confusion of ``judge`` against ``human`` by protocol, by protocol and type (type ``all``: both)."""
    h, j = F.col("human"), F.col("judge")
    n = F.count(F.lit(1))
    out = items.groupingSets([[F.col("protocol")], [F.col("protocol"), F.col("type")]], "protocol", "type").agg(
        n.alias("n"), F.count_if(h & j).alias("tp"), F.count_if(~h & j).alias("fp"), F.count_if(h & ~j).alias("fn"), F.count_if(~h & ~j).alias("tn"), F.round(F.count_if(h == j) / n, 6).alias("agreement"))
    return out.withColumn("type", F.coalesce("type", F.lit("all")))
