"""Quality of a graph: one pass of conditional aggregates each, and the log of what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.columns import allowed_pair, mapped
from spindrift.functions.names import LEADS

#: Names that refer to no one in particular.
VAGUE = ["it", "they", "them", "these", "those", "this", "that", "attacker", "attackers", "actors", "victim", "victims"]


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part`` of ``whole``, ``empty`` if there is nothing."""
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(empty)), 6)


def _objects(table: dict[str, list[str]]) -> tuple[Column, Column]:
    bound = F.col("rel").isin(list(table))
    return bound, bound & allowed_pair(F.lit("x"), F.col("rel"), F.col("ot"), {r: (["x"], o) for r, o in table.items()})


def quality(kg: DataFrame) -> DataFrame:
    """Relation and type specificity, semantic validity (1 without constrained rows), duplicate rate."""
    bound, valid = _objects(schema.QUALITY_OBJECTS)
    n = F.count(F.lit(1))
    return kg.agg(
        n.alias("n"), share(F.count_if(~F.col("rel").isin(schema.GENERIC)), n).alias("relation_specificity"),
        share(F.count_if(F.col("st") != "Other") + F.count_if(F.col("ot") != "Other"), 2 * n).alias("type_specificity"),
        share(F.count_if(valid), F.count_if(bound), 1.0).alias("semantic_validity"),
        share(n - F.countDistinct(F.lower("s"), F.lower("o")), n).alias("duplicate_rate"),
    )


def _stix(kg: DataFrame) -> DataFrame:
    """c rows of each s, rel, o in STIX terms: the types of relation and ends have a few thousand
    combinations, so the rules run over their counts, not over the rows."""
    counts = kg.groupBy("st", "rel", "ot").agg(F.count(F.lit(1)).alias("c"))
    s, o = (mapped(F.col(c), schema.STIX_TYPES, F.lit(None).cast("string")) for c in ("st", "ot"))
    typed = counts.select("rel", "c", s.alias("s"), o.alias("o")).withColumns({"related": F.col("rel").isin(list(schema.STIX_PAIRS)), "typed": F.col("s").isNotNull() & F.col("o").isNotNull()})
    return typed.withColumn("ok", F.col("related") & F.col("typed") & allowed_pair(F.col("s"), F.col("rel"), F.col("o"), schema.STIX_PAIRS))


def stix_compliance(kg: DataFrame) -> DataFrame:
    """Rows without a STIX relation, without a STIX type, scored and compliant; compliance, coverage."""
    rows = lambda when: F.coalesce(F.sum(F.when(when, F.col("c"))), F.lit(0))
    related, typed = F.col("related"), F.col("typed")
    n, scored, ok = rows(F.lit(True)), rows(related & typed), rows(F.col("ok"))
    return _stix(kg).agg(n.alias("n"), rows(~related).alias("no_relation"), rows(related & ~typed).alias("no_type"), scored.alias("scored"), ok.alias("compliant"), share(ok, scored).alias("compliance"), share(scored, n).alias("coverage"))


def stix_violations(kg: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent violations, ties by their text."""
    # A filter on the count stays above the aggregation; one on its keys would be copied into the scan.
    wrong = _stix(kg).withColumn("c", F.when(F.col("related") & F.col("typed") & ~F.col("ok"), F.col("c")).otherwise(0)).where("c > 0")
    return wrong.groupBy(F.concat("s", F.lit(" -["), "rel", F.lit("]-> "), "o").alias("violation")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "violation").limit(k)


def normalization_loss(kg: DataFrame) -> DataFrame:
    """How much fell into catch-alls: generic relations and Other ends."""
    n = F.count(F.lit(1))
    return kg.agg(n.alias("n"), share(F.count_if(F.col("rel").isin(schema.GENERIC)), n).alias("generic_rate"), share(F.count_if(F.col("st") == "Other") + F.count_if(F.col("ot") == "Other"), 2 * n).alias("other_rate"))


def structure(kg: DataFrame) -> DataFrame:
    """Evidence presence and alignment, object-type compliance, duplicate pairs."""
    ev = F.lower("ev")
    key = lambda c: F.when(F.length(c) >= 6, F.substring(F.lower(c), 1, 12)).otherwise(F.lower(c))
    full = (F.col("ev") != "") & (F.col("s") != "") & (F.col("o") != "")
    bound, valid = _objects(schema.STRUCTURAL_OBJECTS)
    n = F.count(F.lit(1))
    return kg.agg(
        share(F.count_if(F.col("ev") != ""), n).alias("evidence_presence"), F.count_if(full & ev.contains(key("s")) & ev.contains(key("o"))).alias("aligned"),
        share(F.count_if(full & ev.contains(key("s")) & ev.contains(key("o"))), F.count_if(full)).alias("alignment"), share(F.count_if(valid), F.count_if(bound), 1.0).alias("type_compliance"),
        share(n - F.countDistinct(F.lower("s"), F.lower("o")), n).alias("duplicate_pairs"),
    )


def name_hygiene(kg: DataFrame) -> DataFrame:
    """Over all names that are not blank: mean and upper median length, shares of short names, of
    leading articles, vague words and trailing punctuation."""
    names = kg.select(F.explode(F.array("s", "o")).alias("n")).where("n <> ''").withColumn("l", F.lower("n"))
    n = F.count(F.lit(1))
    lead = F.lit(False)
    for x in LEADS:
        lead = lead | F.col("l").startswith(x)
    sums = names.agg(
        n.alias("n"), F.round(F.avg(F.length("n")), 6).alias("mean_length"), share(F.count_if(F.length("n") < 3), n).alias("too_short"), share(F.count_if(lead), n).alias("article"),
        share(F.count_if(F.col("l").isin(VAGUE)), n).alias("vague"), share(F.count_if(F.col("n").rlike(r"[:;,.]\s*$")), n).alias("punctuation"))
    # The upper median from counts by length: a few hundred rows, not a sort of all names.
    by_length = names.groupBy(F.length("n").alias("len")).agg(n.alias("c"))
    below = by_length.alias("a").join(by_length.alias("b"), F.col("b.len") <= F.col("a.len")).groupBy("a.len").agg(F.sum("b.c").alias("upto"))
    median = below.join(F.broadcast(sums.select(F.col("n").alias("total")))).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("len").alias("median_length"))
    return sums.crossJoin(F.broadcast(median))


def cross_document(kg: DataFrame) -> DataFrame:
    """Distinct names and how many occur in more than one document."""
    per = kg.select("doc", F.explode(F.array(F.lower("s"), F.lower("o"))).alias("n")).groupBy("n").agg((F.min("doc") != F.max("doc")).alias("many"))
    return per.agg(F.count(F.lit(1)).alias("names"), F.count_if("many").alias("in_many"), share(F.count_if("many"), F.count(F.lit(1))).alias("rate"))


def histogram(kg: DataFrame) -> DataFrame:
    """kind (status, relation, type), value, n: types over both ends."""
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("status", "status"), ("relation", "rel"), ("type", "st"), ("type", "ot"))])
    return kg.select(F.explode(values).alias("x")).select("x.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def taxonomy(log: DataFrame) -> DataFrame:
    """Counts of log entries (category, action) by category, by action and in all, with the shares
    of rejections and repairs, in one pass over grouping sets."""
    n = F.count(F.lit(1))
    sets = log.groupingSets([[F.col("category")], [F.col("action")], []], "category", "action").agg(
        n.alias("n"), share(F.count_if(F.col("action") == "rejected"), n).alias("rejection_rate"), share(F.count_if(F.col("action") == "repaired"), n).alias("repair_rate"), F.grouping_id().alias("level"))
    return sets.select(F.when(F.col("level") == 1, "category").when(F.col("level") == 2, "action").otherwise("all").alias("level"), F.coalesce("category", "action", F.lit("")).alias("value"), "n", "rejection_rate", "repair_rate")


def taxonomy_crosstab(log: DataFrame) -> DataFrame:
    """A row per category with the counts of each action and the documents touched."""
    actions = ["flagged", "repaired", "rejected"]
    return log.groupBy("category").agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions], F.countDistinct(F.when(F.col("doc") != "", F.col("doc"))).alias("docs"))


#: Categories that dispute how an entity was typed.
TYPE_DISPUTES = ["type_misassignment", "impossible_type_pair"]


def taxonomy_by_run(log: DataFrame, disputes: list[str] = TYPE_DISPUTES, k: int = 6) -> DataFrame:
    """run, serving, n, rejected and disputed (shares of the entries), serving_mean (of disputed over the
    serving's runs) and top (the shares of the ``k`` most frequent categories of all runs, by name).

    ``log`` has run, serving, category, action; it is counted once, all else reads the counts.
    """
    counts = log.groupBy("run", "serving", "category", "action").agg(F.count(F.lit(1)).alias("c"))
    leading = counts.groupBy("category").agg(F.sum("c").alias("all")).orderBy(F.desc("all"), "category").limit(k).select("category", F.lit(1).alias("_top"))
    each = counts.join(F.broadcast(leading), "category", "left").groupBy("run", "serving", "category", "_top").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("action") == "rejected", F.col("c")).otherwise(0)).alias("r"))
    n = F.sum("c")
    runs = each.groupBy("run", "serving").agg(
        n.alias("n"), share(F.sum("r"), n).alias("rejected"), (F.sum(F.when(F.col("category").isin(disputes), F.col("c")).otherwise(0)) / n).alias("disputed"),
        F.array_sort(F.collect_list(F.when(F.col("_top").isNotNull(), F.struct("category", "c")))).alias("t"))
    top = F.array_join(F.transform("t", lambda x: F.format_string("%s=%.3f", x["category"], x["c"] / F.col("n"))), "|")
    means = runs.groupBy("serving").agg(F.round(F.avg("disputed"), 6).alias("serving_mean"))
    return runs.join(means, "serving").select("run", "serving", "n", "rejected", F.round("disputed", 6).alias("disputed"), "serving_mean", top.alias("top"))
