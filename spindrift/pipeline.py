"""The steps in order, over all documents at once: repair, validate, rescore, keep the salient, resolve
names, ground techniques, align, fuse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.lineage import written
from spindrift.operators import fuse, ground, pairs, relation_repair, salience, scoring, validate


@dataclass(frozen=True)
class Steps:
    """Which steps run and their limits."""

    pronouns: bool = True
    repair: bool = True
    validation: bool = True
    rescore_below: float | None = None
    keep_per_document: int | None = None
    canonical: bool = True
    techniques: bool = True
    align_from: float | None = None
    fuse_from: float = 0.5
    policy: validate.Policy = validate.Policy()

    def label(self) -> str:
        names = {"P": self.pronouns, "R": self.repair, "V": self.validation, "C": self.rescore_below is not None, "S": self.keep_per_document is not None}
        return "+".join(k for k, on in names.items() if on) or "none"


def processed(kg: DataFrame, steps: Steps = Steps()) -> DataFrame:
    """``kg`` after the steps. Validation's cascade is written to the shared folder once: it is
    long, and every later step reads it several times."""
    if steps.pronouns:
        kg = pairs.resolve_pronouns(kg)
    if steps.repair:
        kg = relation_repair.repair_relations(kg)
    if steps.validation:
        kg = written(validate.keep_best(validate.validate(kg, steps.policy)))
    if steps.rescore_below is not None:
        kg = salience.rescore_and_prune(kg, steps.rescore_below)
    if steps.keep_per_document is not None:
        kg = salience.most_salient(kg, steps.keep_per_document)
    return kg


def resolved(kg: DataFrame, mitre: DataFrame, steps: Steps = Steps(), vectors: DataFrame | None = None) -> DataFrame:
    """``kg`` under canonical names and grounded techniques; with ``align_from``, similar names (``vectors``:
    type, name, v, as an embedding model gives them) under one."""
    if steps.canonical:
        kg = written(ground.canonicalized(kg, ground.alias_table(mitre)))
    if steps.techniques:
        kg = written(ground.with_techniques(kg, mitre))
    if steps.align_from is not None:
        if vectors is None:
            raise ValueError("alignment needs vectors of the names")
        kg = written(ground.aligned(kg, vectors, steps.align_from))
    return kg


def graph(kg: DataFrame, mitre: DataFrame, steps: Steps = Steps(), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and fused edges of all documents."""
    done = resolved(processed(kg, steps), mitre, steps, vectors)
    return fuse.entity_map(done), fuse.fuse_edges(done, steps.fuse_from)


def ablation(kg: DataFrame, arms: list[Steps]) -> DataFrame:
    """arm, status, n: the same triples under several choices of steps."""
    out = None
    for steps in arms:
        part = processed(kg, steps).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("arm", F.lit(steps.label()))
        out = part if out is None else out.unionByName(part)
    return out.select("arm", "status", "n")


def empty_rate(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """documents, empty and rate: how many of ``documents`` (doc) have no triple in ``extracted`` (doc)."""
    none = documents.select("doc").distinct().join(extracted.select("doc", F.lit(1).alias("_has")).distinct(), "doc", "left")
    sums = none.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("_has").isNull()).alias("empty"))
    return sums.select("*", F.round(F.when(F.col("documents") > 0, F.col("empty") / F.col("documents")).otherwise(0.0), 6).alias("rate"))


def ablation_scores(kg: DataFrame, gold: DataFrame, arms: list[Steps], most_empty: float = 0.05) -> DataFrame:
    """arm, level, tp, precision, recall, f1 and delta (of f1 to the first arm) of the same triples under
    several choices of steps, against ``gold``.

    An error if more than ``most_empty`` of the documents of ``gold`` have no triple: their scores
    would say nothing about the steps.
    """
    rate = empty_rate(kg.where("doc is not null"), gold.where("doc is not null")).first()["rate"]
    if rate > most_empty:
        raise ValueError(f"{rate:.1%} of the documents have no triples")
    out = None
    for steps in arms:
        scores = scoring.extraction_metrics(processed(kg, steps).where("status <> 'rejected'"), gold).withColumn("arm", F.lit(steps.label()))
        out = scores if out is None else out.unionByName(scores)
    scores = written(out)
    first = scores.where(F.col("arm") == arms[0].label()).select("level", F.col("f1").alias("_first"))
    return scores.join(first, "level").select("arm", "level", "tp", "precision", "recall", "f1", F.round(F.col("f1") - F.col("_first"), 4).alias("delta"))
