"""The triples as the graph takes them; the DataFrame twin of ``duck.KG``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.relations import normalize_relation
from spindrift.functions.text import strip
from spindrift.tables import table


def _known(col: str) -> F.Column:
    return F.when(F.col(col).isin(schema.ENTITY_TYPES), F.col(col)).otherwise("Other")


def graph_triples(triples: DataFrame) -> DataFrame:
    """seq, doc, chunk, s, st, rel, o, ot, ev, conf, status, aids of every row.

    Texts are stripped, null texts blank; unknown types are Other, unknown statuses raw; a
    confidence that is null, NaN or out of range counts as 1; a null list of ids is empty.
    """
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    status = strip(F.lower(F.coalesce("validation_status", F.lit(""))))
    return triples.select(
        "seq", F.col("source_doc_id").alias("doc"), F.col("source_chunk_id").alias("chunk"),
        blank("subject").alias("s"), _known("subject_type").alias("st"),
        normalize_relation(F.coalesce("relation", F.lit(""))).alias("rel"),
        blank("object").alias("o"), _known("object_type").alias("ot"), blank("evidence_text").alias("ev"),
        F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(1.0).alias("conf"),
        F.when(status.isin(schema.STATUSES), status).otherwise("raw").alias("status"),
        F.coalesce("attack_ids", F.array().cast("array<string>")).alias("aids"),
    )


def kg(spark: SparkSession, d: str) -> DataFrame:
    return graph_triples(table(spark, d, "triples"))
