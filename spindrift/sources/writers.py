"""Sinks: graphs as JSON lines and CSV, written by all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.quality import taxonomy
from spindrift.sources.responses import parsed

ACCEPTED = ["validated", "repaired"]


def edge_rows(triples: DataFrame) -> DataFrame:
    """The columns of the edge table: accepted rows, 200 characters of evidence, three decimals."""
    return triples.where(F.col("validation_status").isin(ACCEPTED)).select(
        "event_id", "subject", "subject_type", "relation", "object", "object_type", F.substring("evidence_text", 1, 200).alias("evidence_text"), "source_doc_id", "source_chunk_id",
        F.array_join("attack_ids", "|").alias("attack_ids"), F.format_string("%.3f", "confidence").alias("confidence"), "validation_status")


def node_rows(entities: DataFrame) -> DataFrame:
    """The columns of the node table: aliases in one field, the first five mentions, ids as JSON."""
    return entities.select("node_id", "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.slice("source_mentions", 1, 5), "|").alias("source_mentions"), F.to_json("external_ids").alias("external_ids"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_graph(entities: DataFrame, triples: DataFrame, path: str) -> None:
    """nodes, edges (accepted ones) and a one-row summary as JSON lines below ``path``."""
    edges = triples.where(F.col("validation_status").isin(ACCEPTED))
    entities.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    counts = edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(entities.agg(F.count(F.lit(1)).alias("nodes")))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def triple_rows(triples: DataFrame) -> DataFrame:
    """The eleven columns under which triples of a run are kept."""
    return triples.select("event_id", "subject", "subject_type", "relation", "object", "object_type", "evidence_text", "source_doc_id", "confidence", "validation_status", "rejection_reason")


def write_log(log: DataFrame, path: str) -> None:
    """``log`` (category, action and others) as JSON lines below ``path``/log, and its summary by category,
    by action and in all below ``path``/summary."""
    log.write.mode("overwrite").json(f"{path}/log")
    taxonomy(log).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def unreadable(answers: DataFrame) -> DataFrame:
    """chunk_id made fit for a file name, prompt and response of the answers that give no triple: what is
    put aside for another look."""
    failed = answers.where(F.coalesce(F.size(parsed(F.col("response"))), F.lit(0)) <= 0)
    return failed.select(F.regexp_replace("chunk_id", "[^A-Za-z0-9_.-]+", "_").alias("chunk_id"), "prompt", "response")
