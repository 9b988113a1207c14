"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import nested
from spindrift.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.listed(nested.bridge(table(spark, d, "mitre"))).select("rec_id", "path")


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(nested.bridge(table(spark, d, "mitre"), whole=True))


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Where each of ``p2_objects`` stands; the two together hold every record whole."""
    return nested.bridge(table(spark, d, "mitre"), whole=True).drop("body")


def p2_phases(spark: SparkSession, d: str) -> DataFrame:
    """Kill-chain phases of the column only, for the SQL check; ``p2_phase_rows`` has all."""
    rows = table(spark, d, "mitre").select("rec_id", F.posexplode("kill_chain_phases").alias("ordinal", "p")).where("p is not null")
    return rows.select("rec_id", "ordinal", F.col("p.kill_chain_name").alias("chain"), F.col("p.phase_name").alias("phase"))


def p2_phase_rows(spark: SparkSession, d: str) -> DataFrame:
    """All kill-chain phases, in the column and at any depth of contents."""
    return nested.flat(nested.bridge(table(spark, d, "mitre")), "kill_chain_phases", ("kill_chain_name", "phase_name"))


def p2_reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """All external references, in the column and at any depth of contents."""
    return nested.flat(nested.bridge(table(spark, d, "mitre")), "external_references", ("source_name", "external_id", "url", "description"))


QUERIES = {f.__name__: f for f in (p2_found, p2_objects, p2_bridge, p2_phases, p2_phase_rows, p2_reference_rows)}

SQL = {
    "p2_phases": """
select rec_id, cast(i - 1 as integer) as ordinal, kill_chain_phases[i].kill_chain_name as chain, kill_chain_phases[i].phase_name as phase
from (select rec_id, kill_chain_phases, unnest(range(1, len(kill_chain_phases) + 1)) as i from mitre)
where kill_chain_phases[i] is not null""",
}
