"""Pairs of triples and of entities: additions to a graph, pairs worth asking about, likely duplicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift import schema
from spindrift.functions.names import for_comparison
from spindrift.operators.grouped import by_group


def additions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose triple its document lacks in ``old`` either way round; of repeated
    ones the first."""
    key = lambda df, s, o: df.select("doc", F.lower(s).alias("a"), "rel", F.lower(o).alias("b"))
    there = key(old, "s", "o").unionByName(key(old, "o", "s")).distinct()
    fresh = new.withColumns({"a": F.lower("s"), "b": F.lower("o")})
    first = Window.partitionBy("doc", "a", "rel", "b").orderBy("seq")
    return fresh.join(there, ["doc", "a", "rel", "b"], "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "a", "b")


def _first_relations() -> list[tuple[str, str, str, bool]]:
    """For each two types the first relation that allows them, as they stand or else turned round: at
    most one row for every pair of the fixed types."""
    rows = []
    for a in schema.ENTITY_TYPES:
        for b in schema.ENTITY_TYPES:
            for rel, (subjects, objects) in schema.TYPE_PAIRS.items():
                if (a in subjects and b in objects) or (b in subjects and a in objects):
                    rows.append((a, b, rel, not (a in subjects and b in objects)))
                    break
    return rows


#: The relation of each two types that some relation allows, and whether it is turned round.
_FITTING = {(a, b): (rel, turned) for a, b, rel, turned in _first_relations()}


def first_pairs(rows: Iterable[tuple], k: int) -> list[tuple]:
    """n, s, rel, o of the first ``k`` pairs of a chunk that may be related and are not.

    ``rows`` are (chunk, 0, None, x, y, None) for each related pair in lower case, then (chunk, 1, place,
    name, name in lower case, type) for each entity by place. An entity waits for later ones only as long
    as a pair with it could be among the first: each look at a waiting one gives such a pair, or meets
    a related one.
    """
    related: set[tuple[str, str]] = set()
    waiting: dict[str, list[tuple]] = {}
    found: list[tuple] = []
    for _, kind, at, name, low, own in rows:
        if not kind:
            related.add((min(name, low), max(name, low)))
            continue
        new = [(i, at, a, name, *_FITTING[t, own]) for t, those in waiting.items() if (t, own) in _FITTING for i, a, x in those if (min(x, low), max(x, low)) not in related]
        if new:
            found = sorted(found + new)[:k]
        if len(found) < k:
            waiting.setdefault(own, []).append((at, name, low))
        elif new:
            waiting = {t: left for t, those in waiting.items() if (left := [w for w in those if w[0] < found[-1][0]])}
        if len(found) == k and not waiting:
            break
    return [(n, b, rel, a) if turned else (n, a, rel, b) for n, (_, _, a, b, rel, turned) in enumerate(found, 1)]


def guided_pairs(kg: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` pairs of entities of each chunk that no triple of it relates, with the first
    specific relation that their types allow, as they stand or else turned round.

    Entities take their first position and last type. No pairs are formed beyond those looked at:
    ``first_pairs`` reads the entities of a chunk in order and keeps its related pairs in memory.
    """
    live = kg.where("status <> 'rejected' and chunk is not null")
    ends = live.select("chunk", F.explode(F.array(*[F.struct((F.col("seq") * 2 + i).alias("at"), F.col(n).alias("name"), F.col(t).alias("type")) for i, n, t in ((0, "s", "st"), (1, "o", "ot"))])).alias("e")).select("chunk", "e.*")
    known = ends.groupBy("chunk", "name").agg(F.min("at").alias("at"), F.max_by("type", "at").alias("type")).select("chunk", F.lit(1).alias("kind"), "at", "name", F.lower("name").alias("low"), "type")
    related = live.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"), F.lower("s").alias("name"), F.lower("o").alias("low"), F.lit(None).cast("string").alias("type"))
    run = lambda chunk, rows: ((chunk, *r) for r in first_pairs(rows, k))
    return by_group(related.unionByName(known), "chunk", ["kind", "at"], run, {"chunk": "string", "n": "int", "s": "string", "rel": "string", "o": "string"})


def duplicate_candidates(entities: DataFrame, shortest: int = 4) -> DataFrame:
    """id_1, id_2 and reason of nodes of one type with equal normal names, one name inside the other
    (both of ``shortest`` characters or more), or a shared alias; the first reason that holds.

    Every reason is an equi-join: containment joins a name with the substrings of longer names.
    """
    nodes = entities.select("node_id", "entity_type", for_comparison(F.coalesce("canonical_name", F.lit(""))).alias("n"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    named = nodes.select("entity_type", "node_id", "n").where("n <> ''")
    ordered = lambda df: df.where("x <> y").select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"), "p").distinct()
    other = lambda df: df.withColumnRenamed("node_id", "y")
    equal = named.withColumnRenamed("node_id", "x").join(other(named), ["entity_type", "n"]).select("x", "y", F.lit(1).alias("p"))
    long = named.where(F.length("n") > shortest)
    parts = long.select("entity_type", F.col("node_id").alias("x"), F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("n") - shortest + 1), lambda i: F.transform(F.sequence(F.lit(shortest), F.length("n") - i + 1), lambda m: F.substr("n", i, m)))))).alias("n"))
    inside = parts.join(other(named), ["entity_type", "n"]).select("x", "y", F.lit(2).alias("p"))
    aliases = nodes.select("entity_type", "node_id", F.explode("aliases").alias("a")).select("entity_type", "node_id", F.lower("a").alias("a")).where("a is not null and trim(a) not in ('', '-', 'n/a', 'unknown')").distinct()
    shared = aliases.withColumnRenamed("node_id", "x").join(other(aliases), ["entity_type", "a"]).select("x", "y", F.lit(3).alias("p"))
    found = ordered(equal).unionByName(ordered(inside)).unionByName(ordered(shared)).groupBy("id_1", "id_2").agg(F.min("p").alias("p"))
    return found.select("id_1", "id_2", F.when(F.col("p") == 1, "name").when(F.col("p") == 2, "substring").otherwise("alias").alias("reason"))


def resolve_pronouns(kg: DataFrame) -> DataFrame:
    """``kg`` with pronouns replaced by the last named entity of their chunk up to their row: of
    their own kind (actors, malware and tools), else an actor, else malware; unresolved ones stay.

    An object is later than the subject of its row. One window per chunk; a row without a chunk
    stands alone.
    """
    actor, malware = ["ThreatActor", "Campaign"], ["Malware", "Tool"]
    named = lambda n, t, kinds: F.when(~F.lower(n).isin(schema.PRONOUNS) & F.col(t).isin(kinds), F.col(n))
    so_far = Window.partitionBy(F.coalesce("chunk", F.concat(F.lit("\x01"), "seq"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda kinds: F.last(F.coalesce(named("o", "ot", kinds), named("s", "st", kinds)), ignorenulls=True).over(so_far)
    df = kg.withColumns({"_a": last(actor), "_m": last(malware)})
    put = lambda n, t: F.when(F.lower(n).isin(schema.PRONOUNS), F.coalesce(F.when(F.col(t) == "ThreatActor", F.col("_a")).when(F.col(t).isin(malware), F.col("_m")), F.col("_a"), F.col("_m"), F.col(n))).otherwise(F.col(n))
    return df.withColumns({"s": put("s", "st"), "o": put("o", "ot")}).drop("_a", "_m")
