"""Names resolved by alias tables and techniques by a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift import schema
from spindrift.functions.columns import mapped
from spindrift.functions.names import alnum_words
from spindrift.functions.text import squash
from spindrift.lineage import written
from spindrift.operators import retrieve
from spindrift.operators.skew import hot_keys, lookup

#: Which alias table a type looks names up in.
ALIAS_KINDS = {"ThreatActor": "group", "Campaign": "group", "Malware": "software", "Tool": "software", "Software": "software"}
#: Catalogue types of each alias table.
RECORD_KINDS = {"intrusion-set": "group", "threat-actor": "group", "malware": "software", "tool": "software"}

_TEXTS = "array<string>"
_CONTENTS = "name string, description string, aliases string, x_mitre_aliases string, external_references string, kill_chain_phases string"


def _kind(column: str, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in table.items()])


def _latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last: a later one overwrites an earlier one."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _filled(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def _texts(text: Column) -> Column:
    """The members of a JSON list as texts; all else has none."""
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, _TEXTS)), F.array().cast(_TEXTS))


def _structs(text: Column, kind: str) -> Column:
    """The members of a JSON list that are objects; an object in its place is a list of one."""
    members = F.when(text.startswith("{"), F.array(text)).otherwise(_texts(text))
    return F.transform(F.filter(members, lambda x: x.startswith("{")), lambda x: F.from_json(x, kind))


def records(mitre: DataFrame) -> DataFrame:
    """rec_id, kind, name, mitre_id, description, aliases, references and phases of a catalogue's records.

    ``contents``, where it is the JSON text of an object, fills what the columns lack: name (before
    title), description and aliases (its aliases, else its x_mitre_aliases); its references and phases
    follow those of the columns. Values of another shape count as missing, null members are left
    out, and contents that is broken, a list or text in text counts as none. ``contents`` and
    ``description``, of which 200 characters stay, need not be columns.
    """
    there = lambda c: F.col(c) if c in mitre.columns else F.lit(None).cast("string")
    inner, own = F.from_json(there("contents"), _CONTENTS), there("description")
    lists = lambda a: F.nullif(F.array_compact(F.coalesce(a, F.array().cast(_TEXTS))), F.array().cast(_TEXTS))
    reference, phase = "source_name string, external_id string", "kill_chain_name string, phase_name string"
    joined = lambda c, kind: F.concat(F.array_compact(F.coalesce(F.col(c), F.array().cast(f"array<struct<{kind.replace(' string', ':string')}>>"))), _structs(F.col(f"_c.{c}"), kind))
    rows = mitre.select("*", inner.alias("_c"))
    return rows.select(
        "rec_id", F.coalesce(F.nullif("type", F.lit("")), F.nullif("object_type", F.lit(""))).alias("kind"),
        _filled(F.col("name"), F.col("_c.name"), F.col("title")).alias("name"), F.nullif("mitre_id", F.lit("")).alias("mitre_id"),
        F.substring(F.coalesce(F.nullif(own, F.lit("")), F.col("_c.description"), F.lit("")), 1, 200).alias("description"),
        F.coalesce(lists(F.col("aliases")), lists(_texts(F.col("_c.aliases"))), lists(_texts(F.col("_c.x_mitre_aliases"))), F.array().cast(_TEXTS)).alias("aliases"),
        joined("external_references", reference).alias("references"), joined("kill_chain_phases", phase).alias("phases"))


def alias_table(mitre: DataFrame) -> DataFrame:
    """kind, alias (lower case) and canonical of the groups and software of a catalogue.

    A canonical name is an alias of itself; of equal aliases the last record's wins. Records without
    a name and blank or null aliases give nothing.
    """
    named = records(mitre).select("rec_id", _kind("kind", RECORD_KINDS).alias("kind"), F.col("name").alias("canonical"), "aliases").where("kind is not null and canonical is not null")
    each = named.select("rec_id", "kind", "canonical", F.explode(F.concat(F.array("canonical"), "aliases")).alias("alias"))
    rows = each.select("rec_id", "kind", "canonical", F.lower(F.trim("alias")).alias("alias")).where("alias <> ''").distinct()
    return _latest(rows, ["kind", "alias"], "rec_id").select("kind", "alias", "canonical")


def known_aliases(aliases: DataFrame, kind: str) -> DataFrame:
    """canonical and its other aliases in byte order, the inverse of an alias table."""
    rows = aliases.where((F.col("kind") == kind) & (F.col("alias") != F.lower("canonical")))
    return rows.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def technique_records(mitre: DataFrame) -> DataFrame:
    """rec_id, technique_id, name, description and tactics of every record of a technique (or of no
    kind) that has an identifier of its own or among its references, and a name."""
    ours = lambda x: x == "mitre-attack"
    reference = F.try_element_at(F.filter("references", lambda r: ours(r["source_name"])), F.lit(1))["external_id"]
    tactics = F.transform(F.filter("phases", lambda p: ours(p["kill_chain_name"])), lambda p: F.coalesce(p["phase_name"], F.lit("")))
    rows = records(mitre).where("kind is null or kind = 'attack-pattern'").select("rec_id", F.coalesce("mitre_id", F.nullif(reference, F.lit(""))).alias("technique_id"), "name", "description", tactics.alias("tactics"))
    return rows.where("technique_id is not null and name is not null")


def technique_catalogue(mitre: DataFrame) -> DataFrame:
    """technique_id, name, description, tactics: the last record of each technique."""
    return _latest(technique_records(mitre), ["technique_id"], "rec_id")


def _counted_ends(kg: DataFrame) -> DataFrame:
    """type, alias (lower case), the first spelling and the count of the names of the rows not rejected."""
    ends = kg.where("status <> 'rejected'").select("seq", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("type"), F.col(n).alias("name")) for i, t, n in ((0, "st", "s"), (1, "ot", "o"))])).alias("e")).select("seq", "e.*")
    # From partial minima and counts: one row a name leaves a task, however many rows have it.
    return ends.groupBy("type", F.lower(F.trim("name")).alias("alias")).agg(F.min_by("name", F.struct("seq", "side")).alias("spelled"), F.count(F.lit(1)).alias("n"))


def _entries(kg: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key and canonical of every name of ``kg``, and the hot ones among the keys."""
    first = written(_counted_ends(kg).withColumn("kind", _kind("type", ALIAS_KINDS)))
    plain = squash(F.col("spelled"))
    known = first.join(aliases, ["kind", "alias"], "left").select(_key("type", "alias"), "n", F.coalesce("canonical", mapped(F.lower(plain), schema.KNOWN_CASING, plain)).alias("canonical"))
    return known.select("key", "canonical"), written(hot_keys(known, "key"))


def _key(kind: str, name: str) -> Column:
    """A name within its type, null where the row is rejected (if it has a status)."""
    return F.struct(F.col(kind).alias("type"), F.lower(F.trim(name)).alias("alias")).alias("key")


def canonical_names(kg: DataFrame, aliases: DataFrame) -> DataFrame:
    """seq, side (0 subject, 1 object), name and canonical of both ends of the rows not rejected.

    The alias table of the end's type decides; else the spelling that well-known names have; else
    the name with white space collapsed, in the spelling in which the corpus first shows it.
    """
    entries, hot = _entries(kg, aliases)
    ends = kg.where("status <> 'rejected'").select("seq", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("type"), F.col(n).alias("name")) for i, t, n in ((0, "st", "s"), (1, "ot", "o"))])).alias("e")).select("seq", "e.*")
    found = lookup(ends.withColumn("key", _key("type", "name")), entries, "key", hot, ["seq", "side"])
    return found.select("seq", "side", "name", "canonical")


def canonicalized(kg: DataFrame, aliases: DataFrame) -> DataFrame:
    """``kg`` with the canonical names of both ends of the rows not rejected."""
    entries, hot = _entries(kg, aliases)
    rows = kg
    for t, n in (("st", "s"), ("ot", "o")):
        rows = rows.withColumn("key", F.when(F.col("status") != "rejected", _key(t, n)))
        rows = lookup(rows, entries.withColumnRenamed("canonical", f"_c{n}"), "key", hot, ["seq"], "left").drop("key")
    return rows.withColumns({"s": F.coalesce("_cs", "s"), "o": F.coalesce("_co", "o")}).select(*kg.columns)


def ground_techniques(names: DataFrame, techniques: DataFrame, least: float = 0.6) -> DataFrame:
    """name, technique_id and score of each distinct name (columns ``name``) that the ``techniques``
    (``technique_records``) have.

    The name itself without letter case comes first, then equal normal forms (both score 1; the last
    record of a name gives its technique), then the best Jaccard of words from ``least`` on, ties to
    the name that stands first. Candidates come from a join on the rarest words only: two sets that
    overlap so much share one of the first ``n - ceil(least * n) + 1`` of their words in any common
    order, here from the rarest in the catalogue to the most frequent.
    """
    asked = written(names.where("name is not null").select("name", F.lower(F.trim("name")).alias("low"), alnum_words(F.col("name")).alias("norm")).distinct())
    by_name = techniques.groupBy(F.lower("name").alias("low")).agg(F.max_by("technique_id", "rec_id").alias("technique_id"))
    listed = techniques.withColumn("t_norm", alnum_words(F.col("name"))).where("t_norm <> ''").groupBy("t_norm").agg(F.max_by("technique_id", "rec_id").alias("technique_id"), F.min("rec_id").alias("place"))
    listed = written(listed.withColumn("t_ws", F.array_distinct(F.split("t_norm", " "))))
    named = asked.join(by_name, "low").select("name", F.lit(3).alias("level"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("place"), "technique_id")
    equal = asked.join(listed, F.col("norm") == F.col("t_norm")).select("name", F.lit(2).alias("level"), F.lit(1.0).alias("score"), (-F.col("place")).alias("place"), "technique_id")

    norms = asked.where("norm <> ''").select("norm").distinct().withColumn("ws", F.array_distinct(F.split("norm", " ")))
    df = listed.select(F.explode("t_ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    single = written(norms.select("norm", "ws", F.explode("ws").alias("w")))
    hot = written(hot_keys(single.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w"))
    q = _rarest(lookup(single, df, "w", hot, ["norm"], "left"), "norm", "ws", least)
    t = _rarest(listed.select("t_norm", "t_ws", F.explode("t_ws").alias("w")).join(df, "w"), "t_norm", "t_ws", least)
    both = F.size(F.array_intersect("ws", "t_ws"))
    near = q.join(t, "w").select("norm", "t_norm", (both / (F.size("ws") + F.size("t_ws") - both)).alias("score")).where(F.col("score") >= least).distinct()
    similar = near.join(listed.select("t_norm", "technique_id", "place"), "t_norm").join(asked.select("name", "norm"), "norm").select("name", F.lit(1).alias("level"), "score", (-F.col("place")).alias("place"), "technique_id")
    best = named.unionByName(equal).unionByName(similar).groupBy("name").agg(F.max(F.struct("level", "score", "place", "technique_id")).alias("b"))
    return best.select("name", "b.technique_id", F.round("b.score", 6).alias("score"))


def _rarest(words: DataFrame, key: str, of: str, least: float) -> DataFrame:
    """``key``, ``of`` (its words) and w: the first words of each key by df, as many as a match needs."""
    ordered = words.groupBy(key, of).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))
    n = F.size("o")
    return ordered.select(key, of, F.explode(F.slice("o", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)["w"]).alias("w"))


def with_techniques(kg: DataFrame, mitre: DataFrame) -> DataFrame:
    """``kg`` with the catalogue's name of each technique end that it has, in the rows not rejected,
    and the ids of both appended to ``aids``, each once."""
    techniques = written(technique_records(mitre))
    live = F.col("status") != "rejected"
    ends = kg.where(live).select(F.explode(F.array(*[F.when(F.col(t) == "Technique", F.col(n)) for t, n in (("st", "s"), ("ot", "o"))])).alias("name")).where("name is not null")
    counts = written(ends.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    called = _latest(techniques, ["technique_id"], "rec_id").select("technique_id", F.col("name").alias("called"))
    found = written(ground_techniques(counts, techniques).join(called, "technique_id").select(F.col("name").alias("key"), "technique_id", "called"))
    hot = written(hot_keys(counts.withColumnRenamed("name", "key"), "key"))
    rows = kg
    for t, n in (("st", "s"), ("ot", "o")):
        rows = rows.withColumn("key", F.when(live & (F.col(t) == "Technique"), F.col(n)))
        rows = lookup(rows, found.toDF("key", f"_id{n}", f"_c{n}"), "key", hot, ["seq"], "left").drop("key")
    ids = F.array_distinct(F.concat("aids", F.array_compact(F.array("_ids", "_ido"))))
    return rows.withColumns({"s": F.coalesce("_cs", "s"), "o": F.coalesce("_co", "o"), "aids": F.when(live, ids).otherwise(F.col("aids"))}).select(*kg.columns)


def aligned(kg: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``kg`` with similar names of a document and type (``vectors``: type, name, v) under its most
    frequent one, the first of equals; of a document with merged names only the first of the rows not
    rejected that are now the same.

    A document's names of one type are few, so the ordered pass over them is a small group.
    """
    live = F.col("status") != "rejected"
    counts = kg.where(live).select("doc", F.explode(F.array(*[F.struct(F.col(t).alias("type"), F.col(n).alias("name")) for t, n in (("st", "s"), ("ot", "o"))])).alias("e")).groupBy("doc", "e.type", "e.name").agg(F.count(F.lit(1)).alias("n"))
    known = counts.where("doc is not null").join(vectors, ["type", "name"]).withColumn("id", F.row_number().over(Window.partitionBy("doc", "type").orderBy("name")).cast("long"))
    groups = known.groupBy("doc", "type").applyInPandas(lambda g: retrieve.led(g, least).merge(g[["id", "doc", "type", "name", "n"]], on="id"), "id long, leader long, doc string, type string, name string, n long")
    best = groups.groupBy("doc", "type", "leader").agg(F.max_by("name", F.struct("n", -F.col("id"))).alias("into"))
    merged = written(groups.join(best, ["doc", "type", "leader"]).where("name <> into").select("doc", "type", "name", "into"))
    rows = kg
    for t, n in (("st", "s"), ("ot", "o")):
        rows = rows.join(merged.toDF("doc", t, n, f"_i{n}"), ["doc", t, n], "left")
    rows = rows.withColumns({"s": F.when(live, F.coalesce("_is", "s")).otherwise(F.col("s")), "o": F.when(live, F.coalesce("_io", "o")).otherwise(F.col("o"))}).select(*kg.columns)
    # Rows of documents without merges, and rejected ones, stand alone.
    touched = rows.join(merged.select("doc", F.lit(1).alias("_touched")).distinct(), "doc", "left")
    alone = F.when(F.col("_touched").isNull() | ~live, F.col("seq"))
    first = Window.partitionBy("doc", F.trim(F.lower("s")), "rel", F.trim(F.lower("o")), alone).orderBy("seq")
    return touched.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*kg.columns)
