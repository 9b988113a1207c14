"""Readers: each gives a DataFrame whose rows are checked on the way in; bad files and lines are
left out, never an error."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.columns import mapped
from spindrift.functions.relations import normalize_relation
from spindrift.functions.text import squash

#: Entity types of annotation files.
ANNOTATION_TYPES = {
    "Attacker": "ThreatActor", "Malware": "Malware", "Tool": "Tool", "Vulnerability": "Vulnerability", "Organization": "Organization", "Location": "Location", "Infrastructure": "Infrastructure",
    "Indicator:Domain": "IOC", "Indicator:Email": "IOC", "Indicator:File": "IOC", "Indicator:URL": "IOC", "Event": "Campaign", "Exploit Target": "Vulnerability",
    "Malware Characteristic:Behavior": "Technique", "Malware Characteristic:Capability": "Technique", "Malware Characteristic:Feature": "Technique",
    "Malware Characteristic:Payload": "Malware", "Malware Characteristic:Variants": "Malware",
}
_ANNOTATION = "text string, entities array<struct<entity_name:string,entity_type:string>>, explicit_triplets array<struct<subject:string,relation:string,object:string>>, _corrupt_record string"


def stem(path: Column) -> Column:
    """A path's file name without its last extension, decoded."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and gold triples (doc_id, i, subject, subject_type, relation, object,
    object_type) of a folder of annotation files. Of repeated entities the last type counts, other
    or unknown types are Other; broken files are left out."""
    raw = spark.read.schema(_ANNOTATION).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.where("_corrupt_record is null and text is not null").withColumn("doc_id", stem(F.input_file_name()))
    known = lambda n: F.try_element_at(F.reverse(F.filter("entities", lambda e: e["entity_name"] == n)), F.lit(1))["entity_type"]
    rows = raw.select("doc_id", "entities", F.posexplode("explicit_triplets").alias("i", "t"))
    typed = lambda c: mapped(F.coalesce(known(F.col(c)), F.lit("")), ANNOTATION_TYPES, F.lit("Other"))
    gold = rows.select("doc_id", "i", F.col("t.subject").alias("subject"), typed("t.subject").alias("subject_type"), normalize_relation(F.coalesce("t.relation", F.lit(""))).alias("relation"), F.col("t.object").alias("object"), typed("t.object").alias("object_type"))
    return raw.select("doc_id", "text"), gold


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title and text of whole files; the title is the stem in words."""
    files = spark.read.text(path, wholetext=True)
    return files.select(stem(F.input_file_name()).alias("doc_id"), F.initcap(F.translate(stem(F.input_file_name()), "-_", "  ")).alias("title"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that hold an object; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


_triples = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("s", "r", "o")]))


def bracket_triples(text: Column) -> Column:
    """The ``[s, r, o]`` groups of a text; further parts belong to the object, two have none. Groups with a
    blank part are left out."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda p: F.trim(p)))
    wide = F.filter(parts, lambda p: (F.size(p) >= 2) & (p[0] != "") & (p[1] != "") & ((F.size(p) == 2) | (F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))), "") != "")))
    return F.transform(wide, lambda p: F.struct(p[0].alias("s"), p[1].alias("r"), F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))), ", ").alias("o")))


def expanded(edges: DataFrame, subject: str, relation: str, obj: str) -> DataFrame:
    """Edges with lists for ends and relation as their combinations; an empty relation stays one."""
    clean = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return edges.withColumn("s", F.explode(clean(subject))).withColumn("r", F.explode(F.when(F.size(clean(relation)) > 0, clean(relation)).otherwise(F.array(F.lit(""))))).withColumn("o", F.explode(clean(obj)))


def _graph(text: str | None) -> list[dict] | None:
    try:
        value = ast.literal_eval(text) if text else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    if isinstance(value, dict):
        value = value.get("relations") or value.get("edges") or []
    out = []
    for e in value if isinstance(value, list) else []:
        if isinstance(e, dict):
            s, o = e.get("sub") or e.get("subject"), e.get("obj") or e.get("object")
            if s and o:
                out.append({"s": str(s), "r": str(e.get("rel") or e.get("relation") or ""), "o": str(o)})
    return out


@F.pandas_udf(_triples)
def python_graph(text: pd.Series) -> pd.Series:
    """A graph in Python notation (a list of edges, or a mapping that holds one) as edges."""
    return text.map(lambda x: _graph(x if isinstance(x, str) else None))


def examples(spark: SparkSession, path: str, triples: int = 8, chars: int = 1200) -> DataFrame:
    """id (by file name), doc, text and output of a folder of annotation files, as ``retrieve.few_shot``
    takes them: white space collapsed, so many characters, and the first triples with their types as
    JSON. Files without text or triples, and broken ones, are left out."""
    raw = spark.read.schema(_ANNOTATION).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.where("_corrupt_record is null").withColumns({"doc": stem(F.input_file_name()), "text": squash(F.coalesce("text", F.lit("")))}).where("text <> '' and size(explicit_triplets) > 0")
    kind = lambda n: F.coalesce(F.try_element_at(F.reverse(F.filter("entities", lambda e: e["entity_name"] == n)), F.lit(1))["entity_type"], F.lit("Other"))
    text = lambda c: F.coalesce(c, F.lit(""))
    listed = F.transform(F.slice("explicit_triplets", 1, triples), lambda t: F.struct(
        text(t["subject"]).alias("subject"), kind(t["subject"]).alias("subject_type"), F.coalesce(t["relation"], F.lit("related_to")).alias("relation"), text(t["object"]).alias("object"), kind(t["object"]).alias("object_type"), F.lit("").alias("evidence")))
    rows = raw.select("doc", F.substring("text", 1, chars).alias("text"), F.to_json(F.struct(listed.alias("triples"))).alias("output"))
    return rows.select(F.xxhash64("doc").alias("id"), "doc", "text", "output")


_EDGES = "array<struct<sub:string,rel:string,obj:string>>"


def gold_records(records: DataFrame) -> DataFrame:
    """doc, i, s, r, o of records (file_name, ground_truth_json): edges without an end are left out, broken
    JSON gives none."""
    rows = records.select(F.col("file_name").alias("doc"), F.posexplode(F.from_json("ground_truth_json", _EDGES)).alias("i", "e"))
    return rows.where("e.sub <> '' and e.obj <> ''").select("doc", "i", F.col("e.sub").alias("s"), F.coalesce("e.rel", F.lit("")).alias("r"), F.col("e.obj").alias("o"))


def as_list(text: Column) -> Column:
    """A JSON value as the texts it lists: a list without its blank members, another value alone, none for
    null and blank ones."""
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return F.coalesce(F.filter(items, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


_SYSTEM = "file_name string, generated_graph struct<relations:array<struct<sub:string,rel:string,obj:string>>>"


def system_outputs(spark: SparkSession, path: str) -> DataFrame:
    """doc, s, r, o of a folder of a system's stored graphs; ends and relations that are lists give all
    their combinations."""
    raw = spark.read.schema(_SYSTEM).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    edges = raw.where("file_name is not null").select(F.col("file_name").alias("doc"), F.explode("generated_graph.relations").alias("e"))
    return expanded(edges.select("doc", *[as_list(F.col(f"e.{x}")).alias(f"_{x}") for x in ("sub", "rel", "obj")]), "_sub", "_rel", "_obj").select("doc", "s", "r", "o")


_ITEM = "`Human Agreement` string, `Review edge` struct<sub:string,rel:string,obj:string>, Type string, `Ground Truth Graph` string, `Predict Graph` string, `LLM Decision` string"


def calibration_items(spark: SparkSession, path: str) -> DataFrame:
    """type, s, r, o, graph (edges on the other side), judge and human of reviewers' files: what they
    agree or disagree with, if the edge has both ends and there is a graph.

    A human finds the edge right if they agree that it is, or disagree that it is not. Graphs are
    JSON lists or, as text, in Python notation.
    """
    raw = spark.read.schema(_ITEM).option("multiLine", True).json(path).where(F.col("Human Agreement").isin("Agree", "Disagree"))
    text = F.when(F.col("Type") == "Precision", F.col("Ground Truth Graph")).otherwise(F.col("Predict Graph"))
    plain = F.transform(F.when(text.startswith("["), F.from_json(text, _EDGES)), lambda e: F.struct(e["sub"].alias("s"), F.coalesce(e["rel"], F.lit("")).alias("r"), e["obj"].alias("o")))
    parsed = F.coalesce(F.nullif(F.filter(plain, lambda e: (e["s"] != "") & (e["o"] != "")), F.array().cast("array<struct<s:string,r:string,o:string>>")), python_graph(F.when(plain.isNull(), text)))
    judge = F.upper(F.trim("LLM Decision")).startswith("TP")
    rows = raw.select(F.col("Type").alias("type"), F.col("Review edge").alias("e"), parsed.alias("graph"), F.coalesce(judge, F.lit(False)).alias("judge"), (F.col("Human Agreement") == "Agree").alias("agreed"))
    return rows.where("e.sub <> '' and e.obj <> '' and size(graph) > 0").select("type", F.col("e.sub").alias("s"), F.coalesce("e.rel", F.lit("")).alias("r"), F.col("e.obj").alias("o"), "graph", "judge", (F.col("judge") == F.col("agreed")).alias("human"))


def sentence_table(spark: SparkSession, path: str) -> DataFrame:
    """sentence, tactic, gold and baseline (bracket triples) of a CSV file with a header, by position."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    at = dict(zip(("sentence", "tactic", "gold", "baseline"), (raw.columns[i] for i in (0, 3, 4, 5))))
    named = [F.col(f"`{c}`").alias(n) for n, c in at.items()]
    return raw.select(*named).select("sentence", "tactic", *[F.coalesce(bracket_triples(F.col(c)), F.array().cast("array<struct<s:string,r:string,o:string>>")).alias(c) for c in ("gold", "baseline")])


def run_results(spark: SparkSession, path: str, arms: dict[str, str]) -> DataFrame:
    """pass, arm and value of a folder of runs' result files (``pass_*``): ``arms`` names the field, dotted,
    of each arm. Missing values are left out."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    found = raw.select(F.regexp_extract(F.input_file_name(), r"pass_(\w+)", 1).alias("pass"), F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f).cast("double").alias("value")) for a, f in arms.items()])).alias("x"))
    return found.select("pass", "x.arm", "x.value").where("value is not null")
