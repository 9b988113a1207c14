"""Outputs of other systems in the terms of this graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.columns import ladder, mapped
from spindrift.functions.relations import normalize_relation
from spindrift.functions.text import strip

#: Parts of one system's entity types, in the order in which they are tried.
FIRST_TYPES = [
    ("Malware", ["malware"]), ("ThreatActor", ["threat_actor", "attacker"]), ("Tool", ["tool"]), ("Vulnerability", ["vulnerability"]), ("Organization", ["organization"]), ("Location", ["location"]),
    ("Campaign", ["campaign"]), ("Technique", ["technique"]), ("Software", ["software"]), ("Infrastructure", ["infrastructure"]), ("IOC", ["ioc", "indicator"]), ("File", ["file"]),
]
#: Parts of another system's entity types, in the order in which they are tried.
SECOND_TYPES = [
    ("Malware", ["malware"]), ("ThreatActor", ["threat_actor"]), ("Tool", ["tool"]), ("Vulnerability", ["vulnerability", "vulnerablity"]), ("Software", ["vulnerable_software"]),
    ("Organization", ["organization", "identity"]), ("Location", ["location"]), ("Campaign", ["campaign"]), ("Technique", ["tactic", "technique", "attack_pattern"]), ("Software", ["software"]),
    ("Infrastructure", ["infrastructure", "infrastrcucture"]), ("IOC", ["domain_name", "ipv4_addr", "ipv6_addr", "url", "hash"]), ("File", ["file"]), ("IOC", ["email_address", "registy"]),
    ("Other", ["user_account", "process"]), ("Software", ["system", "platform"]),
]
#: That system's relations by their wording.
SECOND_RELATIONS = {
    "uses": ["use", "uses", "employ", "leverage", "utilize", "operate", "deploy", "execute", "run"],
    "targets": ["target", "targets", "attack", "compromise", "infect", "impact", "affect"],
    "exploits": ["exploit", "exploits", "has vulnerability"],
    "delivers": ["deliver", "delivers", "distribute", "spread"],
    "drops": ["drop", "drops", "install", "download"],
    "communicates_with": ["communicate-with", "communicate with", "connect to", "beacon-to", "beacon to", "exfiltrate-to", "resolve-to"],
    "mitigated_by": ["mitigate", "patch", "fix"],
    "attributed_to": ["attribute", "attributed_to", "belong-to", "belong to", "originate"],
    "located_in": ["locate-at", "locate at", "has geolocation"],
    "variant_of": ["variant", "variant_of", "is variant of"],
    "associated_with": ["modify"],
}
#: Parts of its other relations, in the order in which they are tried.
SECOND_STEMS = [
    ("uses", ["use", "employ", "leverage", "deploy"]), ("exploits", ["exploit"]), ("targets", ["target", "attack", "compromis", "infect"]), ("delivers", ["deliver", "distribut"]),
    ("drops", ["drop", "install", "download"]), ("communicates_with", ["communicat", "connect", "beacon", "exfiltrat"]), ("mitigated_by", ["mitigat", "patch"]),
    ("attributed_to", ["attribut", "belong"]), ("located_in", ["locat"]), ("variant_of", ["variant"]),
]


def _key(kind: Column) -> Column:
    return F.translate(strip(F.lower(kind)), "- ", "__")


def first_type(kind: Column) -> Column:
    """One system's entity type by the first part it contains."""
    return ladder(_key(kind), FIRST_TYPES, F.lit("Other"))


def second_type(kind: Column) -> Column:
    """Another system's entity type by the first part it contains."""
    return ladder(_key(kind), SECOND_TYPES, F.lit("Other"))


def second_relation(raw: Column) -> Column:
    """Its relation by wording, else by the first part it contains, else as any free relation."""
    key = strip(F.lower(raw))
    return mapped(key, {w: r for r, ws in SECOND_RELATIONS.items() for w in ws}, ladder(key, SECOND_STEMS, normalize_relation(raw)))


def text_triples(outputs: DataFrame) -> DataFrame:
    """doc, i, tactic, s, st, rel, o, ot of outputs (doc, tactic, text) with a line ``Name(Type); relation;
    Name(Type)`` for each triple, numbered or with a star. Lines of fewer parts are left out; a name
    without a type is Other."""
    lines = outputs.select("doc", "tactic", F.posexplode(F.split(strip(F.col("text")), "\n")).alias("i", "line"))
    bare = F.regexp_replace(strip(F.regexp_replace(strip(F.col("line")), r"^\d+\.", "")), r"^\*", "")
    parts = lines.withColumn("p", F.split(strip(bare), ";")).where("size(p) >= 3")
    name = lambda c: strip(F.substring_index(c, "(", 1))
    kind = lambda c: F.when(c.contains("("), strip(F.replace(F.substring_index(c, "(", -1), F.lit(")"), F.lit("")))).otherwise("Others")
    s, o = F.col("p")[0], F.col("p")[2]
    return parts.select("doc", "i", "tactic", name(s).alias("s"), second_type(kind(s)).alias("st"), second_relation(F.col("p")[1]).alias("rel"), name(o).alias("o"), second_type(kind(o)).alias("ot"))
