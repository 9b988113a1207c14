"""Literal cases of the vocabulary and the cascades, which the SQL checks share with the operators."""

import pytest
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions import identifiers, names, relations
from spindrift.functions.columns import violation


def values(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_relation_wordings(spark):
    want = {
        "uses": "uses", "exploited": "exploits", "is targeting": "targets", "some random relation": "related_to", "Focuses On": "targets", " focused on ": "targets", "runs on": "uses", "is": "variant_of",
        "is linked to": "attributed_to", "affected by": "exploits", "has": "associated_with", "attempted to deploy": "delivers", "from": "attributed_to", "developed in": "uses", "developed by": "attributed_to",
        "downloads and installs": "drops", "calls back to": "communicates_with", "operates in": "located_in", "operates": "uses", "recommended": "mitigated_by", "focus group": "targets", "": "related_to",
        "is a vulnerability in": "exploits", "was deployed": "drops", "released": "associated_with", "released by": "attributed_to", "conducts": "targets", "can perform": "uses",
    }
    assert dict(zip(want, values(spark, relations.normalize_relation, *want))) == want


def test_every_wording(spark):
    table = {w: r for r, ws in schema.RELATION_WORDINGS.items() for w in ws}
    assert len(table) == 212
    assert dict(zip(table, values(spark, relations.normalize_relation, *table))) == table


def test_sizes_of_tables():
    assert [len(x) for x in (schema.RELATIONS, schema.ENTITY_TYPES, schema.KNOWN_CASING, schema.COMPATIBLE, schema.COMPATIBLE_WIDE, schema.STIX_PAIRS, schema.TYPE_PAIRS)] == [12, 14, 37, 16, 19, 10, 10]


def test_types_of_models(spark):
    want = {"Threat Actor": "ThreatActor", "apt group": "ThreatActor", "ransomware": "Malware", "CVE": "Vulnerability", "ttp": "Technique", "operation": "Campaign", "country": "Location", "nothing": "Other", "IOC": "IOC"}
    assert dict(zip(want, values(spark, relations.resolve_entity_type, *want))) == want
    want = {"USES": "uses", "located in": "located_in", "switched to": "uses", "victim of": "targets", "evolved": "variant_of", "tied to": "associated_with", "zzz": "related_to"}
    assert dict(zip(want, values(spark, relations.resolve_relation, *want))) == want


def test_untyped_names(spark):
    want = {"mac mini": "Software", "Microsoft Office 365": "Software", "os": "Software", "Opera": "Software", "operation x": "Campaign", "lazarus": "ThreatActor", "aes-256": "Technique", "1.2.3.4": "IOC", ".mallox": "File", "phishing": "Technique", "spear phishing mails": "Technique", "pear": None}
    assert dict(zip(want, values(spark, identifiers.type_of_untyped, *want))) == want


def test_names(spark):
    assert values(spark, names.clean_name, "The Fox", "the a", "An Apple", "the the Foxes", "Fox from the Den", "a an Ox", "THE OWL") == ["Fox", "the a", "Apple", "the Foxes", "Fox", "an Ox", "OWL"]
    assert values(spark, names.for_match, "The a  Fox", "a the fox", "These those X", "an") == ["fox", "the fox", "x", "an"]
    assert values(spark, names.for_comparison, "The A. Fox", "a-b_c") == ["a fox", "abc"]
    assert values(spark, lambda x: names.node_id(F.lit("Malware"), x), "PlugX (variant)") == ["malware:plugx_variant"]


@pytest.mark.parametrize(("s", "rel", "o", "ok"), [("ThreatActor", "uses", "Malware", True), ("Vulnerability", "uses", "Location", False), ("Malware", "exploits", "Vulnerability", True), ("Malware", "exploits", "Organization", False), ("Other", "associated_with", "Other", True)])
def test_type_pairs(spark, s, rel, o, ok):
    why = spark.range(1).select(violation(F.lit(s), F.lit(rel), F.lit(o), schema.TYPE_PAIRS).alias("w")).first().w
    assert (why is None) == ok and (ok or "not valid" in why)
