import pytest
from pyspark.sql import functions as F

from spindrift.functions import identifiers as ids
from spindrift.functions import names as nm
from spindrift.functions import relations as rl
from spindrift.functions import text as tx


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (tx.strip, "  a b\t\n", "a b"), (tx.squash, " a   b ", "a b"), (tx.alnum_key, None, ""), (tx.alnum_key, "Straße-5!", "strasse5"),
        (ids.refang, "hxxp://a[.]b[dot]c", "http://a.b.c"), (ids.ioc_subtype, "1[.]2.3.4", "ip"), (ids.ioc_subtype, "a@b.org", "email"), (ids.ioc_subtype, "https://x", "url"), (ids.ioc_subtype, "f" * 40, "hash"), (ids.ioc_subtype, "", "unknown"),
        (ids.cve, "see cve 2024-12345", "CVE-2024-12345"), (ids.cve, "cve", None), (ids.ipv4, "010.1.2.003", "10.1.2.3"), (ids.ipv4, "300.1.1.1", None), (ids.attack_id, "T1059.001", True), (ids.attack_id, "T12", False),
        (ids.type_of_untyped, "report.PDF", "IOC"), (ids.type_of_untyped, "night operation", "Campaign"), (ids.type_of_untyped, "pear", None),
        (rl.normalize_relation, " Is Behind ", "attributed_to"), (rl.normalize_relation, "has exploited", "exploits"), (rl.normalize_relation, "", "related_to"), (rl.normalize_relation, None, "related_to"),
        (rl.resolve_relation, "Communicates With", "communicates_with"), (rl.resolve_entity_type, "threat_actor", "ThreatActor"), (rl.resolve_entity_type, "", "Other"),
        (nm.for_match, "The a  Big  Fox", "big fox"), (nm.for_comparison, "The Fox-Den.", "foxden"), (nm.clean_name, "the exploit chain for iPhones", "exploit chain"), (nm.stem, "families", "family"), (nm.stem, "class", "class"),
    ],
)
def test_values(spark, f, text, want):
    assert value(spark, text, f) == want


def test_node_id(spark):
    row = spark.createDataFrame([("Malware", " A (b) 'c' ")], "t string, n string").select(nm.node_id(F.col("t"), F.col("n")).alias("y"))
    assert row.first()["y"] == "malware:a_b_c"
