"""Weak or wrong relations corrected by evidence and entity types: one ordered CASE per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.columns import any_of
from spindrift.functions.text import squash

_H = schema.HINTS
#: Endings that two malware names of one family share.
FAMILY_ENDINGS = ["locker", "ransomware", "rat", "loader", "stealer", "wiper", "bot"]
_CARRIED = ["Malware", "Tool", "File"]
_USABLE = ["Tool", "Software", "Technique", "Infrastructure", "IOC", "File", "Malware"]


def _row() -> tuple[Column, ...]:
    return F.col("rel"), F.col("st"), F.col("ot"), F.lower("ev")


def wrong_relation() -> Column:
    """The relation that the types and the evidence call for; null if nothing is wrong."""
    rel, st, ot, ev = _row()
    has = lambda *parts: any_of(ev, [p for ps in parts for p in ps])
    org_exploits = (rel == "exploits") & (st == "Organization") & (ot == "Vulnerability")
    weak = rel.isin("associated_with", "related_to")
    return (
        F.when(org_exploits & has(schema.DISCLOSURE_HINTS), "associated_with")
        .when(org_exploits & has(_H["mitigated_by"], ["release"]), "mitigated_by")
        .when(org_exploits & ~has(schema.EXPLOITED_HINTS), "associated_with")
        .when(org_exploits & has(schema.FOUND_HINTS), "associated_with")
        .when((rel == "exploits") & ~ot.isin("Vulnerability", "Software", "Infrastructure"), F.when(has(_H["targets"]), "targets").otherwise("uses"))
        .when((rel == "exploits") & (st == "Vulnerability") & (ot != "Vulnerability"), F.when(has(_H["targets"], ["impact"]), "targets").otherwise("associated_with"))
        .when(weak & st.isin("Malware", "Campaign", "Tool", "ThreatActor") & (ot == "ThreatActor") & (st.isin("Malware", "Campaign") | has(_H["attributed_to"], schema.TIED_HINTS)), "attributed_to")
        .when(weak & (st == "ThreatActor") & (ot.isin("Malware", "Tool") | ((ot == "Technique") & has(_H["uses"], schema.WIELDED_HINTS))), "uses")
        .when(rel.isin("related_to", "exploits", "associated_with") & st.isin("Vulnerability", "Malware") & ot.isin("Technique", "Other", "Malware") & has(_H["variant_of"]), "variant_of")
        .when((rel == "related_to") & st.isin("Campaign", "Infrastructure", "IOC") & ot.isin("Malware", "Tool") & has(_H["delivers"]), "delivers")
        .when(weak & st.isin("Malware", "ThreatActor", "Campaign") & ot.isin("Organization", "Software", "Location") & has(_H["targets"]), "targets")
        .when(weak & st.isin("Malware", "Campaign") & ot.isin("Tool", "Software", "Technique", "File") & has(_H["uses"], _H["drops"], _H["delivers"]), "uses")
    )


def from_evidence(strong: bool) -> Column:
    """The relation that the evidence names and the types allow; null if none."""
    _, st, ot, ev = _row()
    has = lambda r: any_of(ev, _H[r])
    s, o = F.lower("s"), F.lower("o")
    family = F.lit(False)
    for end in FAMILY_ENDINGS:
        family = family | (s.endswith(end) & o.endswith(end))
    out = (
        F.when(has("exploits") & ot.isin("Vulnerability", "Software", "Infrastructure"), "exploits")
        .when(has("communicates_with") & ot.isin("IOC", "Infrastructure"), "communicates_with")
        .when(has("drops") & ot.isin(_CARRIED), "drops")
        .when(has("delivers") & ot.isin(_CARRIED), "delivers")
        .when(has("uses") & ot.isin(_USABLE), "uses")
        .when(has("attributed_to") & ot.isin("ThreatActor", "Organization", "Location"), "attributed_to")
        .when(has("located_in") & (ot == "Location"), "located_in")
        .when(has("mitigated_by") & st.isin("Vulnerability", "Software", "Organization"), "mitigated_by")
        .when((st == "Malware") & (ot == "Malware") & (has("variant_of") | (family & (s != o))), "variant_of")
        .when(has("targets") & ot.isin("Organization", "Location", "Software", "Infrastructure", "IOC", "File", "Vulnerability", "Other"), "targets")
    )
    return out.when(ev.contains("uses") & ot.isin(_USABLE), "uses") if strong else out


def from_types() -> Column:
    """What a catch-all relation most likely is, by the types alone; null if they do not tell."""
    _, st, ot, _ = _row()
    return (
        F.when(st.isin("ThreatActor", "Organization", "Infrastructure") & (ot == "Location"), "located_in")
        .when(st.isin("ThreatActor", "Malware", "Campaign") & (ot == "Technique"), "uses")
        .when(st.isin("ThreatActor", "Malware", "Campaign") & ot.isin("Organization", "Software"), "targets")
        .when((st == "Malware") & (ot == "Malware"), "variant_of")
        .when(st.isin("Malware", "Tool") & ot.isin("IOC", "Infrastructure"), "communicates_with")
    )


def repair_relations(kg: DataFrame, promote: bool = False, need_mentions: bool = True) -> DataFrame:
    """``kg`` with ``rel`` corrected; validated rows that change become repaired, rejected ones stay.

    ``need_mentions`` leaves rows alone whose evidence does not name both ends; ``promote`` lets
    strong evidence replace ``associated_with``.
    """
    rel, _, ot, ev = _row()
    named = (F.col("s") != "") & (F.col("o") != "") & ev.contains(squash(F.lower("s"))) & ev.contains(squash(F.lower("o")))
    wrong = wrong_relation()
    weak = F.when(rel == "uses", "uses").when(rel == "drops", F.when(ot.isin(_CARRIED), "drops").otherwise("uses")).when((ev != "") & any_of(ev, _H["associated_with"]), "associated_with")
    better = (
        F.when(F.col("status") == "rejected", rel)
        .when(F.lit(need_mentions) & (ev != "") & ~named, rel)
        .when(wrong.isNotNull() & (wrong != rel), wrong)
        .when(rel == "associated_with", F.coalesce(from_evidence(True), rel) if promote else rel)
        .when(rel != "related_to", F.coalesce(weak, rel))
        .otherwise(F.coalesce(from_evidence(False), from_types(), rel))
    )
    df = kg.withColumn("_new", better)
    return df.withColumns({"status": F.when((F.col("_new") != rel) & (F.col("status") == "validated"), "repaired").otherwise(F.col("status")), "rel": F.col("_new")}).drop("_new")
