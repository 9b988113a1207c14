"""From responses of models to triples: parsing, turning of passive relations, splitting of lists,
filters, further passes, and links between the parts of a document's graph.

Models answer elsewhere; every function takes their stored responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift import schema
from spindrift.functions.columns import any_of
from spindrift.functions.names import clean_name
from spindrift.functions.relations import normalize_relation, resolve_entity_type, resolve_relation
from spindrift.functions.text import strip
from spindrift.operators import graphs, pairs
from spindrift.operators.segment import inferred_evidence
from spindrift.sources import responses

#: Wordings by which the object acts on the subject.
PASSIVE_TARGETS = [
    "victim_of", "victim of", "impacted_by", "impacted by", "targeted_by", "targeted by", "attacked_by", "attacked by", "infected_by", "infected by",
    "encrypted_by", "encrypted by", "compromised_by", "compromised by",
]
PASSIVE_USES = ["used_by", "used by", "deployed_by", "deployed by"]
PASSIVE_ATTRIBUTION = ["operated_by", "operated by", "run_by", "run by"]
#: What may suffer and who may act, use and be behind something.
SUFFERS, ACTS = ["Organization", "Software", "Infrastructure", "Location", "File", "IOC", "Other"], ["ThreatActor", "Malware", "Campaign", "Tool"]
USED, USES = ["Malware", "Tool", "Technique", "Software", "File"], ["ThreatActor", "Campaign", "Organization"]
RUN, RUNS = ["Malware", "Campaign", "Tool"], ["ThreatActor", "Organization"]
#: Types whose names may be lists.
LISTABLE = ["ThreatActor", "Malware", "Tool", "Campaign", "Organization", "Location", "Software", "Technique"]
#: Objects that say nothing beside a weak relation.
GENERIC_OBJECTS = [
    "ransomware", "malware", "campaign", "threat actor", "threat actors", "actor", "actors", "tool", "tools", "technique", "techniques", "services", "multiple services",
    "various sectors", "sectors", "organizations", "rudimentary",
]
#: Malware in general.
GENERIC_MALWARE = ["ransomware", "malware", "trojan", "rat", "loader"]
#: Dates, amounts and counts.
MERE_NUMBERS = [
    r"^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{4}$",
    r"^\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^\$[\d,.]+(?:\s*(?:million|billion|m|bn))?$", r"^\d+\s+(?:organizations?|victims?|companies|entities|sectors|services|systems?)$",
]
#: Confidence of what other passes than the first find, and of links.
CAPS = {"supplement": None, "low_yield": 0.9, "document": 0.88, "focus": 0.88, "guided": 0.75, "link": 0.7}


def compound(name: Column, kind: Column) -> Column:
    """The members of a list of names (A, B and C) of a type that may be one: three or more, or two of at
    most six words each; else the name alone."""
    plain = F.replace(F.replace(name, F.lit(", and "), F.lit(", ")), F.lit(" and "), F.lit(", "))
    parts = F.filter(F.transform(F.split(plain, r"\s*[,;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    long = F.exists(parts, lambda p: F.size(F.split(p, r"\s+")) > 6)
    return F.when(kind.isin(LISTABLE) & ((F.size(parts) >= 3) | ((F.size(parts) == 2) & ~long)), parts).otherwise(F.array(name))


def actively(rows: DataFrame) -> DataFrame:
    """``rows`` (s, st, rel, o, ot and ``said``, the relation as written) with passive wordings turned
    round where the types agree, or read as attribution."""
    said = strip(F.replace(F.lower(F.coalesce("said", F.lit(""))), F.lit("-"), F.lit("_")))
    targets, uses, runs = (any_of(said, w) for w in (PASSIVE_TARGETS, PASSIVE_USES, PASSIVE_ATTRIBUTION))
    fits = lambda s, o: F.col("st").isin(s) & F.col("ot").isin(o)
    hit = targets & fits(SUFFERS, ACTS)
    used = ~targets & uses & fits(USED, USES)
    run = ~targets & ~uses & runs & fits(RUN, RUNS)
    turned = rows.withColumns({"_turn": hit | used, "_rel": F.when(hit, "targets").when(used, "uses").when(run, "attributed_to").otherwise(F.col("rel"))})
    put = lambda a, b: F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a))
    return turned.withColumns({"s": put("s", "o"), "o": put("o", "s"), "st": put("st", "ot"), "ot": put("ot", "st"), "rel": F.col("_rel")}).drop("_turn", "_rel")


def says_little(rel: Column, obj: Column, kind: Column) -> Column:
    """Whether a triple's object is empty, generic, a phrase, a mere date or number beside a weak relation."""
    o = F.lower(strip(obj))
    number = F.lit(False)
    for p in MERE_NUMBERS:
        number = number | o.rlike(p)
    phrase = o.startswith("to ") | o.startswith("on ") | o.startswith("as ")
    return (
        (o == "") | (o.isin(GENERIC_OBJECTS) & rel.isin("related_to", "associated_with", "variant_of", "targets"))
        | (phrase & rel.isin("related_to", "associated_with", "targets", "drops", "variant_of")) | (number & rel.isin("related_to", "associated_with", "targets"))
        | ((rel == "variant_of") & (kind == "Other") & o.isin(GENERIC_MALWARE)))


def extracted(answers: DataFrame, first: int | None = None) -> DataFrame:
    """Triples of ``answers`` (chunk_id, response, and text of the chunk where there is one): chunk_id, i
    (place in the response, counted from ``start`` where there is that column), part (place in a split list), event_id, s, st, rel, o, ot, ev, conf, status.

    Names are cleaned, types and relations resolved, passive relations turned, lists of objects split,
    empty facts dropped, missing evidence taken from the text, pronouns resolved within the chunk;
    ``first`` keeps so many triples of each chunk. One row a chunk is expected, or several with a
    ``start`` each; a response that is null or unreadable gives none.
    """
    text = F.col("text") if "text" in answers.columns else F.lit(None).cast("string")
    start = F.col("start") if "start" in answers.columns else F.lit(0)
    rows = answers.select("chunk_id", text.alias("text"), start.alias("start"), F.posexplode(responses.parsed(F.col("response"))).alias("i", "t")).where("t is not null").withColumn("i", F.col("start") + F.col("i"))
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    said = strip(filled("t.relation", "related_to"))
    named = rows.select(
        "chunk_id", "text", "i", *[clean_name(strip(F.coalesce(f"t.{x}", F.lit("")))).alias(c) for c, x in (("s", "subject"), ("o", "object"))],
        *[resolve_entity_type(filled(f"t.{x}", "Other")).alias(c) for c, x in (("st", "subject_type"), ("ot", "object_type"))], said.alias("said"), resolve_relation(said).alias("rel"),
        strip(F.coalesce(F.nullif("t.evidence", F.lit("")), "t.evidence_text", F.lit(""))).alias("ev")).where("s <> '' and o <> ''")
    single = actively(named).select("*", F.posexplode(compound(F.col("o"), F.col("ot"))).alias("part", "_o")).drop("o").withColumnRenamed("_o", "o")
    kept = single.where(~says_little(F.col("rel"), F.col("o"), F.col("ot")))
    evidence = F.when((F.col("ev") == "") & F.col("text").isNotNull(), inferred_evidence(F.col("text"), F.col("s"), F.col("o"))).otherwise(F.col("ev"))
    placed = kept.withColumns({"ev": evidence, "chunk": F.col("chunk_id"), "seq": F.col("i").cast("long") * 2**20 + F.col("part")})
    if first is not None:
        placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy("chunk").orderBy("seq"))).where(F.col("_n") <= first).drop("_n")
    done = pairs.resolve_pronouns(placed)
    return done.select("chunk_id", "i", "part", F.concat("chunk_id", F.lit("_t"), "i").alias("event_id"), "s", "st", "rel", "o", "ot", "ev", F.lit(1.0).alias("conf"), F.lit("raw").alias("status"))


def with_pass(known: DataFrame, found: DataFrame, cap: float | None) -> DataFrame:
    """``known`` and those of ``found`` (another pass, with the same columns) whose triple its document
    lacks either way round, their confidence at most ``cap``."""
    fresh = pairs.additions(known, found)
    return known.unionByName(fresh if cap is None else fresh.withColumn("conf", F.least("conf", F.lit(cap))))


def guided(known: DataFrame, found: DataFrame) -> DataFrame:
    """What answers about pairs add to ``known``: triples that its documents lack either way round, at
    the confidence of this pass. Rejected triples do not count as known."""
    return pairs.additions(known.where("status <> 'rejected'"), found).withColumn("conf", F.lit(CAPS["guided"]))


def low_yield(triples: DataFrame, chunks: DataFrame, checked: DataFrame, most_raw: int = 2, most_valid: int = 1) -> DataFrame:
    """doc, raw and valid of the documents worth another pass: of a single chunk, with at most
    ``most_raw`` triples, at most ``most_valid`` of them not rejected in ``checked``.

    ``chunks`` has doc and chunk_id; documents without triples count as well.
    """
    alone = chunks.where("doc is not null").groupBy("doc").agg(F.countDistinct("chunk_id").alias("chunks")).where("chunks = 1").select("doc")
    raw = triples.groupBy("doc").agg(F.count(F.lit(1)).alias("raw"))
    # Counted, not filtered: the planner would copy the validator's cascade into a filter.
    valid = checked.groupBy("doc").agg(F.count_if(F.col("status") != "rejected").alias("valid"))
    none = F.lit(0).cast("long")
    sized = alone.join(raw, "doc", "left").join(valid, "doc", "left").select("doc", F.coalesce("raw", none).alias("raw"), F.coalesce("valid", none).alias("valid"))
    return sized.where((F.col("raw") <= most_raw) & (F.col("valid") <= most_valid))


def link_requests(kg: DataFrame, attempts: int = 5) -> DataFrame:
    """doc, n, and type and name of the two ends (a, b) of the links worth asking for: the main node of
    each document's largest component with those of the next ``attempts`` ones."""
    nodes = graphs.main_nodes(kg)
    part = lambda c, i: F.split(c, "::", 2)[i]
    topic = nodes.where("rank = 1").select("doc", F.col("main_node").alias("a"))
    rest = nodes.where((F.col("rank") > 1) & (F.col("rank") <= attempts + 1)).select("doc", (F.col("rank") - 1).alias("n"), F.col("main_node").alias("b"))
    return topic.join(rest, "doc").select("doc", "n", part("a", 0).alias("type_a"), part("a", 1).alias("name_a"), part("b", 0).alias("type_b"), part("b", 1).alias("name_b"))


def predicted_links(asked: DataFrame) -> DataFrame:
    """doc, n, s, st, rel, o, ot, ev, conf, status of the answers (``link_requests`` with ``response``) that
    give a triple with at least one of the ends asked for; unknown types are Other."""
    rows = asked.withColumn("t", responses.link(F.col("response"))).where("not t.skip")
    name = lambda c: strip(F.coalesce(f"t.{c}", F.lit("")))
    kind = lambda c: F.when(F.col(f"t.{c}").isin(schema.ENTITY_TYPES), F.col(f"t.{c}")).otherwise("Other")
    done = rows.select("doc", "n", "name_a", "name_b", name("subject").alias("s"), kind("subject_type").alias("st"), normalize_relation(strip(F.coalesce(F.nullif("t.relation", F.lit("")), F.lit("related_to")))).alias("rel"),
        name("object").alias("o"), kind("object_type").alias("ot"), F.coalesce("t.evidence", F.lit("")).alias("ev"), F.lit(CAPS["link"]).alias("conf"), F.lit("raw").alias("status"))
    meant = F.arrays_overlap(F.array(F.lower("s"), F.lower("o")), F.array(F.lower("name_a"), F.lower("name_b")))
    return done.where((F.col("s") != "") & (F.col("o") != "") & meant).drop("name_a", "name_b")
