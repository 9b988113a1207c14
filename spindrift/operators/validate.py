"""Symbolic validation of triples: an ordered cascade of repairs, penalties and rejections.

Every step is a column expression over the row, so the whole cascade is one projection without a
shuffle. ``log`` holds an entry (category, action) for each thing that happened, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift import schema
from spindrift.functions.columns import allowed_pair, any_of, words
from spindrift.functions.identifiers import attack_id, cve, normal_ioc, type_of_untyped
from spindrift.functions.names import alnum_words


@dataclass(frozen=True)
class Policy:
    """What the validator rejects beyond the rules: short names, missing evidence, low confidence."""

    shortest_name: int = 1
    need_evidence: bool = False
    least_confidence: float = 0.0


def supports(evidence: Column, name: Column) -> Column:
    """Whether the evidence has the name, its only word, or three fifths of its words."""
    e, n = alnum_words(evidence), alnum_words(name)
    parts, have = words(n), words(e)
    held = F.size(F.filter(parts, lambda w: F.array_contains(have, w)))
    return (e != "") & (n != "") & (e.contains(n) | F.when(F.size(parts) == 1, F.array_contains(have, parts[0])).otherwise(held / F.greatest(F.size(parts), F.lit(1)) >= 0.6))


def _entry(when: Column, category: str, action: str) -> Column:
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(action).alias("action")))


def validate(kg: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``kg`` with s, st, rel, o, ot, conf and aids repaired, ``status`` (validated, repaired or
    rejected), ``reason`` (null unless rejected) and ``log``. Rows come in as raw, whatever their
    status was; every row comes out.
    """
    entries: list[Column] = []
    df = kg.withColumn("reason", F.when((F.col("s") == "") | (F.col("o") == "") | (F.col("rel") == ""), "empty_field").when(
        (F.length("s") < policy.shortest_name) | (F.length("o") < policy.shortest_name), "empty_field"))
    df = df.withColumn("fixed", F.lit(False)).withColumn("log", F.array(_entry(F.col("reason").isNotNull(), "empty_field", "rejected")))
    live = F.col("reason").isNull()

    def step(frame: DataFrame, changes: dict[str, Column], logged: list[Column]) -> DataFrame:
        return frame.withColumns(changes | {"log": F.concat("log", F.array(*logged)) if logged else F.col("log")})

    for c in ("s", "o"):  # identifiers
        named, good = live & F.lower(c).contains("cve"), cve(F.col(c))
        changed = named & good.isNotNull() & (good != F.col(c))
        df = step(df, {c: F.when(changed, good).otherwise(F.col(c)), "fixed": F.col("fixed") | changed}, [_entry(changed, "repaired_identifier", "repaired"), _entry(named & good.isNull(), "malformed_identifier", "flagged")])
    df = df.withColumns({c: F.when(live & (F.col(t) == "IOC"), normal_ioc(F.col(c))).otherwise(F.col(c)) for c, t in (("s", "st"), ("o", "ot"))})
    for c, t in (("s", "st"), ("o", "ot")):  # untyped names
        open_, better = live & (F.col(t) == "Other"), type_of_untyped(F.col(c))
        df = step(df, {t: F.when(open_, F.coalesce(better, F.col(t))).otherwise(F.col(t)), "fixed": F.col("fixed") | (open_ & better.isNotNull())}, [_entry(open_ & better.isNotNull(), "repaired_identifier", "repaired"), _entry(open_ & better.isNull(), "type_misassignment", "flagged")])

    obj, ev = F.lower("o"), F.lower("ev")  # near misses
    shadow = live & (F.col("rel") == "communicates_with") & any_of(obj, ["shadow", "vss"])
    df = step(df, {"rel": F.when(shadow, "targets").otherwise(F.col("rel")), "fixed": F.col("fixed") | shadow}, [_entry(shadow, "repaired_identifier", "repaired")])
    disclosed = live & (F.col("st") == "Organization") & (F.col("rel") == "exploits") & (F.col("ot") == "Vulnerability") & any_of(ev, schema.DISCLOSURE_HINTS)
    df = step(df, {"rel": F.when(disclosed, "associated_with").otherwise(F.col("rel")), "fixed": F.col("fixed") | disclosed}, [_entry(disclosed, "repaired_identifier", "repaired")])
    empty = live & F.col("rel").isin("targets", "communicates_with") & obj.isin(schema.LOW_VALUE)
    df = step(df, {"reason": F.when(empty, "generic_placeholder").otherwise(F.col("reason"))}, [_entry(empty, "generic_placeholder", "rejected")])

    fits = allowed_pair(F.col("st"), F.col("rel"), F.col("ot"), schema.TYPE_PAIRS)
    turned = allowed_pair(F.col("ot"), F.col("rel"), F.col("st"), schema.TYPE_PAIRS)
    df = df.withColumns({"_swap": live & ~fits & turned, "_bad": live & ~fits & ~turned})
    swap = F.col("_swap")
    df = step(
        df.select(*[c for c in df.columns if c not in ("s", "st", "o", "ot")], *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("s", "o"), ("o", "s"), ("st", "ot"), ("ot", "st"))]),
        {"fixed": F.col("fixed") | swap, "reason": F.when(F.col("_bad"), "impossible_type_pair").otherwise(F.col("reason"))},
        [_entry(swap, "repaired_identifier", "repaired"), _entry(F.col("_bad"), "impossible_type_pair", "rejected")],
    )
    loop = live & (F.lower("s") == F.lower("o")) & F.col("rel").isin(list(schema.TYPE_PAIRS))
    df = step(df, {"reason": F.when(loop, "self_loop").otherwise(F.col("reason"))}, [_entry(loop, "self_loop", "rejected")])

    lowered = lambda by: F.greatest(F.col("conf") - by, F.lit(0.1))
    bare = live & (F.col("ev") == "")
    if policy.need_evidence:
        df = step(df, {"reason": F.when(bare, "missing_evidence").otherwise(F.col("reason"))}, [_entry(bare, "missing_evidence", "rejected")])
    else:
        df = step(df, {"conf": F.when(bare, lowered(0.2)).otherwise(F.col("conf"))}, [_entry(bare, "missing_evidence", "flagged")])
    for c in ("s", "o"):
        vague = live & F.lower(c).isin(schema.PLACEHOLDERS)
        df = step(df, {"conf": F.when(vague, lowered(0.3)).otherwise(F.col("conf"))}, [_entry(vague, "generic_placeholder", "flagged")])
    empty = live & F.lower("o").isin(schema.LOW_VALUE)
    df = step(df, {"reason": F.when(empty, "generic_placeholder").otherwise(F.col("reason"))}, [_entry(empty, "generic_placeholder", "rejected")])

    df = df.withColumns({f"_{c}_in": (F.length(c) <= 3) | supports(F.col("ev"), F.col(c)) for c in ("s", "o")})
    neither = live & (F.col("ev") != "") & ~F.col("_s_in") & ~F.col("_o_in")
    one = live & (F.col("ev") != "") & (F.col("_s_in") != F.col("_o_in"))
    df = step(df, {"conf": F.when(neither, lowered(0.3)).when(one, lowered(0.1)).otherwise(F.col("conf"))}, [_entry(neither, "hallucinated_entity", "flagged"), _entry(one, "confidence_lowered", "flagged")])

    wrong = F.filter("aids", lambda a: ~attack_id(a))
    removed = F.when(live, F.transform(wrong, lambda a: F.struct(F.lit("malformed_identifier").alias("category"), F.lit("flagged").alias("action"))))
    df = df.withColumns({"log": F.concat("log", F.coalesce(removed, F.array())), "aids": F.when(live, F.filter("aids", attack_id)).otherwise(F.col("aids"))})
    if policy.least_confidence > 0:
        low = live & (F.col("conf") <= policy.least_confidence)
        df = step(df, {"reason": F.when(low, "confidence_lowered").otherwise(F.col("reason"))}, [_entry(low, "confidence_lowered", "rejected")])
    status = F.when(~live, "rejected").when(F.col("fixed"), "repaired").otherwise("validated")
    return df.withColumns({"status": status, "log": F.array_compact("log")}).drop("fixed", "_swap", "_bad", "_s_in", "_o_in")


def keep_best(kg: DataFrame) -> DataFrame:
    """Of the rows of a document with equal subject, relation and object (letter case ignored) the
    one of highest confidence, the earliest of equals; rejected rows all stay.

    One window by key, hence one shuffle and one pass; a document and key holds few rows, whatever
    the corpus. The filter stands above the window, so the planner does not copy the validator's
    cascade into it.
    """
    by = Window.partitionBy("doc", F.lower("s"), "rel", F.lower("o"), F.col("status") == "rejected").orderBy(F.desc("conf"), "seq")
    return kg.withColumn("_n", F.row_number().over(by)).where("_n = 1 or status = 'rejected'").drop("_n")


def error_log(validated: DataFrame) -> DataFrame:
    """One row per log entry: seq, position, doc, category, action."""
    # The outer form keeps the planner from copying the cascade into a filter on the list's size.
    return validated.select("seq", "doc", F.posexplode_outer("log").alias("position", "e")).where("e is not null").select("seq", "position", "doc", "e.category", "e.action")
