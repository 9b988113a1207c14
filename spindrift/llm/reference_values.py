"""Freely entered values as entries of a reference list (token-level repair and soft TF-IDF).

Distinct written values and the forms of the list have two readings: their words, and, as words may
run together or be torn apart, one single token of all their letters and digits. Each distinct token
is joined to the vocabulary of the same reading by edit distance. The forms are then ranked by soft
TF-IDF of the repaired tokens, whatever the reading, above one threshold, and the entry of the best
form is the value's. The results return to the rows by an equi-join that holds up against hot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import fold, strip
from spindrift.lineage import written as stored
from spindrift.llm.edits import near
from spindrift.operators.skew import hot_keys, lookup

#: Words and phrases that hedge or date a statement and say nothing about its entry.
HEDGES = [
    "allegedly", "apparently", "arguably", "evidently", "likely", "maybe", "perhaps", "possibly", "potentially", "presumably", "probably", "purportedly", "reportedly", "seemingly", "supposedly",
    "again", "also", "already", "currently", "formerly", "initially", "later", "previously", "recently", "sometimes", "still", "usually", "per analyst", "per source", "per vendor",
]
LEAST_SCORE = 0.85
UNMATCHED = "unmatched"


def plain(col: Column) -> Column:
    """Folded, without invisible characters and numbered notes such as [2], other signs as blanks."""
    text = F.regexp_replace(fold(col), r"\p{Cf}", "")
    text = F.regexp_replace(text, r"\[\d+\]", " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def _allowed(length: Column) -> Column:
    """Edits within which a token counts as written wrongly."""
    return F.when(length < 4, 0).when(length < 7, 1).when(length <= 12, 2).otherwise(3)


def _no_hedges(text: Column) -> Column:
    """Without hedges that stand as words, torn from the rest or run together among themselves."""
    words = "|".join(h.replace(" ", " ?") for h in HEDGES)
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"\b(?:{words})\b", " "), " +", " "))


def _glued(text: Column) -> Column:
    """Letters and digits in a row, without hedges stuck to either end."""
    stuck = "|".join(h.replace(" ", "") for h in HEDGES)
    return F.regexp_replace(F.regexp_replace(text, " ", ""), rf"^(?:{stuck})+(?=.{{4}})|(?<=.{{4}})(?:{stuck})+$", "")


def _tokens(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, reading and token of each value or form: its words, and all its letters in a row."""
    kind = "array<struct<reading:string,token:string>>"
    words = F.transform(F.filter(F.array_distinct(F.split("text", " ")), lambda w: w != ""), lambda w: F.struct(F.lit("words").alias("reading"), w.alias("token")))
    whole = F.when(F.col("whole") != "", F.array(F.struct(F.lit("whole").alias("reading"), F.col("whole").alias("token")))).otherwise(F.array().cast(kind))
    return df.select(*keep, F.explode(F.concat(words, whole)).alias("x")).select(*keep, "x.reading", "x.token")


def entries_of(values: DataFrame, reference: DataFrame) -> DataFrame:
    """list_name, written, entry and score of each distinct row of ``values`` (list_name, written).

    A value that no form of its list comes near to gets ``unmatched`` and score 0. Ties go to the
    entry first in byte order. Null values give no rows; blank ones are unmatched.
    """
    forms = reference.where("form is not null and entry is not null").select("list_name", "entry", plain(F.col("form")).alias("text")).where("text <> ''").distinct().withColumn("whole", _glued(F.col("text")))
    values = stored(values.where("written is not null").select("list_name", "written").distinct().withColumn("text", _no_hedges(plain(F.col("written")))).withColumn("whole", _glued(F.col("text"))))
    tokens = stored(_tokens(values, "list_name", "written").withColumn("at", F.struct("list_name", "reading", "token")))

    # The forms' tokens with their weights and the length of each form's vector.
    listed = _tokens(forms, "list_name", "entry", "text")
    sizes = forms.groupBy("list_name").agg(F.count(F.lit(1)).alias("forms"))
    idf = listed.groupBy("list_name", "reading", "token").agg(F.count(F.lit(1)).alias("df")).join(sizes, "list_name").withColumn("idf", F.log(1 + F.col("forms") / F.col("df"))).drop("df", "forms")
    vocabulary = listed.join(idf, ["list_name", "reading", "token"])
    lengths = vocabulary.groupBy("list_name", "entry", "text", "reading").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("f_norm"))
    vocabulary = stored(vocabulary.join(lengths, ["list_name", "entry", "text", "reading"]))
    # A token unlike all others weighs as much as the rarest one.
    top = vocabulary.groupBy("list_name").agg(F.max("idf").alias("top"))

    # Each distinct token with the forms it may belong to: at most the reference list. A slip costs half
    # its share of the letters, as both words still have the other half in common.
    found = stored(near(tokens.select(F.col("token").alias("word")).distinct(), vocabulary.select(F.col("token").alias("word")).distinct(), _allowed))
    found = found.withColumn("sim", 1 - F.col("d") / (2 * F.greatest(F.length("a"), F.length("b"))))
    meant = found.join(vocabulary, F.col("b") == F.col("token")).groupBy("list_name", "reading", "a", "entry", "text").agg(F.max(F.col("sim") * F.col("idf")).alias("x"), F.max("f_norm").alias("f_norm"), F.max("idf").alias("idf"))
    posted = meant.groupBy(F.struct("list_name", "reading", F.col("a").alias("token")).alias("at")).agg(F.collect_list(F.struct("entry", "text", "x", "f_norm")).alias("forms"), F.max("idf").alias("idf"))
    counts = tokens.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    each = lookup(tokens, stored(posted), "at", stored(hot_keys(counts, "at")), ["written"], "left").join(top, "list_name")
    each = each.select("list_name", "written", "reading", F.coalesce("idf", "top").alias("w"), "forms")
    # A value has few tokens: they come together once, and its forms are scored from there.
    whole = each.groupBy("list_name", "written", "reading").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"), F.flatten(F.collect_list(F.transform("forms", lambda f: F.struct(f["entry"].alias("entry"), f["text"].alias("text"), (F.col("w") * f["x"] / f["f_norm"]).alias("y"))))).alias("f"))
    scored = whole.select("list_name", "written", "reading", "q_norm", F.explode("f").alias("f")).groupBy("list_name", "written", "reading", "f.entry", "f.text").agg(F.round(F.sum("f.y") / F.first("q_norm"), 9).alias("score"))
    best = scored.where(F.col("score") >= LEAST_SCORE).groupBy("list_name", "written").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry")).alias("best"))
    return values.select("list_name", "written").join(best, ["list_name", "written"], "left").select(
        "list_name", "written", F.coalesce("best.entry", F.lit(UNMATCHED)).alias("entry"), F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("score"))


def mapped(rows: DataFrame, reference: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` (list_name, written and others) with entry and score; rows with a null value are left
    out. ``spread`` are columns that tell rows of one value apart."""
    counted = stored(rows.where("written is not null").groupBy("list_name", "written").agg(F.count(F.lit(1)).alias("n")))
    key = F.struct("list_name", "written")
    found = entries_of(counted, reference).select(key.alias("_value"), "entry", "score")
    hot = stored(hot_keys(counted.select(key.alias("_value"), "n"), "_value"))
    return lookup(rows.where("written is not null").withColumn("_value", key), found, "_value", hot, spread).drop("_value")


def entered_values(triples: DataFrame, entities: DataFrame, reference: DataFrame) -> DataFrame:
    """field, record_key, written, entry and score of every relation of ``triples`` and every key of
    ``entities.external_ids`` that is not exactly a form of its list; relations that are null or
    blank are left out."""
    relations = triples.where(strip(F.col("relation")) != "").select(
        F.lit("relation").alias("field"), F.lit("relation").alias("list_name"), F.col("seq").cast("string").alias("record_key"), F.col("relation").alias("written"))
    sources = entities.select(F.lit("external_ids").alias("field"), F.lit("id_source").alias("list_name"), F.col("node_id").alias("record_key"), F.explode(F.map_keys("external_ids")).alias("written"))
    exact = reference.select("list_name", F.col("form").alias("written")).distinct()
    free = relations.unionByName(sources).join(exact, ["list_name", "written"], "left_anti")
    return mapped(free, reference, ["field", "record_key"]).select("field", "record_key", "written", "entry", "score")
