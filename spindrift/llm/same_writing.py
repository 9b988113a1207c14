"""Records that differ only in how they are written: letter case, white space, punctuation, field order.

Each record becomes its identifier and the hash of its canonical key, stored once. Hot keys (more
rows than one task should get) are found exactly from partial counts. Their rows go through a salted
two-level aggregation, with as many parts a key as its rows need; there is at most one such key for
every ``MOST`` rows, so their results are broadcast back. All other rows take one shuffle by key, in
which the smallest identifier and the number of copies come from a window.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindrift.functions.text import alnum_key
from spindrift.lineage import checkpointed, written
from spindrift.operators.skew import MOST, hot_keys

FIELDS = ("subject", "relation", "object")

_parsed = T.StructType([T.StructField("ok", T.BooleanType())] + [T.StructField(f, T.StringType()) for f in FIELDS])
_fence = re.compile(r"^\s*```\w*\s*(.*?)\s*```\s*$", re.S)
_pair = re.compile(r"\s*(\w+)\s*[=:]\s?(.*)", re.S)


def parse_record(line: str | None) -> dict[str, str | None] | None:
    """The fields of one line in any of the known notations; None unless all three are there.

    Notations: JSON or a Python literal (plain, fenced, in any letter case of the names), and
    name=value or name: value pairs between ``|`` or ``;``. A line cut off inside a field is None
    where the notation shows it.
    """
    if line is None:
        return None
    text = m[1] if (m := _fence.match(line)) else line.strip()
    found: dict[str, str | None] = {}
    if text[:1] in "{[":
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(text)
                break
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                value = None
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        if not isinstance(value, dict):
            return None
        for k, v in value.items():
            found[str(k).strip().lower()] = v if v is None or isinstance(v, str) else json.dumps(v)
    else:
        for part in re.split(r"\s*\|\s*(?=\w+\s*[=:])" if "|" in text else r"\s*;\s*(?=\w+\s*[=:])", text):
            if m := _pair.fullmatch(part):
                found.setdefault(m[1].lower(), m[2])
    return {f: found[f] for f in FIELDS} if all(f in found for f in FIELDS) else None


@F.pandas_udf(_parsed)
def _parse(lines: pd.Series) -> pd.DataFrame:
    rows = [parse_record(x if isinstance(x, str) else None) for x in lines]
    return pd.DataFrame({"ok": [r is not None for r in rows]} | {f: [r and r[f] for r in rows] for f in FIELDS})


def claim_records(triples: DataFrame, raw: DataFrame) -> DataFrame:
    """seq, subject, relation, object of all triples and of the raw lines that hold all three fields."""
    lines = raw.select("seq", _parse("record").alias("p")).where("p.ok").select("seq", *[f"p.{f}" for f in FIELDS])
    return triples.select("seq", *FIELDS).unionByName(lines)


def collapse(records: DataFrame, ident: str, fields: tuple[str, ...], most: int = MOST) -> DataFrame:
    """``ident``, ``first`` (the smallest ident of the group) and ``copies`` of every record.

    Two records are copies if ``fields`` agree one by one after ``alnum_key``; null equals empty.
    Records whose fields are all empty are copies of one another. Other columns are ignored. The
    key is a 128-bit hash of the folded fields, so long texts are never shuffled.
    """
    # Counting, salting and collapsing all read this: the records are parsed and folded once.
    keyed = written(records.select(F.col(ident).alias("_id"), F.unhex(F.md5(F.concat_ws("\x01", *[alnum_key(F.col(f)) for f in fields]))).alias("_key")))
    hot = checkpointed(hot_keys(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), "_key", most=most))
    flagged = keyed.join(F.broadcast(hot), "_key", "left")
    rest = Window.partitionBy("_key")
    cold = flagged.where("parts is null").select("_id", F.min("_id").over(rest).alias("first"), F.count(F.lit(1)).over(rest).alias("copies"))
    warm = flagged.where("parts is not null")
    first_level = warm.groupBy("_key", F.pmod(F.xxhash64("_id"), F.col("parts")).alias("_salt")).agg(F.min("_id").alias("m"), F.count(F.lit(1)).alias("c"))
    groups = first_level.groupBy("_key").agg(F.min("m").alias("first"), F.sum("c").alias("copies"))
    # One row for every `most` rows or more.
    back = warm.join(F.broadcast(groups), "_key").select("_id", "first", "copies")
    return cold.unionByName(back).withColumnRenamed("_id", ident)


def claims(triples: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per claim: first_seq, copies and the first record's subject, relation and object."""
    records = claim_records(triples, raw)
    firsts = collapse(records, "seq", FIELDS).where("seq = first").select(F.col("seq").alias("first_seq"), "copies")
    return firsts.join(records, F.col("first_seq") == F.col("seq")).select("first_seq", "copies", *FIELDS)
