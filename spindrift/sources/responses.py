"""Responses of models: prompts by template, replay of stored answers, and values read from text
that is only nearly JSON. Models are never called here: whoever runs one stores its answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentences for each relation.
SENTENCES = {
    "uses": "uses", "targets": "targets", "exploits": "exploits", "delivers": "delivers", "communicates_with": "communicates with", "drops": "drops", "attributed_to": "is attributed to",
    "associated_with": "is associated with", "variant_of": "is a variant of", "located_in": "is located in", "mitigated_by": "is mitigated by", "related_to": "is related to",
}
FIELDS = ["subject", "subject_type", "relation", "object", "object_type", "evidence", "evidence_text"]
_one = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
_rows = T.ArrayType(_one)


def verbalize(subject: Column, relation: Column, obj: Column) -> Column:
    """A triple as a sentence; an unknown relation in its own words, none as "is related to"."""
    known = F.coalesce(*[F.when(relation == r, t) for r, t in SENTENCES.items()], F.nullif(F.translate(relation, "_", " "), F.lit("")), F.lit("is related to"))
    return F.concat(subject, F.lit(" "), known, F.lit(" "), obj, F.lit("."))


def render(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by that value, null by nothing. Braces around anything but
    one of the names stay."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template) if values else [template]
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def pair_key(model: Column, premise: Column, hypothesis: Column) -> Column:
    """The key under which the score of a pair is stored."""
    return F.sha1(F.concat(model, F.lit("\0"), premise, F.lit("\0"), hypothesis))


def prompt_key(model: Column, content: Column) -> Column:
    """The key under which an answer is stored."""
    return F.substring(F.sha2(F.concat(model, F.lit("\0"), content), 256), 1, 32)


def replayed(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """``requests`` (model, prompt) with the stored answer (key, response), null where there is none."""
    keyed = requests.withColumn("key", prompt_key(F.col("model"), F.col("prompt")))
    return keyed.join(answers.select("key", "response").dropDuplicates(["key"]), "key", "left")


def objects_in(text: str) -> list[str]:
    """The outermost balanced {...} stretches of a text in their order, braces in strings apart."""
    found, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif ch == "{":
            start = start if depth else i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def _read(text: str) -> object:
    """The value of JSON text; None if it is none."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _commas(text: str) -> str:
    return re.sub(r",(\s*[}\]])", r"\1", text)


def triples_in(text: str | None) -> list[dict | None]:
    """The listed triples of a response, members that are no objects as None: JSON, JSON in prose or
    fences, with trailing commas or single quotes, or the whole objects of a list that was cut off.
    Nothing readable gives nothing."""
    if not text:
        return []
    text = re.sub(r"```\w*", "", text).strip()
    text = re.sub(r"^JSON\s*:\s*", "", text, flags=re.I)
    a, b = text.find("["), text.rfind("]")
    inner = [text[a : b + 1]] if 0 <= a < b and not 0 <= text.find("{") < a else []
    plain = _commas(text)
    single = [_commas(plain.replace("'", '"'))] if "'" in plain and '"' not in plain[:200] else []
    for attempt in (text, *inner, *sorted(dict.fromkeys(objects_in(text)), key=len, reverse=True), plain, *single):
        if (rows := _listed(_read(attempt))) is not None:
            return rows
    rest = (single or [plain])[0]
    at = rest.find("[", rest.find('"triples"')) if '"triples"' in rest else -1
    return [r for x in objects_in(rest[at:]) if at >= 0 and (r := _fields(_read(_commas(x)))) is not None]


def _fields(value: object) -> dict | None:
    return {f: None if value.get(f) is None else str(value[f]) for f in FIELDS} if isinstance(value, dict) else None


def _listed(value: object) -> list[dict | None] | None:
    """The list of triples that a payload holds; None if it holds none."""
    if isinstance(value, dict):
        for key in ("triples", "triplets", "predicted_triples"):
            if isinstance(value.get(key), list):
                value = value[key]
                break
        else:
            one = next((value[k] for k in ("triple", "predicted_triple") if isinstance(value.get(k), dict)), value)
            if one is value and not {"subject", "relation", "object"} <= value.keys():
                return None
            value = [one]
    return [_fields(r) for r in value] if isinstance(value, list) else None


@F.pandas_udf(_rows)
def _salvaged(responses: pd.Series) -> pd.Series:
    return responses.map(lambda x: triples_in(x) if isinstance(x, str) else None)


def parsed(response: Column) -> Column:
    """``triples_in`` of a response. Plain JSON is read by the JVM; only what it cannot read as a list of
    triples goes through Python."""
    text = F.trim(F.regexp_replace(response, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    plain = F.when(text.startswith("{") & text.endswith("}"), F.from_json(text, T.StructType([T.StructField("triples", _rows)]))["triples"])
    return F.coalesce(plain, _salvaged(F.when(plain.isNull(), response)))


@F.pandas_udf(T.StructType([*_one.fields[:6], T.StructField("skip", T.BooleanType())]))
def _links(responses: pd.Series) -> pd.DataFrame:
    rows = []
    for text in responses:
        text = re.sub(r"```(?:json)?", "", text).strip() if isinstance(text, str) else ""
        value = _read(text)
        if value is None and (m := re.search(r"\{[^{}]+\}", text)):
            value = _read(m[0])
        value = value if isinstance(value, dict) else {"skip": True}
        rows.append({f: None if value.get(f) is None else str(value[f]) for f in FIELDS[:6]} | {"skip": bool(value.get("skip"))})
    return pd.DataFrame(rows, columns=[*FIELDS[:6], "skip"])


def link(response: Column) -> Column:
    """The one triple that an answer about a link gives, and whether it gives none (skip)."""
    return _links(response)


def verdicts(response: Column) -> Column:
    """tp and n of a judge's JSON list of results, wrapped in prose or not; zeros if unreadable."""
    items = F.from_json(F.regexp_extract(response, r"(?s)(\[.*\])", 1), "array<struct<result:string>>")
    given = F.filter(items, lambda x: x["result"].isNotNull())
    return F.struct(F.coalesce(F.size(F.filter(given, lambda x: F.upper(x["result"]).startswith("TP"))), F.lit(0)).alias("tp"), F.coalesce(F.size(given), F.lit(0)).alias("n"))
