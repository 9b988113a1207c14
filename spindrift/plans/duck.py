"""Pieces of DuckDB SQL from the same fixed values that the column functions use."""

from __future__ import annotations

from spindrift import schema

#: White space as RE2 writes it.
WS = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^{WS}+', ''), '{WS}+$', '')"


def any_of(col: str, parts) -> str:
    return "(" + " or ".join(f"contains({col}, {lit(p)})" for p in parts) + ")"


def ladder(col: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when {any_of(col, parts)} then {lit(v)}" for v, parts in rules) + f" else {otherwise} end"


def pairs(s: str, rel: str, o: str, table: dict) -> str:
    whens = " ".join(f"when {lit(r)} then {s} in {listed(a)} and {o} in {listed(b)}" for r, (a, b) in table.items())
    return f"(case {rel} {whens} else true end)"


def mapped(col: str, table: dict[str, str], otherwise: str) -> str:
    return f"(case {col} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + f" else {otherwise} end)"


def relation(col: str) -> str:
    key = strip(f"lower({col})")
    wordings = {w: r for r, ws in schema.RELATION_WORDINGS.items() for w in ws}
    return mapped(key, wordings, ladder(key, schema.RELATION_STEMS, "'related_to'"))


#: The triples as the graph takes them: texts stripped, nulls blank, types and statuses of the
#: vocabulary, confidence between 0 and 1 (else 1), the relation normalised.
KG = f"""kg0 as (
  select seq, source_doc_id as doc, source_chunk_id as chunk, {strip("coalesce(subject, '')")} as s, {strip("coalesce(object, '')")} as o,
    {strip("coalesce(evidence_text, '')")} as ev, case when subject_type in {listed(schema.ENTITY_TYPES)} then subject_type else 'Other' end as st,
    case when object_type in {listed(schema.ENTITY_TYPES)} then object_type else 'Other' end as ot,
    {relation("coalesce(relation, '')")} as rel,
    case when confidence >= 0 and confidence <= 1 and not isnan(confidence) then confidence else 1.0 end as conf,
    {strip("lower(coalesce(validation_status, ''))")} as status0, coalesce(attack_ids, []) as aids
  from triples),
kg as (select * exclude (status0), case when status0 in {listed(schema.STATUSES)} then status0 else 'raw' end as status from kg0)"""


def with_kg(rest: str) -> str:
    return f"with {KG}\n{rest}"
