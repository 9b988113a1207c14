"""Small builders of column expressions from lists and ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether ``text`` contains one of ``parts``. Many parts are one alternation: a chain of tests would
    make the generated code of a cascade too long to be compiled well."""
    if len(parts) > 3:
        return text.rlike("|".join(map(re.escape, parts)))
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def ladder(text: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The value of the first rule of which ``text`` contains a part."""
    out = None
    for value, parts in rules:
        out = (F if out is None else out).when(any_of(text, parts), F.lit(value))
    return out.otherwise(otherwise)


def allowed_pair(subject: Column, relation: Column, obj: Column, pairs: dict[str, tuple[list[str], list[str]]]) -> Column:
    """Whether the table allows both types; relations it does not name allow any."""
    out = None
    for name, (subjects, objects) in pairs.items():
        out = (F if out is None else out).when(relation == name, subject.isin(subjects) & obj.isin(objects))
    return out.otherwise(F.lit(True))


def violation(subject: Column, relation: Column, obj: Column, pairs: dict[str, tuple[list[str], list[str]]]) -> Column:
    """Why the table does not allow the types, null if it does."""
    said = None
    for name, (subjects, objects) in pairs.items():
        parts = [F.when(~kind.isin(kinds), F.concat(kind, F.lit(f" is not valid as {role} of {name}"))) for kind, kinds, role in ((subject, subjects, "subject"), (obj, objects, "object"))]
        said = (F if said is None else said).when(relation == name, F.nullif(F.concat_ws("; ", *parts), F.lit("")))
    return said


def mapped(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The value of ``key`` in a small fixed table."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), otherwise)


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
