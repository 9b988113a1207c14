"""Relations written freely as one of the twelve."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.columns import ladder, mapped
from spindrift.functions.text import strip


def _by_stem(wording: str) -> str:
    return next((r for r, stems in schema.RELATION_STEMS if any(x in wording for x in stems)), "related_to")


#: The wordings that the stems would misread: only these need a lookup before the stems.
EXCEPTIONS = {w: r for r, ws in schema.RELATION_WORDINGS.items() for w in ws if _by_stem(w) != r}

#: The relations that keep their own name.
KEPT = [r for r in schema.RELATIONS if EXCEPTIONS.get(r, _by_stem(r)) == r]


def normalize_relation(raw: Column) -> Column:
    """A free relation by its wording, else by the first stem it contains, else ``related_to``."""
    return relation_of(relation_key(raw))


def relation_key(raw: Column) -> Column:
    return strip(F.lower(raw))


def relation_of(key: Column) -> Column:
    """The relation of a key; the ladder reads the key at each step."""
    return mapped(key, EXCEPTIONS, ladder(key, schema.RELATION_STEMS, F.lit("related_to")))


@lru_cache(1 << 15)
def relation_named(key: str) -> str:
    """``relation_of`` a key outside the JVM: keys are much fewer than rows."""
    return EXCEPTIONS.get(key) or _by_stem(key)


def resolve_relation(raw: Column) -> Column:
    """A model's relation: its name in any case, with or without underscores, else by stems."""
    key = F.replace(strip(F.lower(raw)), F.lit(" "), F.lit("_"))
    names = {r.replace("_", ""): r for r in schema.RELATIONS}
    return mapped(F.replace(key, F.lit("_"), F.lit("")), names, ladder(key, schema.MODEL_RELATION_STEMS, F.lit("related_to")))


def resolve_entity_type(raw: Column) -> Column:
    """A model's entity type: its name without case, blanks and underscores, else by stems."""
    key = F.translate(strip(F.lower(raw)), " _", "")
    names = {t.lower(): t for t in schema.ENTITY_TYPES}
    return mapped(key, names, ladder(key, schema.MODEL_TYPE_STEMS, F.lit("Other")))
