"""Equi-lookups whose left side may hold hot keys.

A key is hot if it holds more rows than one task should get (``MOST``). There are at most rows / MOST
of them, so their list may be broadcast: it has one small row for every MOST rows of data. A hot
key's rows are spread over as many parts as it needs, its entry is repeated once for each part, and
all rows take one shuffle in which no key and part holds more than about MOST rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may get.
MOST = 200_000
#: Parts over which rows without a key are spread.
NULL_PARTS = 256


def hot_keys(counts: DataFrame, key: str, n: str = "n", most: int = MOST) -> DataFrame:
    """key and parts of the keys of ``counts`` (one row a key) with more than ``most`` rows, null left out."""
    return counts.where((F.col(n) > most) & F.col(key).isNotNull()).select(key, F.ceil(F.col(n) / most).cast("int").alias("parts"))


def lookup(rows: DataFrame, entries: DataFrame, key: str, hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``entries`` (one row a key) on ``key``, the rows of ``hot`` keys in parts.

    ``spread`` are columns that tell rows of one key apart: their hash gives a row its part, so a
    task that runs again puts it into the same one. ``how`` is inner or left; null keys match
    nothing, ``left`` keeps their rows and spreads them as well.
    """
    few = F.broadcast(hot.select(key, F.col("parts").alias("_parts")))
    part = lambda n: F.pmod(F.xxhash64(*spread), n).cast("int")
    parted = rows.join(few, key, "left").withColumn("_part", F.when(F.col(key).isNull(), part(F.lit(NULL_PARTS))).when(F.col("_parts").isNotNull(), part(F.col("_parts"))).otherwise(0)).drop("_parts")
    repeated = entries.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return parted.join(repeated, [key, "_part"], how).drop("_part")
