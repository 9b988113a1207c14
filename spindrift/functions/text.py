"""Column functions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space in a Java character class, with the ASCII separators that count as such.
SPACE = r"[\s\x1c-\x1f\x85 ]"


def strip(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def plain(col: Column) -> Column:
    """Whether a text is printable ASCII without blanks at its ends or next to each other, so that ``strip``
    and ``squash`` leave it as it is; told without a search but for control characters."""
    return (F.octet_length(col) == F.char_length(col)) & ~col.startswith(" ") & ~col.endswith(" ") & ~col.contains("  ") & ~col.rlike(r"[\x00-\x1f]")


def squash(col: Column) -> Column:
    """Stripped, each run of white space one blank."""
    return strip(F.regexp_replace(col, rf"(?U){SPACE}+", " "))


def fold(col: Column) -> Column:
    """Letter case removed; upper before lower lets letters with several lower forms agree, and the
    sharp s agrees with the two letters that are its upper case."""
    return F.replace(F.lower(F.upper(col)), F.lit("ß"), F.lit("ss"))


def alnum_key(col: Column) -> Column:
    """Only letters and digits, without letter case; null counts as empty."""
    return F.regexp_replace(fold(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", "")
