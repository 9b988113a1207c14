"""Words within a few edits of one another, by equi-joins on deletion variants (no pairwise compare).

Two words at most k edits apart (insertion, deletion, substitution; a swap of neighbours counts one)
share a string that remains after deleting at most k letters from each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Words of more letters are found by their parts: they would have too many deletion variants. Words
#: of up to three letters more are found by both, so that no pair falls between.
LONG = 24


def variants(word: str, k: int) -> set[str]:
    """``word`` without each choice of up to ``k`` of its letters."""
    n = len(word)
    out = {word}
    for d in range(1, min(k, n) + 1):
        for gone in combinations(range(n), d):
            at = [0, *(g + 1 for g in gone)]
            out.add("".join(word[a:b] for a, b in zip(at, [*gone, n])))
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits from ``a`` to ``b`` with swaps of neighbours; ``most`` + 1 if more. Only the band of
    cells that ``most`` edits can reach is computed, so long words cost their length."""
    over, width = most + 1, 2 * most + 1
    if abs(len(a) - len(b)) > most:
        return over
    before, last = [over] * width, [abs(o - most) if o >= most else over for o in range(width)]
    for i, x in enumerate(a, 1):
        row = [over] * width
        for o in range(width):
            j = i + o - most
            if j < 0 or j > len(b):
                continue
            if j == 0:
                row[o] = min(i, over)
                continue
            cost = last[o] + (x != b[j - 1])
            if o and row[o - 1] + 1 < cost:
                cost = row[o - 1] + 1
            if o + 1 < width and last[o + 1] + 1 < cost:
                cost = last[o + 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1] and before[o] + 1 < cost:
                cost = before[o] + 1
            row[o] = min(cost, over)
        if min(row) == over and min(last) == over:
            return over
        before, last = last, row
    return last[len(b) - len(a) + most]


def segments(word: str, k: int) -> set[str]:
    """What a long word is found by: of each of its 2k + 1 even parts, at any place that k edits can
    move it to and for any length of the other word, its hash with that length and its number.

    k edits, swaps among them, touch at most 2k parts, so one part is the same in both words. The
    word's own parts are among these: two words at most k edits apart always share one.
    """
    out, parts = set(), 2 * k + 1
    for length in range(max(parts, len(word) - k), len(word) + k + 1):
        for p in range(parts):
            start, end = p * length // parts, (p + 1) * length // parts
            for shift in range(-k, k + 1):
                if start + shift >= 0 and end + shift <= len(word):
                    piece = word[start + shift : end + shift]
                    out.add(f"\x01{length}.{p}.{hashlib.blake2b(piece.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}")
    return out


@F.pandas_udf(T.IntegerType())
def _with_swaps(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else distance(x, y, int(k)) for x, y, k in zip(a, b, most)], dtype="Int32")


def edit_distance(a: Column, b: Column, most: Column) -> Column:
    """Edits from ``a`` to ``b``, a swap of neighbours being one; more than ``most`` (at most three) if so.

    The JVM's distance counts a swap as two: it settles what is at most one edit apart and what is more
    than twice ``most`` apart, and only the pairs between go through Python.
    """
    plain = F.levenshtein(a, b, 6)
    open_ = plain.between(2, 2 * most)
    return F.when(open_, _with_swaps(F.when(open_, a), b, most)).when(plain.between(0, 1), plain).otherwise(most + 1)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, cut = [], []
        for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = variants(word, k) if len(word) <= LONG + 3 or not k else set()
            if k and len(word) > LONG:
                keys |= segments(word, k)
            for v in keys or {word}:
                words.append(word)
                cut.append(v)
            if len(words) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(cut, pa.string())], names=["word", "variant"])
                words, cut = [], []
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(cut, pa.string())], names=["word", "variant"])


def with_variants(words: DataFrame, word: str, edits: Column) -> DataFrame:
    """word and variant: what each distinct word is found by within ``edits`` (at most three)."""
    # A word has hundreds of variants: the few bytes of words are spread over all cores, in as many
    # tasks as a shuffle has, before they are made.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.select(F.col(word).alias("word"), edits.cast("int").alias("k")).where("word is not null").distinct()
    return distinct.repartition(tasks, "word").mapInArrow(_variants, "word string, variant string")


def near(left: DataFrame, right: DataFrame, edits) -> DataFrame:
    """a, b and d for each word of ``left`` and word of ``right`` (columns ``word``) that are at most
    ``edits(length of the longer)`` apart. ``edits`` maps a length column to a number of edits that
    grows with the length."""
    a = with_variants(left, "word", edits(F.length("word") + 1)).select(F.col("word").alias("a"), "variant")
    b = with_variants(right, "word", edits(F.length("word") + 1)).select(F.col("word").alias("b"), "variant")
    # Their number grows with the words, which the planner cannot see: never a broadcast.
    pairs = a.join(b.hint("merge"), "variant").select("a", "b").distinct()
    most = edits(F.greatest(F.length("a"), F.length("b")))
    return pairs.withColumn("d", edit_distance(F.col("a"), F.col("b"), most)).where(F.col("d") <= most)
