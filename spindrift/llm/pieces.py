"""Splitting oversized texts at natural boundaries (content-defined chunking).

A rolling hash over the last ``WINDOW`` code points marks landmarks that depend on nothing but the
text around them. Going through the text, each piece ends at the first landmark between the
smallest and the largest size, moved to the nearest natural boundary of the strongest kind there is
within reach: end of a paragraph, of a line, of a sentence, of a clause, of a word. An edit moves
the cuts near it; after the next landmark the pieces are the same again. After every cut, whatever
its kind, the next piece begins within ``overlap`` before it: at the earliest sentence there, else at
the earliest word, else exactly that far back.

A cut that is no end of a paragraph tells the paragraph it divides: what lies between the ends of
paragraphs, the strongest of the boundaries, on either side of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = 24
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


@dataclass(frozen=True)
class Sizes:
    """Limits in code points. ``reach`` is how far a cut may move from its landmark."""

    largest: int = 2000
    smallest: int = 600
    overlap: int = 200
    reach: int = 400
    landmark_bits: int = 9


#: Kinds of natural boundaries, the strongest first; a match ends where a piece may end.
_KINDS = [re.compile(p) for p in (r"\n(?:[ \t\r]*\n)+", r"\n+", r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+", r"(?<=[,;:–—])\s+", r"\s+")]
_EDGE = " \t\r\n"


def landmarks(text: str, bits: int) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW code points ends in ``bits`` zeros."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n <= WINDOW:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        power = np.cumprod(np.full(n, _BASE))
        undo = np.cumprod(np.full(n, _INVERSE))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power)])
        rolled = (total[WINDOW:] - total[:-WINDOW]) * undo[WINDOW - 1 :]
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.nonzero(rolled >> np.uint64(64 - bits) == 0)[0] + WINDOW


def cuts(text: str, sizes: Sizes) -> list[tuple[int, int, str, tuple[int, int] | None]]:
    """Start, end and the kind of boundary at the end of each piece, and the span of the paragraph that
    the end divides, without white space around it (None if it divides none, or the same as the end
    before). The pieces cover the text."""
    n = len(text)
    if n <= sizes.largest:
        return [(0, n, "end", None)] if n else []
    marks = landmarks(text, sizes.landmark_bits)
    bounds = [np.fromiter((m.end() for m in kind.finditer(text)), np.int64) for kind in _KINDS]
    names = ["paragraph", "line", "sentence", "clause", "word"]
    out, start, last, told = [], 0, 0, -1
    while n - start > sizes.largest:
        low, high = max(last + 1, start + sizes.smallest), start + sizes.largest
        i = int(np.searchsorted(marks, low))
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut, kind = mark, "none"
        # Near the landmark first, then anywhere between the sizes: a hard cut only where nothing is.
        for near in (sizes.reach, sizes.largest):
            for name, at in zip(names, bounds):
                a, b = np.searchsorted(at, [max(low, mark - near), min(high, mark + near) + 1])
                if a < b:
                    cut, kind = int(at[a + np.argmin(np.abs(at[a:b] - mark))]), name
                    break
            if kind != "none":
                break
        divided = None
        if kind != "paragraph":
            k = int(np.searchsorted(bounds[0], cut, side="right"))
            a, b = int(bounds[0][k - 1]) if k else 0, int(bounds[0][k]) if k < len(bounds[0]) else n
            body = text[a:b].strip(_EDGE)
            if body and told != a:
                first = a + len(text[a:b]) - len(text[a:b].lstrip(_EDGE))
                divided, told = (first, first + len(body)), a
        out.append((start, cut, kind, divided))
        back = max(cut - sizes.overlap, start + 1)
        last, start = cut, back
        for at in (bounds[2], bounds[4]):
            a, b = np.searchsorted(at, [back, cut])
            if a < b:
                start = int(at[a])
                break
    out.append((start, n, "end", None))
    return out


def _rows(sizes: Sizes, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("boundary", pa.string()), ("inside_start", pa.int64()), ("inside_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or not text.strip():
                    continue
                for i, (start, end, kind, divided) in enumerate(cuts(text, sizes)):
                    rows.append((doc, i, f"doc{doc}_chunk{i}", text[start:end] if with_text else None, start, end, kind, *(divided or (None, None))))
                    if len(rows) >= 4000:
                        yield _batch(rows, schema)
                        rows = []
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def split_texts(documents: DataFrame, sizes: Sizes = Sizes(), key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Pieces of every text: doc_id, chunk_index, chunk_id, text, char_start, char_end (zero-based
    code points, end exclusive), boundary (what the piece ends at; ``none`` where the text has no
    boundary between the sizes), and the span of the paragraph that its end is the first to divide,
    null if none. Each piece but the first begins before the one before it ends, by at most the
    overlap. ``with_text`` false leaves text null and spares its way out of Python.

    Null, empty and blank texts give no pieces; a text within the limit is one. Every piece is the
    stored text between its offsets. Repeated ids give pieces of each row. No shuffle.
    """
    out = "doc_id long, chunk_index int, chunk_id string, text string, char_start long, char_end long, boundary string, inside_start long, inside_end long"
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_rows(sizes, with_text), out)


def oversized_paragraphs(documents: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, char_start, char_end of each paragraph longer than the largest piece.

    Pieces end at most that far apart, so at least one of them ends inside each such paragraph and
    divides it: the cuts tell the paragraphs, the length decides.
    """
    cut = split_texts(documents, sizes, with_text=False).where(F.col("inside_end") - F.col("inside_start") > sizes.largest)
    return cut.select("doc_id", F.col("inside_start").alias("char_start"), F.col("inside_end").alias("char_end"))


def coverage(documents: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, chars (of its text), gaps, too_long and apart of each text with pieces: characters that no
    piece has, pieces beyond the limit, and pieces that do not overlap the one before or do so by more
    than the overlap. What it costs is one window over the pieces' offsets."""
    rows = split_texts(documents, sizes, with_text=False)
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    shared = F.lag("char_end").over(by) - F.col("char_start")
    each = rows.select("doc_id", "char_start", "char_end", shared.alias("shared"))
    return each.groupBy("doc_id").agg(
        F.max("char_end").alias("chars"), (F.max("char_end") - F.sum(F.col("char_end") - F.col("char_start")) + F.coalesce(F.sum("shared"), F.lit(0))).alias("gaps"),
        F.count_if(F.col("char_end") - F.col("char_start") > sizes.largest).alias("too_long"), F.count_if((F.col("shared") <= 0) | (F.col("shared") > sizes.overlap)).alias("apart"))
