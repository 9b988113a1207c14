"""Texts in sentences and chunks: work on one row at a time, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import strip

#: Points for a sentence's words, each given once.
FOCUS = [
    (5, r"cve-|zero-day|0-day"), (4, r"exploit|vulnerab|privilege escalation|remote code"), (3, r"deliver|drop|target|attribut|communicat|used|uses|deploy"),
    (2, r"malware|ransomware|trojan|backdoor|loader|threat actor|campaign"), (1, r"victim|organization|government|sector"), (2, r"\b(?:apt|fin)\d+\b"),
]


def sentences(text: Column, starts: str = "A-Z") -> Column:
    """The sentences of a text: cut after an end mark and white space before a character of ``starts``."""
    parts = F.transform(F.split(text, rf"(?<=[.!?])\s+(?=[{starts}])"), strip)
    return F.filter(parts, lambda s: s != "")


def focus_score(sentence: Column) -> Column:
    low = F.lower(sentence)
    score = F.when(F.length(sentence) < 45, -1).otherwise(0)
    for points, pattern in FOCUS:
        score = score + F.when(low.rlike(pattern), points).otherwise(0)
    return score


def focus_text(documents: DataFrame, n: int = 6) -> DataFrame:
    """doc_id, n_sentences and text: the ``n`` best sentences of positive score in their order, else
    the first three. Blank and null texts are left out."""
    rows = documents.select("doc_id", F.posexplode(sentences(strip(F.col("text")), "A-Z0-9")).alias("i", "sentence")).withColumn("score", focus_score(F.col("sentence")))
    by = Window.partitionBy("doc_id")
    ranked = rows.withColumns({"r": F.row_number().over(by.orderBy(F.desc("score"), "i")), "best": F.max("score").over(by)})
    kept = ranked.where(F.when(F.col("best") > 0, (F.col("r") <= n) & (F.col("score") > 0)).otherwise(F.col("i") < min(n, 3)))
    # At most n sentences a text are gathered.
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), "\n").alias("text"))


_BREAK, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def _by_sentence(text: str, limit: int, most: int) -> list[str]:
    """Sentences packed up to ``limit`` characters and ``most`` sentences (0: any number)."""
    out, part, n = [], "", 0
    for sentence in filter(None, map(str.strip, _SENTENCE.split(text))):
        if part and (len(part) + len(sentence) + 1 > limit or most and n >= most):
            out.append(part)
            part, n = "", 0
        part, n = f"{part} {sentence}" if part else sentence, n + 1
    return [*out, part] if part else out


def packed(text: str, limit: int, most: int) -> list[str]:
    """Paragraphs packed up to ``limit`` characters, longer ones by sentences; what is left at the end
    by sentences too if it has more than ``most`` of them."""
    out, buffer = [], ""
    for paragraph in filter(None, map(str.strip, _BREAK.split(text))):
        if len(paragraph) > limit:
            out += [buffer] if buffer else []
            out += _by_sentence(paragraph, limit, most)
            buffer = ""
        elif buffer and len(buffer) + len(paragraph) + 2 > limit:
            out.append(buffer)
            buffer = paragraph
        else:
            buffer = f"{buffer}\n\n{paragraph}" if buffer else paragraph
    return out + (_by_sentence(buffer, limit, most) if most else [buffer]) if buffer else out


_CHUNK = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])


def _chunked(limit: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, at = (text or "").strip(), 0
                for i, chunk in enumerate(packed(text, limit, most)):
                    found = text.find(chunk[:50], at)
                    start = found if found >= 0 else at
                    at = start + len(chunk)
                    rows.append((doc, i, None if doc is None else f"doc{doc}_chunk{i}", chunk, start, at))
            columns = zip(*rows) if rows else [[] for _ in _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNK)], schema=_CHUNK)

    return run


def chunks(documents: DataFrame, limit: int = 2000, sentences: int = 0) -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, char_start, char_end: paragraphs packed up to ``limit``
    characters, longer ones packed by sentences, ``sentences`` at most (0: any number).

    Offsets are found by a chunk's first fifty characters from the end of the one before, in the
    stripped text; where they are not found that end is taken. Blank and null texts give no rows.
    One pass over each text, in Arrow batches: as folds of column expressions the packing copied its
    buffers at every paragraph. No shuffle.
    """
    out = "doc_id long, chunk_index int, chunk_id string, text string, char_start int, char_end int"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunked(limit, sentences), out)


def inferred_evidence(source: Column, subject: Column, obj: Column) -> Column:
    """The first sentence with both names, else the first with either, else an empty text."""
    parts = F.split(strip(source), r"(?<=[.!?])\s+")
    s, o = F.lower(subject), F.lower(obj)
    both = F.try_element_at(F.filter(parts, lambda x: F.lower(x).contains(s) & F.lower(x).contains(o)), F.lit(1))
    either = F.try_element_at(F.filter(parts, lambda x: F.lower(x).contains(s) | F.lower(x).contains(o)), F.lit(1))
    return strip(F.coalesce(both, either, F.lit("")))
