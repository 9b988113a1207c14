"""Language of each document and of each segment of a mixed one (hyperdimensional profiles).

Every letter has a random vector of +1 and -1. A trigram's vector is the elementwise product of its
letters' vectors, each rotated by its place; a profile is the sum of its trigrams' vectors. The
languages' profiles come from labelled documents and are centred on their mean, so that what all
languages share (names) counts for none. Cosines are linear in the trigrams, hence the products
of every trigram with every profile are laid out once in a table, and a sentence is scored by
summing its trigrams' entries: no vector is built for the corpus' texts.

Sentences get the languages of the likeliest path through the document, in which a change costs as
much as ``SWITCH`` characters of average evidence. Log lines and lists of indicators are no running
text: they neither get a language nor count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The languages told apart.
LANGUAGES = ["en", "de", "fr", "es", "it", "ru"]
DIM = 1024
#: Documented bound of the sample that the profiles are fitted on: labelled rows per language.
SAMPLE = 400
SWITCH = 22.0
LEAST = 150
#: Cosines are scaled by this before they become a sentence's confidence; a segment has the mean of
#: its sentences'.
SHARPNESS = 12.0
PART_CHARS = 1_000_000


def _alphabet() -> tuple[np.ndarray, int]:
    """Index of each code point: 0 no letter, 1 a letter outside the alphabet; upper case as lower."""
    letters = [*"abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "œ", *(chr(c) for c in range(0x430, 0x450)), "ё"]
    table = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        if chr(c).isalpha():
            table[c] = 1
    for i, ch in enumerate(letters):
        table[ord(ch)] = i + 2
        if len(ch.upper()) == 1:
            table[ord(ch.upper())] = i + 2
    return table, len(letters) + 2


_INDEX, K = _alphabet()
_classes = np.zeros(0x10000, np.uint8)  # 1 white space, 2 ends a sentence, 4 unlike a word, 8 closes a quotation
for _c in range(0x10000):
    _ch = chr(_c)
    _classes[_c] = (1 if _ch.isspace() else 0) | (2 if _ch in ".!?…" else 0) | (4 if _ch.isdigit() or _ch in "/\\_@=<>|#[]{}" else 0) | (8 if _ch in "\"'”’»)" else 0)
_tables: dict[bytes, np.ndarray] = {}


def _letters() -> np.ndarray:
    return np.random.default_rng(20).choice(np.array([-1, 1], np.float32), size=(K, DIM))


def bundle(counts: dict[int, float]) -> np.ndarray:
    """The profile of trigrams given by code: the weighted sum of their bound vectors."""
    one = _letters()
    first, second = np.roll(one, 2, axis=1), np.roll(one, 1, axis=1)
    out = np.zeros(DIM, np.float64)
    codes = np.fromiter(counts, np.int64, len(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))
    for at in range(0, len(codes), 4096):
        c, w = codes[at : at + 4096], weights[at : at + 4096]
        out += w @ (first[c // (K * K)] * second[c // K % K] * one[c % K])
    return out


def score_table(profiles: np.ndarray) -> np.ndarray:
    """The product of every trigram's vector with every profile, by trigram code; kept in a worker."""
    key = profiles.tobytes()
    if key not in _tables:
        one = _letters()
        first, second = np.roll(one, 2, axis=1), np.roll(one, 1, axis=1)
        right = np.concatenate([one * p for p in profiles.astype(np.float32)]).T
        table = np.empty((K, K, K, len(profiles)), np.float32)
        for a in range(K):
            table[a] = ((second * first[a]) @ right).reshape(K, len(profiles), K).transpose(0, 2, 1)
        _tables.clear()
        _tables[key] = table.reshape(K**3, len(profiles))
    return _tables[key]


def _codes(text: str) -> np.ndarray:
    """Code points; those beyond the first plane count as no letter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 0x10000, c, 0xFFFC).astype(np.int64)


def trigrams(codes: np.ndarray) -> np.ndarray:
    """The code of the trigram around each character, words apart by the index of no letter."""
    x = _INDEX[codes].astype(np.int64)
    padded = np.concatenate([[0], x, [0]])
    code = padded[:-2] * (K * K) + padded[1:-1] * K + padded[2:]
    code[x == 0] = 0
    return code


def sentences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each sentence or line, and whether it is running text.

    A sentence ends at an end mark (and closing quotation marks) before white space, or at a line
    end. Running text: at least two tokens like words (letters, nothing unlike a word), which hold
    at least half of the sentence's characters other than white space.
    """
    n = len(codes)
    kind = _classes[codes]
    space = (kind & 1) == 1
    after = np.append(space[1:], True)
    mark = ((kind & 2) == 2) & after
    closing = ((kind & 8) == 8) & after
    closing[1:] &= (kind[:-1] & 2) == 2
    closing[:1] = False
    end = mark | closing | (codes == 10)
    end[-1] = True
    stops = np.nonzero(end)[0] + 1
    starts = np.concatenate([[0], stops[:-1]])
    # Tokens: runs without white space, cut at sentences.
    head = ~space
    head[1:] &= space[:-1] | end[:-1]
    at = np.nonzero(head)[0]
    if not len(at):
        return starts[:0], stops[:0], np.zeros(0, bool)
    letter = _INDEX[codes] > 0
    inner_dot = (codes == 46) & ~after
    odd = np.add.reduceat(((kind & 4) == 4) | inner_dot, at)
    letters = np.add.reduceat(letter, at)
    size = np.add.reduceat(~space, at)
    word = (odd == 0) & (letters > 0)
    of = np.searchsorted(stops, at, side="right")
    m = len(stops)
    total, words = np.bincount(of, size, m), np.bincount(of, size * word, m)
    many = np.bincount(of, word, m)
    # White space around a sentence is not part of it.
    first, last = np.full(m, n), np.full(m, -1)
    np.minimum.at(first, of, at)
    np.maximum.at(last, of, at + size - 1)
    some = total > 0
    return first[some], last[some] + 1, ((many >= 2) & (words * 2 >= total))[some]


def _path(evidence: np.ndarray) -> np.ndarray:
    """The likeliest languages of consecutive sentences."""
    best = evidence.argmax(1)
    if (best == best[0]).all():
        return best
    back = np.zeros(evidence.shape, np.int64)
    score = evidence[0].copy()
    for i in range(1, len(evidence)):
        top = int(score.argmax())
        moved = score[top] - SWITCH
        back[i] = np.where(score >= moved, np.arange(len(score)), top)
        score = np.maximum(score, moved) + evidence[i]
    out = np.empty(len(evidence), np.int64)
    out[-1] = int(score.argmax())
    for i in range(len(evidence) - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def segments(texts: list[str | None], profiles: np.ndarray, unit: float) -> list[list[tuple[int, int, int, float, int]]]:
    """For each text its segments: start, end, language, confidence, characters of running text."""
    table = score_table(profiles)
    out: list[list] = [[] for _ in texts]
    part: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if i < len(texts) and text:
            part.append(i)
            size += len(text) + 1
        if part and (size >= PART_CHARS or i == len(texts)):
            _score(part, [texts[k] for k in part], table, unit, out)
            part, size = [], 0
    return out


def _score(part: list[int], texts: list[str], table: np.ndarray, unit: float, out: list[list]) -> None:
    codes = _codes("\n".join(texts))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    start, end, running = sentences(codes)
    start, end = start[running], end[running]
    if not len(start):
        return
    code = trigrams(codes)
    points = table[code]
    points[code == 0] = 0
    total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(points, axis=0, dtype=np.float64)])
    raw = total[end] - total[start]
    # Trigram vectors are nearly orthogonal: a profile's squared length is DIM times the sum of
    # squared counts, for a sentence about its number of letters.
    letters = np.concatenate([[0], np.cumsum(code > 0)])
    cosine = raw / np.sqrt(np.maximum(letters[end] - letters[start], 1) * DIM)[:, None]
    sure = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
    sure /= sure.sum(1, keepdims=True)
    doc = np.searchsorted(begin, start, side="right") - 1
    edges = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1, [len(doc)]])
    evidence = raw / unit
    for a, b in zip(edges[:-1], edges[1:]):
        path = _path(evidence[a:b])
        cut = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1, [b - a]])
        k = int(doc[a])
        for x, y in zip(cut[:-1], cut[1:]):
            x, y = a + x, a + y
            lang = int(path[x - a])
            size = end[x:y] - start[x:y]
            s, t = int(start[x] - begin[k]), int(end[y - 1] - begin[k])
            # Blanks between sentences belong to the running text, other lines between them do not.
            gaps = start[x + 1 : y] - end[x : y - 1]
            out[part[k]].append((s, t, lang, float(np.average(sure[x:y, lang], weights=size)), int(size.sum() + (gaps == 1).sum())))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[str]] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(label, []).append(text)
        for label, texts in by.items():
            codes = _codes("\n".join(texts))
            start, end, running = sentences(codes)
            inside = np.zeros(len(codes) + 1, np.int64)
            np.add.at(inside, start[running], 1)
            np.add.at(inside, end[running], -1)
            code = trigrams(codes)[np.cumsum(inside[:-1]) > 0]
            value, n = np.unique(code[code > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(value), pa.string()), pa.array(value), pa.array(n)], names=["label", "code", "n"])


def label_of(lang):
    """The first two letters of a label in lower case."""
    return F.lower(F.substring(F.regexp_replace(lang, r"[^\p{L}]", ""), 1, 2))


def fit(documents: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Profiles of ``LANGUAGES`` and the evidence that one character gives on average.

    The sample is bounded: of each language the labelled rows whose hashed id is smallest, about
    ``sample`` of them. Rows without text or with another label take no part. Labels may be wrong
    for a part of them. Trigram counts come to the driver, at most one row a language and trigram of
    the fixed alphabet.
    """
    labelled = documents.select(label_of(F.col("lang")).alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h"), "text").where(F.col("label").isin(LANGUAGES))
    # Counted by label alone: texts are read for the sample only.
    sizes = labelled.groupBy("label").agg((F.lit(sample) / F.count(F.lit(1)) * 1_000_000).alias("limit"))
    chosen = labelled.join(F.broadcast(sizes), "label").where((F.col("h") < F.col("limit")) & F.col("text").isNotNull()).select("label", "text")
    counts = chosen.mapInArrow(_counts, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    profiles, shares = np.zeros((len(LANGUAGES), DIM)), []
    for i, lang in enumerate(LANGUAGES):
        own = counts[counts["label"] == lang]
        share = {int(c): n / max(1, own["n"].sum()) for c, n in zip(own["code"], own["n"])}
        shares.append(share)
        if share:
            profiles[i] = bundle(share)
    profiles -= profiles.mean(0)
    length = np.linalg.norm(profiles, axis=1, keepdims=True)
    profiles = np.divide(profiles, length, out=np.zeros_like(profiles), where=length > 0)
    table = score_table(profiles)
    margins = []
    for i, share in enumerate(shares):
        if share:
            mean = np.fromiter(share.values(), float) @ table[np.fromiter(share, np.int64)]
            margins.append(mean[i] - np.delete(mean, i).max())
    return profiles, float(max(np.mean(margins), 1e-6)) if margins else 1.0


_SEGMENTS = "doc_id long, label string, segments array<struct<char_start:int,char_end:int,lang:string,confidence:double,chars:int>>"


def _label(profiles: np.ndarray, unit: float):
    kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("chars", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments(batch.column(2).to_pylist(), profiles, unit)
            rows = [[{"char_start": s, "char_end": e, "lang": LANGUAGES[lang], "confidence": c, "chars": n} for s, e, lang, c, n in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["doc_id", "label", "segments"])

    return run


def labelled(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label (the stored one's first two letters) and segments of every row.

    Segments are runs of sentences in one language, with their offsets, language, confidence and
    characters of running text; none for null, blank and unread texts. Without labelled rows no
    language can be learnt and all evidence is zero: every text then gets the first language with
    the confidence of a guess.
    """
    profiles, unit = fit(documents, sample)
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(label_of(F.col("lang")), F.lit("")).alias("label"), F.col("text").cast("string")).mapInArrow(_label(profiles, unit), _SEGMENTS)


def held(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, label, lang, chars, confidence and main (is it the main language) of each language
    that a document holds: the main one, of most of its running text (ties in the order of
    ``LANGUAGES``), and every other with ``least`` or more characters."""
    order = F.array(*map(F.lit, LANGUAGES))
    sums = F.transform(order, lambda l: F.struct(
        F.aggregate(F.filter("segments", lambda s: s["lang"] == l), F.lit(0), lambda a, s: a + s["chars"]).alias("chars"),
        (-F.array_position(order, l)).alias("place"),
        l.alias("lang"),
        F.aggregate(F.filter("segments", lambda s: s["lang"] == l), F.lit(0.0), lambda a, s: a + s["confidence"] * s["chars"]).alias("weight")))
    each = labelled(documents).where("size(segments) > 0").select("doc_id", "label", sums.alias("sums")).withColumn("top", F.array_max("sums"))
    return each.select("doc_id", "label", F.col("top.lang").alias("main_lang"), F.explode("sums").alias("s")).where((F.col("s.lang") == F.col("main_lang")) | (F.col("s.chars") >= least)).select(
        "doc_id", "label", F.col("s.lang").alias("lang"), F.col("s.chars").alias("chars"), F.round(F.col("s.weight") / F.greatest(F.col("s.chars"), F.lit(1)), 6).alias("confidence"), (F.col("s.lang") == F.col("main_lang")).alias("main"))


def mislabelled(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and lang of each language of the documents that hold more than one, or whose label is
    missing, says nothing or is not the main language."""
    order = F.array(*map(F.lit, LANGUAGES))
    chars = F.transform(order, lambda l: F.struct(
        F.aggregate(F.filter("segments", lambda s: s["lang"] == l), F.lit(0), lambda a, s: a + s["chars"]).alias("chars"), (-F.array_position(order, l)).alias("place"), l.alias("lang")))
    each = labelled(documents).where("size(segments) > 0").select("doc_id", "label", chars.alias("c")).withColumn("main", F.array_max("c")["lang"])
    kept = each.select("doc_id", "label", "main", F.filter("c", lambda x: (x["lang"] == F.col("main")) | (x["chars"] >= least)).alias("c"))
    return kept.where((F.size("c") > 1) | (F.col("label") != F.col("main"))).select("doc_id", F.explode("c.lang").alias("lang"))
