"""Evaluation texts that leaked into a corpus (greedy string tiling).

Seeds are runs of ``least`` words that an item and a text share; they are found by a Karp-Rabin
hash that rolls over the words of either side and are joined on it, and what the hash finds is then
compared word by word. A bit map over the items' seeds, of bounded size, spares the corpus' windows
that no item has their way to that join. For each pair
of item and text the seeds on a diagonal form matches; greedy string tiling marks the longest
match that nothing marked overlaps, again and again, so that reordered passages count as well. The
share of the item's words under tiles is its coverage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.lineage import written

LEAST = 12
#: The bit map has between 2**24 and 2**28 bits (2 to 32 MB), sixteen or more for each seed up to 16 million
#: seeds. With more of them it lets more windows pass, which the join then settles.
MAP_BITS = (24, 28)

_word = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x2545F4914F6CDD1D)


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits, letter case folded."""
    return _word.findall(text.casefold()) if text else []


def word_hashes(found: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word. ``known`` keeps them."""
    import xxhash

    out = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def windows(words: np.ndarray, least: int) -> np.ndarray:
    """The hash of each run of ``least`` words, rolled by Horner's rule over whole arrays."""
    n = len(words) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(least):
            h = h * _BASE + words[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _seeds(least: int, bitmap: np.ndarray | None, bits: int = 0):
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("n_words", pa.int32()), ("seed", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            ids, pos, sizes, seeds, runs = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                words = word_hashes(found, known)
                h = windows(words, least)
                at = np.arange(len(h), dtype=np.int32)
                if bitmap is not None and len(h):
                    bit = h & np.uint64((1 << bits) - 1)
                    at = at[(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if len(at) and key is not None:
                    ids.append(np.full(len(at), key, np.int64))
                    pos.append(at)
                    sizes.append(np.full(len(at), len(words), np.int32))
                    seeds.append(h[at].view(np.int64))
                    runs.extend(" ".join(found[k : k + least]) for k in at.tolist())
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0, t))
            yield pa.RecordBatch.from_arrays([cat(ids, np.int64), cat(pos, np.int32), cat(sizes, np.int32), cat(seeds, np.int64), pa.array(runs, pa.string())], schema=schema)

    return run


_SEED = "id long, pos int, n_words int, seed long, words string"


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Which hash values occur, by their last bits, and how many bits: at most 2**(MAP_BITS[1] - 6) words
    come to the driver."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, seeds.count()))), *MAP_BITS))
    mask = (1 << bits) - 1
    words = seeds.groupBy(F.shiftright(F.col("seed").bitwiseAND(mask), 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast((seed & {mask}) & 63 as int)))").alias("m"))
    whole = np.zeros(1 << (bits - 6), np.int64)
    got = words.toPandas()
    whole[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
    return whole.view(np.uint8), bits


def tiles(item_pos: np.ndarray, doc_pos: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of one pair: item position, text position and length of each tile.

    ``item_pos`` and ``doc_pos`` are the places of common windows of ``least`` words. The longest
    match goes first, ties to the smaller text position, then item position.
    """
    order = np.lexsort((doc_pos, doc_pos - item_pos))
    i, d = item_pos[order].astype(np.int64), doc_pos[order].astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(d - i) != 0) | (np.diff(d) != 1)
    at = np.nonzero(new)[0]
    length = np.diff(np.append(at, len(i))) + least - 1
    heap = [(-int(n), int(d[k]), int(i[k])) for k, n in zip(at, length)]
    if len(heap) == 1:
        n, x, y = heap[0]
        return [(y, x, -n)]
    import heapq

    heapq.heapify(heap)
    item_used, doc_used = np.zeros(int(i.max()) + least, bool), np.zeros(int(d.max()) + least, bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(item_used[y : y + n] | doc_used[x : x + n])
        if free.all():
            item_used[y : y + n] = doc_used[x : x + n] = True
            out.append((y, x, n))
            continue
        # What is left of an overlapped match may still be a tile.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), x + int(a), y + int(a)))
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("tiles", "covered", "longest", "doc_start", "doc_end")]))
def _tile(item_pos: pd.Series, doc_pos: pd.Series, least: pd.Series) -> pd.DataFrame:
    rows = []
    for i, d, n in zip(item_pos, doc_pos, least):
        found = tiles(np.asarray(i, np.int64), np.asarray(d, np.int64), int(n))
        rows.append((len(found), sum(t[2] for t in found), max(t[2] for t in found), min(t[1] for t in found), max(t[1] + t[2] for t in found)))
    return pd.DataFrame(rows, columns=["tiles", "covered", "longest", "doc_start", "doc_end"]).astype("int32")


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = 0.0) -> DataFrame:
    """item_id, doc_id, tiles, longest (tile, in words), coverage (share of the item's words under
    tiles) and the span of the text's words that the tiles lie in, of every pair that shares at
    least ``least`` consecutive words and reaches ``coverage``.

    Words are runs of letters and digits, letter case folded. Null, empty and short texts have no
    runs and give no rows; of repeated ids the rows' windows count together. Seeds that very many
    texts share meet each item's few windows in the join, never one another.
    """
    item_seeds = written(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_seeds(least, None), _SEED))
    bitmap, bits = _bitmap(item_seeds)
    doc_seeds = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_seeds(least, bitmap, bits), _SEED)
    hits = doc_seeds.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "seed", "words").join(
        item_seeds.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "n_words", "seed", "words"), ["seed", "words"])
    pairs = hits.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("item_pos", "doc_pos")).alias("at"))
    tiled = pairs.select("item_id", "doc_id", "n_words", _tile("at.item_pos", "at.doc_pos", F.lit(least)).alias("t"))
    out = tiled.select("item_id", "doc_id", "t.tiles", "t.longest", F.round(F.col("t.covered") / F.col("n_words"), 6).alias("coverage"), "t.doc_start", "t.doc_end")
    return out.where(F.col("longest") >= least).where(F.col("coverage") >= coverage)
