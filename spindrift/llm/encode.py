"""Encoding and decoding of a whole corpus with a byte-level BPE vocabulary.

Texts are read once, in blocks of bounded size. A block gives the list of its distinct words and,
for each text, the positions in that list; both are written to the shared folder. The words of all
blocks are made distinct, each is encoded once, and the ids return to the blocks by a join on the
word; a word meets the join once per block, not once per occurrence. Words that half of all blocks
have are broadcast: there are at most twice as many as a block has words, whatever the corpus. All
others take a shuffle in which none is hot. A block's words and texts then meet by block, where each
text's ids are put together by position.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.lineage import written
from spindrift.operators.skew import hot_keys, lookup

#: Where the vocabulary files are; a parameter of every function that needs one.
FOLDER = os.environ.get("SPINDRIFT_TOKENIZERS", "/opt/tokenizers")
BLOCK_CHARS = 4_000_000
#: Fixed value: the public pattern that splits text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_block = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("at", pa.binary())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block one row with its words, and one for each text with positions in that list."""
    import regex
    from pyspark import TaskContext

    find = regex.compile(PATTERN).findall
    number = TaskContext.get().partitionId() << 32

    def rows_of(docs: list, positions: list, known: dict) -> pa.RecordBatch:
        narrow = np.uint16 if len(known) <= 65536 else np.uint32
        width = np.dtype(narrow).itemsize
        at = [bytes([width]) + np.asarray(p, narrow).tobytes() for p in positions]
        n = len(docs)
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * (n + 1), pa.int64()), pa.array([-1, *range(n)], pa.int32()), pa.array([None, *docs], pa.int64()), pa.array([list(known)] + [None] * n, pa.list_(pa.string())), pa.array([None, *at], pa.binary())],
            schema=_block,
        )

    docs, positions, known, chars = [], [], {}, 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            docs.append(doc)
            positions.append([known.setdefault(w, len(known)) for w in find(text)])
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield rows_of(docs, positions, known)
                docs, positions, known, chars = [], [], {}, 0
                number += 1
    if docs:
        yield rows_of(docs, positions, known)


def _encoder(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(folder, name)
        for batch in batches:
            ids = [bpe._encode_single_piece(w.encode("utf-8", "replace")) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["word", "ids", "n"])

    return run


def _joined(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's texts from the ids of its words."""
    words = words.sort_by("i")
    lists = words["ids"].combine_chunks()
    flat = lists.values.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()
    sizes, starts = np.diff(starts), starts[:-1]
    ids, lengths = [], []
    for at in texts["at"].to_pylist():
        p = np.frombuffer(at, np.uint16 if at[0] == 2 else np.uint32, offset=1)
        n = sizes[p]
        total = int(n.sum())
        lengths.append(total)
        # Where each word's ids begin in the result, less where they begin in the list of all ids.
        shift = np.repeat(starts[p] - (np.cumsum(n) - n), n)
        ids.append(flat[shift + np.arange(total)])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.table({"doc_id": texts["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row's text; an empty list for an empty or null text.

    No special tokens are added, and their strings in a text are ordinary text. Repeated ids keep
    their rows. Lone surrogates cannot occur in a Spark string.
    """
    blocks = written(documents.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_split, "block long, row int, doc_id long, words array<string>, at binary"))
    listed = blocks.where("row = -1").select("block", F.posexplode("words").alias("i", "word"))
    counted = listed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = written(counted.mapInArrow(_encode(folder, vocabulary), "word string, ids array<int>, n long"))
    half = max(2, blocks.where("row = -1").count() / 2)
    frequent, rest = known.where(F.col("n") >= half).select("word", F.col("ids").alias("_ids")), known.where(F.col("n") < half)
    hot = written(hot_keys(rest, "word"))
    flagged = listed.join(F.broadcast(frequent), "word", "left")
    found = flagged.where("_ids is not null").select(F.col("block").alias("of_block"), "i", F.col("_ids").alias("ids"))
    tail = flagged.where("_ids is null").select("block", "i", "word")
    words = found.unionByName(lookup(tail, rest.select("word", "ids"), "word", hot, ["block"]).select(F.col("block").alias("of_block"), "i", "ids"))
    texts = blocks.where("row >= 0").select("block", "doc_id", "at")
    return texts.groupBy("block").cogroup(words.groupBy("of_block")).applyInArrow(_joined, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """id and piece (bytes) of the vocabulary: a table of the vocabulary's fixed size."""
    lines = spark.read.text(os.path.join("file://" + folder, f"{vocabulary}.tiktoken"))
    return lines.select(F.split("value", " ")[1].cast("int").alias("id"), F.unbase64(F.split("value", " ")[0]).alias("piece"))


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """doc_id and text of every row of ``encoded`` by a join with the id-to-piece table.

    Ids outside the vocabulary give nothing; an empty list gives an empty text, a null one null.
    The vocabulary has a fixed size, hence it is broadcast.
    """
    known = pieces(encoded.sparkSession, vocabulary, folder)
    numbered = encoded.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "ids")
    long = numbered.select("_row", "doc_id", F.col("ids").isNull().alias("_null"), F.posexplode_outer("ids").alias("_at", "id"))
    found = long.join(F.broadcast(known), "id", "left")
    text = found.groupBy("_row", "doc_id", "_null").agg(F.array_sort(F.collect_list(F.struct("_at", F.hex("piece").alias("h")))).alias("p"))
    whole = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(x["h"], F.lit(""))), "")), "UTF-8")
    return text.select("doc_id", F.when(~F.col("_null"), whole).alias("text"))
