"""Nearest examples and vectors of a stated set of queries, by inverted lists and blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: what counts as a word of an example.
WORD = r"[A-Za-z0-9][A-Za-z0-9_.:\-]*"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower))


def few_shot(queries: DataFrame, examples: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` examples (id, text) of highest score for each query (id, text), ties to the smaller id:
    0.7 times the Jaccard of the texts, 0.25 times that of the query and the example's ``output`` if
    there is this column, plus 25 by the example's length. Examples without a common word do not
    count, nor those whose ``doc`` is the query's ``doc``, if both have this column.

    Pairs come from an equi-join on words: the number of common words is its count.
    """
    no = F.lit(None).cast("string")
    own = "doc" in queries.columns and "doc" in examples.columns
    doc = F.col("doc").cast("string") if own else no
    output = word_set(F.coalesce(F.col("output"), F.lit(""))) if "output" in examples.columns else F.array().cast("array<string>")
    q = queries.select(F.col("id").alias("q"), doc.alias("q_doc"), word_set(F.col("text")).alias("ws")).select("q", "q_doc", F.size("ws").alias("qn"), F.explode("ws").alias("w"))
    e = examples.select(F.col("id").alias("e"), doc.alias("e_doc"), F.greatest(F.length("text"), F.lit(1)).alias("len"), word_set(F.coalesce("text", F.lit(""))).alias("ws"), output.alias("os"))
    e = e.select("e", "e_doc", "len", F.size("ws").alias("en"), F.size("os").alias("on"), "ws", "os", F.explode(F.array_union("ws", "os")).alias("w"))
    e = e.withColumns({"in_t": F.array_contains("ws", F.col("w")).cast("int"), "in_o": F.array_contains("os", F.col("w")).cast("int")}).drop("ws", "os")
    common = q.join(e, "w").where("q_doc is null or e_doc is null or q_doc <> e_doc").groupBy("q", "e", "qn", "en", "on", "len").agg(F.sum("in_t").alias("c"), F.sum("in_o").alias("oc"))
    part = lambda c, n: F.col(c) / (F.col("qn") + F.col(n) - F.col(c))
    scored = common.select("q", "e", F.round(0.7 * part("c", "en") + 0.25 * part("oc", "on") + F.lit(25.0) / F.col("len"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "e"))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors in double precision, 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


BLOCK = 4096


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """ids and unit-length matrix (bytes) of blocks of about ``size`` vectors."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        m = np.stack(g["v"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return pd.DataFrame({"ids": [g["id"].to_numpy()], "m": [m.tobytes()]})

    n = max(1, -(-vectors.count() // size))
    block = F.pmod(F.xxhash64("id"), F.lit(n))
    return vectors.select("id", "v").where("id is not null and v is not null").groupBy(block).applyInPandas(pack, "ids array<long>, m binary")


def _products(k: int):
    """The best ``k`` of a block of vectors for each of a block of queries."""

    def product(batches):
        for batch in batches:
            for qi, qm, ei, em in zip(batch["qi"], batch["qm"], batch["ei"], batch["em"]):
                qi, ei = np.asarray(qi), np.asarray(ei)
                s = np.frombuffer(qm).reshape(len(qi), -1) @ np.frombuffer(em).reshape(len(ei), -1).T
                s = np.round(s, 6)  # ties, in the order of ids, are those of the rounded cosines
                s[qi[:, None] == ei[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"q": np.repeat(qi, top.shape[1]), "e": ei[top].ravel(), "cosine": np.take_along_axis(s, top, 1).ravel()})

    return product


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, size: int = BLOCK) -> DataFrame:
    """The ``k`` vectors (id, v) of highest cosine to each query (id, v) besides itself, exact.

    A stated query set against all rows, in blocks: every block of queries meets every block of
    vectors in one matrix product, which gives its own best ``k``; only those are shuffled. Null
    vectors are left out.
    """

    asked = _blocks(queries, size).toDF("qi", "qm")
    pairs = asked.crossJoin(_blocks(vectors, size).toDF("ei", "em"))
    found = pairs.mapInPandas(_products(k), "q long, e long, cosine double").where("cosine > -2").withColumn("cosine", F.round("cosine", 6))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "e"))).where(F.col("rank") <= k)


#: Rows on which an index is fitted at most, vectors of one cell, and the share of cells that a query visits.
FIT, PER_CELL, VISITED = 20_000, 2_000, 0.7


def _centres(vectors: DataFrame, n: int, fit: int) -> np.ndarray:
    """Centres of ``n`` cells by k-means on at most ``fit`` vectors, those of smallest hash."""
    got = vectors.where("id is not null and v is not null").select("v").orderBy(F.xxhash64("id"), "id").limit(fit).toPandas()
    m = np.stack(got["v"].to_numpy()).astype(np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    centres = m[np.random.default_rng(7).choice(len(m), min(n, len(m)), replace=False)]
    for _ in range(10):
        of = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def indexed_nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int | None = None, visited: float = VISITED, fit: int = FIT, size: int = BLOCK) -> DataFrame:
    """As ``nearest``, by an index over all rows: every vector lies in the cell of its nearest centre, and
    a query visits the ``visited`` share of cells whose centres are nearest. The centres are fitted on
    a bounded sample (``fit`` rows); their number grows with the rows up to 4096. Not exact: see
    ``nearest``, which is, for its recall.
    """
    rows = vectors.where("id is not null and v is not null").select("id", "v")
    n = cells or int(min(4096, 1 + rows.count() // PER_CELL))
    if not rows.limit(1).count():
        return nearest(vectors, queries, k, size)
    centres = _centres(rows, n, fit)
    most = max(1, int(np.ceil(len(centres) * visited)))

    def placed(few: int):
        def run(batches):
            for batch in batches:
                m = np.stack(batch["v"].to_numpy()).astype(np.float64) if len(batch) else np.empty((0, centres.shape[1]))
                near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :few]
                yield pd.DataFrame({"cell": near.ravel(), "id": np.repeat(batch["id"].to_numpy(), near.shape[1]), "v": np.repeat(batch["v"].to_numpy(), near.shape[1])})

        return run

    def packed(df: DataFrame, few: int, a: str, b: str) -> DataFrame:
        def pack(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("id")
            m = np.stack(g["v"].to_numpy()).astype(np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            return pd.DataFrame({"cell": [g["cell"].iloc[0]], a: [g["id"].to_numpy()], b: [m.tobytes()]})

        each = df.mapInPandas(placed(few), f"cell long, id long, v {dict(df.dtypes)['v']}")
        # A cell may hold far more than its share: blocks of it stay bounded.
        sizes = F.broadcast(each.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")))
        return each.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts"))).applyInPandas(lambda g: pack(g), f"cell long, {a} array<long>, {b} binary")

    pairs = packed(queries.where("id is not null and v is not null").select("id", "v"), most, "qi", "qm").join(packed(rows, 1, "ei", "em"), "cell").select("qi", "qm", "ei", "em")
    found = pairs.mapInPandas(_products(k), "q long, e long, cosine double").where("cosine > -2")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "e"))).where(F.col("rank") <= k)


def led(g: pd.DataFrame, least: float) -> pd.DataFrame:
    """id, leader of one group (id, v)."""
    g = g.sort_values("id")
    m = np.stack(g["v"].to_numpy()).astype(np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ids = g["id"].to_numpy()
    leader = np.full(len(ids), -1)
    for i in range(len(ids)):
        if leader[i] < 0:
            take = (leader < 0) & (m @ m[i] >= least)
            take[:i] = False
            take[i] = True
            leader[take] = i
    return pd.DataFrame({"id": ids, "leader": ids[leader]})


def leaders(vectors: DataFrame, group: str, least: float) -> DataFrame:
    """id, leader: in the order of ids each vector that no leader takes becomes one and takes all
    later free ones of its group with a cosine of ``least`` to it. Not transitive, so in order; a
    group is what one document or type holds."""
    return vectors.groupBy(group).applyInPandas(lambda g: led(g, least), "id long, leader long")
