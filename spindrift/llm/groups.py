"""One group identifier for every record of chains of pairwise matches (connected components).

The edges lie on a two-dimensional grid: both ends are hashed into blocks, and the edges of a pair
of blocks form one partition, so the edges of a vertex with very many partners spread over a whole
row or column; a partition that is still too large is split. Every one is solved by a local
union-find. Rows and columns then exchange their representatives: a vertex with different representatives in several partitions links them,
and those links, over far fewer vertices, are the edges of the next round. When none are left the
parents are stable, and the rounds' parents are composed from the last to the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import fold, strip
from spindrift.lineage import written
from spindrift.operators.skew import hot_keys

EDGES_PER_CELL = 200_000
#: Fewer edges than this are not worth a cell of their own.
LEAST_PER_CELL = 2_000
#: Sorts after every node identifier, so that an alias is never a group's smallest member.
ALIAS = "\U0010ffff"

#: Aliases that stand for nothing.
NO_ALIAS = ["", "n/a", "unknown", "-"]
#: Wordings of merge messages, tested in this order (taken back, refused, stated).
TAKEN_BACK = r"released|wrongly|undid|undone|split .* off|reverted|separated"
REFUSED = r"not the same|no merge|not merged|kept apart|turned down|rejected|declined|refused"
STATED = r"merged|folded in|<-|alias hit|took over|joined|absorbed|union with|consolidated|unified|combined"


def _solve(cell: pd.DataFrame) -> pd.DataFrame:
    """Each vertex of the cell with the smallest vertex that the cell's edges link it to."""
    names, codes = np.unique(np.concatenate([cell["a"].to_numpy(object), cell["b"].to_numpy(object)]), return_inverse=True)
    u, v = codes[: len(cell)], codes[len(cell) :]
    parent = np.arange(len(names))
    while True:
        x, y = parent[u], parent[v]
        open_ = x != y
        if not open_.any():
            break
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return pd.DataFrame({"v": names, "rep": names[parent]})


def components(edges: DataFrame, a: str = "a", b: str = "b", cell: int = EDGES_PER_CELL) -> DataFrame:
    """``node`` and ``group`` (the group's smallest member, byte order) of all that occur in ``edges``.

    The grid has a cell for each core if there are edges enough, and no cell gets more than about
    ``cell`` edges.

    Ends are strings. Rows with a null end are left out; repeated, reversed and self edges change
    nothing, except that a self edge alone puts its node into a group of its own. An empty table
    gives an empty one.
    """
    left = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    left = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while (n := left.count()) or not rounds:
        side = max(1, int(np.ceil(np.sqrt(max(n / cell, min(cores, n / min(cell, LEAST_PER_CELL)))))))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))  # noqa: B023, E731
        placed = left.withColumn("cell", (block("a") * side + block("b")).cast("int"))
        # The cells of a vertex with very many partners hold more than their share: those are split by edge.
        if n > cell:
            large = written(hot_keys(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", most=cell))
            placed = placed.join(F.broadcast(large), "cell", "left")
        else:
            placed = placed.withColumn("parts", F.lit(None).cast("int"))
        parted = placed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")), F.lit(0).cast("long")))
        solved = parted.select("cell", "part", "a", "b").groupBy("cell", "part").applyInPandas(_solve, "v string, rep string")
        # Representatives of a vertex: at most one per cell of its row and column.
        parents = written(solved.groupBy("v").agg(F.min("rep").alias("up"), F.array_distinct(F.collect_list("rep")).alias("reps")))
        rounds.append(parents.select("v", "up"))
        left = written(
            parents.where("size(reps) > 1").select("up", F.explode("reps").alias("rep")).where("rep <> up")
            .select(F.col("up").alias("a"), F.col("rep").alias("b")).distinct()
        )
    result = rounds.pop()
    while rounds:
        lower = rounds.pop()
        # A vertex of a later round was a representative; others keep their parent.
        top = result.select(F.col("v").alias("_v"), F.col("up").alias("_up"))
        result = lower.join(top, lower["up"] == top["_v"], "left").select("v", F.coalesce("_up", "up").alias("up"))
    return result.select(F.col("v").alias("node"), F.col("up").alias("group"))


def merge_edges(provenance: DataFrame) -> DataFrame:
    """a, b of the merges that a node's merge_history states and no later message takes back.

    A message that names one node besides the record's own is about these two; one that names the
    record's own and others is about the own and each other; one that names only others is about
    the first and each of the rest. Null or empty lists and messages of other kinds give no rows.
    """
    says = provenance.where("element_type = 'node' and element_id is not null").select(
        "element_id", F.xxhash64("merge_history").alias("h"), F.posexplode("merge_history").alias("pos", "m"))
    ids = F.expr(r"""array_distinct(transform(regexp_extract_all(m, '([a-z_]+:[^\\s",;()]+)', 1), x -> rtrim(':', x)))""")
    kind = F.when(F.col("m").rlike(TAKEN_BACK), -1).when(F.col("m").rlike(REFUSED), 0).when(F.col("m").rlike(STATED), 1).otherwise(0)
    about = says.select("element_id", "h", "pos", kind.alias("kind"), ids.alias("ids")).where("kind <> 0 and size(ids) > 0")
    own = F.expr("if(size(ids) = 1 or array_contains(ids, element_id), element_id, ids[0])")
    pairs = about.select("element_id", "h", "pos", "kind", own.alias("x"), F.explode("ids").alias("y")).where("x <> y")
    last = pairs.groupBy("element_id", "h", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max_by("kind", "pos").alias("kind"))
    return last.where("kind = 1").select("a", "b")


def alias_edges(entities: DataFrame) -> DataFrame:
    """a, b: each node with a vertex for each of its aliases within its type.

    Nodes that share an alias are so linked through it, with one edge a node and no pairs.
    """
    alias = entities.where("node_id is not null and entity_type is not null").select("node_id", "entity_type", F.explode("aliases").alias("alias"))
    alias = alias.select("node_id", "entity_type", fold(strip(F.col("alias"))).alias("alias")).where(F.col("alias").isNotNull() & ~F.col("alias").isin(NO_ALIAS))
    return alias.select(F.col("node_id").alias("a"), F.concat(F.lit(ALIAS), F.hex(F.unhex(F.md5(F.concat_ws("\x01", "entity_type", "alias"))))).alias("b"))


def node_groups(entities: DataFrame, pairs: DataFrame, provenance: DataFrame, cell: int = EDGES_PER_CELL) -> DataFrame:
    """node_id and group_node_id of every node of ``entities`` and of every other node that is matched.

    Match pairs lacking a side are left out; a node without matches is its own group.
    """
    lone = entities.where("node_id is not null").select(F.col("node_id").alias("a"), F.col("node_id").alias("b"))
    edges = lone.unionByName(pairs.select(F.col("node_id_1").alias("a"), F.col("node_id_2").alias("b")))
    edges = edges.unionByName(merge_edges(provenance)).unionByName(alias_edges(entities))
    return components(edges, cell=cell).where(~F.col("node").startswith(ALIAS)).select(F.col("node").alias("node_id"), F.col("group").alias("group_node_id"))
