"""The best representative of each group of duplicate records (skyline selection).

For each key the operator finds, field by field, the record whose value survives:

1. Every record gets a vector of what counts for dominance (completeness, trust and the like) and its
   recency, which ends in a unique number. A record dominates another if it is later and nowhere worse.
2. Each batch of rows, before any shuffle, is peeled into its own dominance layers. A record's layer
   among some of its group is at most its layer in the whole group, so what lies deeper than
   ``LAYERS`` in a batch does so in the group and is left out, but for the best record of each field.
   Layers up to that number stay exact: what dominates a record that is kept is kept as well.
3. The rest of a hot group is peeled once more in parts, then each group as a whole.
4. Each field takes its value from the first layer that has a usable one; within a layer the policy is
   lexicographic: score, then recency. A field that is null in the first layer is so filled from the
   next ones; beyond ``LAYERS`` the policy alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import SPACE, fold, strip
from spindrift.lineage import written
from spindrift.operators.skew import hot_keys

#: Statuses from most to least trusted.
TRUST_ORDER = ["validated", "repaired", "raw", "rejected"]
#: Layers that are told apart.
LAYERS = 4
#: Rows of one group that its last peeling may get; a larger one is peeled in parts first.
MOST = 2000
#: Groups of a batch up to this size are peeled side by side, larger ones each by itself.
_SIDE_BY_SIDE = 48


@dataclass(frozen=True)
class Field:
    """A field of the surviving record. ``score`` is a double, null where the value cannot be used.

    Where ``barred_last`` is set, barred records count for the field only if all records of the
    group are barred.
    """

    name: str
    score: Column
    barred_last: bool = True


def layers_of(group: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """The dominance layer of each row, those beyond ``most`` as ``most`` + 1. ``group`` numbers are in runs,
    and in each run the latest row comes first: a row is dominated by those before it that are nowhere
    worse in ``v``, and its layer is one more than the deepest of these."""
    n = len(group)
    layer = np.ones(n, np.int64)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(start, n))
    place = np.arange(n) - np.repeat(start, size)
    small = np.repeat(size, size) <= _SIDE_BY_SIDE
    for p in range(1, int(size[size <= _SIDE_BY_SIDE].max(initial=0))):
        at = np.flatnonzero(small & (place == p))
        for lag in range(1, p + 1):
            worse = (v[at - lag] >= v[at]).all(1)
            layer[at] = np.maximum(layer[at], np.where(worse, layer[at - lag] + 1, 0))
    for a, m in zip(start[size > _SIDE_BY_SIDE], size[size > _SIDE_BY_SIDE]):
        kept, depth, k = np.empty((64, v.shape[1])), np.empty(64, np.int64), 0
        for i in range(a, a + m):
            over = depth[:k][(kept[:k] >= v[i]).all(1)]
            layer[i] = 1 + over.max(initial=0)
            if layer[i] <= most:
                if k == len(kept):
                    kept, depth = np.concatenate([kept, np.empty_like(kept)]), np.concatenate([depth, np.empty_like(depth)])
                kept[k], depth[k], k = v[i], layer[i], k + 1
    return np.minimum(layer, most + 1)


def _pruned(fields: int, dims: int, most: int):
    """Of each batch (key, id, at, n, barred, scores, dims) the rows that may still decide; ``n`` of the
    rows left out goes to the latest one of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            order = np.lexsort((column(1), column(2), code))[::-1]
            code, n = code[order], column(3)[order]
            s = np.stack([column(5 + i).astype(np.float64)[order] for i in range(fields)], 1)
            v = np.stack([column(5 + fields + i).astype(np.float64)[order] for i in range(dims)], 1)
            keep = layers_of(code, np.nan_to_num(v, nan=-np.inf), most) <= most
            barred = column(4).astype(bool)[order]
            for i in range(fields):
                for side in (barred, ~barred):
                    usable = np.flatnonzero(~np.isnan(s[:, i]) & side)
                    best = usable[np.lexsort((usable, -s[usable, i], code[usable]))]
                    keep[best[np.concatenate([[True], np.diff(code[best]) != 0])] if len(best) else best] = True
            first = np.concatenate([[True], code[1:] != code[:-1]])
            total = np.add.reduceat(n, np.flatnonzero(first))
            n = np.zeros_like(n)
            n[first] = total
            out = batch.take(pa.array(order[keep]))
            yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(n[keep]), *out.columns[4:]], schema=batch.schema)

    return run


def skyline(df: DataFrame, key: str, fields: list[Field], dims: list[Column], barred: Column, recency: Column, ident: str, layers: int = LAYERS, most: int = MOST) -> DataFrame:
    """For each key with two or more records: ``key``, ``n`` and, for each field, ``<name>_from``.

    ``<name>_from`` is the ``ident`` of the record whose value survives, null if none has a usable
    value. ``dims`` are what dominance compares besides recency, larger is better, null is worst. Ties go
    to the latest ``recency`` (a whole number, null is earliest), then to the larger ``ident``. Records
    with a null key belong to no group and are left out; an empty table gives an empty one. Columns
    besides those used may be there under any name; they are ignored.
    """
    names = [f"_s{i}" for i in range(len(fields))] + [f"_v{i}" for i in range(len(dims))]
    scored = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("_key"), F.col(ident).cast("bigint").alias("_id"), F.coalesce(recency.cast("bigint"), F.lit(-(2**63))).alias("_at"),
        F.lit(1).cast("bigint").alias("_n"), F.coalesce(barred, F.lit(False)).alias("_barred"), *[c.cast("double").alias(n) for c, n in zip([f.score for f in fields] + dims, names)])
    shape = ", ".join(f"{n} {t}" for n, t in scored.dtypes)
    prune = _pruned(len(fields), len(dims), layers)
    rows = written(scored.mapInArrow(prune, shape))
    # A hot group's rows are peeled in parts; only what is left of them goes to one place.
    hot = written(hot_keys(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), "_key", most=most))
    flagged = rows.join(F.broadcast(hot), "_key", "left")
    parted = flagged.where("parts is not null").repartition(F.col("_key"), F.pmod(F.xxhash64("_id"), F.col("parts"))).drop("parts").select(scored.columns).mapInArrow(prune, shape)
    rows = flagged.where("parts is null").select(scored.columns).unionByName(parted)
    record = F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"), F.col("_barred").alias("b"), F.array(*names[: len(fields)]).alias("s"), F.array(*[F.coalesce(F.col(n), F.lit(float("-inf"))) for n in names[len(fields) :]]).alias("v"))
    groups = rows.groupBy("_key").agg(F.sum("_n").alias("n"), F.min("_barred").alias("all_barred"), F.collect_list(record).alias("c")).where("n >= 2")
    # From the latest to the earliest: a record's layer is one more than that of the deepest before it
    # that is nowhere worse.
    no_worse = " and ".join(f"d.v[{i}] >= c.v[{i}]" for i in range(len(dims))) or "true"
    kind = "array<struct<at: bigint, id: bigint, b: boolean, s: array<double>, v: array<double>, l: int>>"
    peeled = groups.select("_key", "n", "all_barred", F.expr(
        f"aggregate(reverse(array_sort(c)), cast(array() as {kind}), (acc, c) -> concat(acc, array(struct(c.at as at, c.id as id, c.b as b, c.s as s, c.v as v,"
        f" least({layers + 1}, 1 + coalesce(array_max(transform(filter(acc, d -> {no_worse}), d -> d.l)), 0)) as l))))").alias("layers"))

    def best(i: int, f: Field) -> Column:
        usable = f"c.s[{i}] is not null" + (" and (all_barred or not c.b)" if f.barred_last else "")
        return F.expr(f"array_max(transform(filter(layers, c -> {usable}), c -> struct(-c.l as l, c.s[{i}] as s, c.at as at, c.id as id))).id")

    return peeled.select(F.col("_key").alias(key), "n", *[best(i, f).alias(f"{f.name}_from") for i, f in enumerate(fields)])


def _claim_fields() -> tuple[list[Field], Column, Column]:
    """The fields of a delivery, its trust and whether it is barred."""
    status = fold(strip(F.col("validation_status")))
    trust = F.coalesce(*[F.when(status == s, float(len(TRUST_ORDER) - i)) for i, s in enumerate(TRUST_ORDER)])
    confidence = F.col("confidence").cast("double") + F.lit(0.0)
    filled = F.length(F.regexp_replace(F.col("evidence_text"), f"(?U){SPACE}+", ""))
    fields = [
        Field("confidence", F.when(confidence.between(0.0, 1.0), confidence)),
        Field("evidence", F.when(filled > 0, filled)),
        Field("status", trust, barred_last=False),
    ]
    return fields, trust, F.coalesce(status == "rejected", F.lit(False))


def claim_survivors(triples: DataFrame) -> DataFrame:
    """Deliveries of one extraction (rows that share event_id): event_id, n and the seq that each of
    confidence, evidence and status comes from (null where no row has a usable value).

    Confidence counts between 0 and 1 (not NaN), the highest wins. Evidence counts with at least
    one character that is not white space, the most such characters win. Status counts if it is one
    of ``TRUST_ORDER``, the most trusted wins; rejected records are barred for the other two.

    Dominance compares each field's completeness by its score, the trust, and whether the record may
    count at all: the best value of a field then always lies in the first layer.
    """
    fields, trust, barred = _claim_fields()
    free = F.when(barred, 0.0).otherwise(1.0)
    return skyline(triples, "event_id", fields, [fields[0].score, fields[1].score, trust, free], barred, F.unix_micros("loaded_at"), "seq")


def whole_survivors(triples: DataFrame) -> DataFrame:
    """As ``claim_survivors``, by whole records: dominance compares completeness (the number of usable
    fields), trust and recency, so the values come from the most complete, most trusted and latest
    deliveries, and from the next layers where these have none."""
    fields, trust, barred = _claim_fields()
    complete = sum((F.when(f.score.isNotNull(), 1.0).otherwise(0.0) for f in fields), F.lit(0.0))
    return skyline(triples, "event_id", fields, [complete, trust], barred, F.unix_micros("loaded_at"), "seq")


def surviving_records(triples: DataFrame) -> DataFrame:
    """One record per event_id with two or more rows, each field holding its best value."""
    best = claim_survivors(triples)
    source = triples.select(F.col("seq").alias("_seq"), F.col("event_id").alias("_event"), "confidence", "evidence_text", "validation_status")
    wide = best.select("event_id", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"{f}_from").alias("s")) for f in ("confidence", "evidence", "status")])).alias("x"))
    picked = wide.join(source, (F.col("x.s") == F.col("_seq")) & (F.col("event_id") == F.col("_event")), "left")
    only = lambda f, c: F.max(F.when(F.col("x.f") == f, F.col(c)))
    return picked.groupBy("event_id").agg(
        F.max("n").alias("deliveries"),
        only("confidence", "confidence").alias("confidence"),
        only("evidence", "evidence_text").alias("evidence_text"),
        only("status", "validation_status").alias("validation_status"),
    )
