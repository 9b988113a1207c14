"""Deeply nested records as flat tables that keep the links between parent and child.

Every object is canonicalised and hashed bottom-up (a Merkle identity: an object's hash covers the
hashes of all that it holds), so equal objects have equal hashes wherever they stand. Three tables
come out: ``objects`` holds each distinct object once, ``bridge`` holds every occurrence (record,
path, parent's hash, key and position, child's hash), and views such as ``listed`` select from them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.lineage import written
from spindrift.operators.skew import hot_keys, lookup

BRIDGE = "rec_id long, path string, parent_path string, list_name string, ordinal int, parent_hash string, object_hash string, body string"

#: The lists that become tables of their own.
LISTS = ("external_references", "kill_chain_phases")


def unwrapped(value: object) -> object:
    """``value``, or what JSON text holds, however often it is wrapped; text of a mere scalar stays."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        if not isinstance(inner, dict | list | str):
            return value
        if isinstance(inner, str) and not isinstance(unwrapped(inner), dict | list):
            return value
        value = inner
    return value


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def occurrences(rec_id: object, column: str, root: object, lists: tuple[str, ...] = LISTS, unwrap: bool = True, whole: bool = False) -> list[tuple]:
    """The bridge rows of one value: one for each object in it, at any depth; with ``whole`` one for
    each list and for a mere scalar at the root as well, so that the value can be rebuilt.

    An explicit stack, no recursion: depth is bounded by the parser alone. Under a key of ``lists``
    a single object counts as a list of one. ``unwrap`` reads JSON text as the value it holds.
    """
    read = unwrapped if unwrap else (lambda v: v)
    # path, index of the parent, key it stands under, position in a list, value
    order: list[tuple] = []
    stack: list[tuple] = [(column, -1, column, None, read(root))]
    while stack:
        path, parent, key, ordinal, value = stack.pop()
        if ordinal is None and key in lists and isinstance(value, dict):
            value = [value]
        me = len(order)
        order.append((path, parent, key, ordinal, value))
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}", me, str(k), None, read(v)) for k, v in value.items())
        elif isinstance(value, list):
            name = key if ordinal is None else ""  # a list inside a list lends no name to its members
            stack.extend((f"{path}[{i}]", me, name, i, read(v)) for i, v in enumerate(value))
    # Children stand after their parents, hence hashes come bottom-up from the end.
    held: list[list] = [[] for _ in order]
    digest, body = [""] * len(order), [""] * len(order)
    for me in range(len(order) - 1, -1, -1):
        _, parent, key, ordinal, value = order[me]
        if isinstance(value, dict):
            body[me] = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{h}" for k, h in sorted(held[me])) + "}"
            digest[me] = _digest(body[me])
        elif isinstance(value, list):
            body[me] = "[" + ",".join(h for _, h in sorted(held[me])) + "]"
            digest[me] = _digest(body[me])
        else:
            digest[me] = json.dumps(value, ensure_ascii=False, default=str)
        if parent >= 0:
            held[parent].append((ordinal if isinstance(order[parent][4], list) else key, digest[me]))
    rows = []
    for me, (path, parent, key, ordinal, value) in enumerate(order):
        if whole and not body[me] and parent < 0:
            rows.append((rec_id, path, None, key, ordinal, None, _digest(digest[me]), digest[me]))
        if isinstance(value, dict) or whole and body[me]:
            while parent >= 0 and isinstance(order[parent][4], list):  # the parent is the object that holds the list
                parent = order[parent][1]
            up = (order[parent][0], digest[parent]) if parent >= 0 else (None, None)
            rows.append((rec_id, path, up[0], key, ordinal, up[1], digest[me], body[me]))
    return rows


def _bridge(key: str, columns: tuple[str, ...], text: tuple[str, ...], lists: tuple[str, ...], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rec_id", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("list_name", pa.string()), ("ordinal", pa.int32()), ("parent_hash", pa.string()), ("object_hash", pa.string()), ("body", pa.string())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, column in enumerate(columns):
                for rec_id, value in zip(ids, batch.column(i + 1).to_pylist()):
                    if value is not None:
                        rows.extend(occurrences(rec_id, column, value, lists, column in text, whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def bridge(records: DataFrame, key: str = "rec_id", columns: tuple[str, ...] = (*LISTS, "contents"), text: tuple[str, ...] = ("contents",), lists: tuple[str, ...] = LISTS, whole: bool = False) -> DataFrame:
    """One row for each occurrence of an object (``whole``: or list, or scalar at the root) in ``columns``; ``text`` are those that hold JSON text.

    ``list_name`` is the key that the object, or the list it is a member of, stands under, empty
    for members of a list that is itself a member of a list; ``ordinal`` is its position in its
    list, null outside one. Nulls and text that is not complete JSON give no rows, nor do scalars.
    ``body`` is the object's canonical form, in which each object or list below stands as its hash.
    """
    return records.select(F.col(key).cast("long"), *columns).mapInArrow(_bridge(key, columns, text, lists, whole), BRIDGE)


def objects(occurring: DataFrame) -> DataFrame:
    """Each distinct object once: object_hash, body and the number of its occurrences.

    Partial counts come before the shuffle, so an object that a third of all rows hold is no burden.
    """
    return occurring.groupBy("object_hash").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("occurrences"))


def listed(occurring: DataFrame, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """The occurrences that are members of one of ``lists``."""
    return occurring.where(F.col("list_name").isin(*lists) & F.col("ordinal").isNotNull())


def members(body: str) -> dict | list | object:
    """What ``body`` holds, one level deep; an object or list below it is the bytes of its hash."""
    at = 1

    def scalar() -> object:
        nonlocal at
        if (m := _HASH.match(body, at)) is not None:
            at = m.end()
            return m.group().encode()
        value, at = _JSON.raw_decode(body, at)
        return value

    if body[:1] not in ("{", "["):
        return json.loads(body)
    held: dict | list = {} if body[0] == "{" else []
    while body[at] not in "]}":
        if isinstance(held, dict):
            name, at = _JSON.raw_decode(body, at)
            at += 1
            held[name] = scalar()
        else:
            held.append(scalar())
        at += body[at] == ","
    return held


_HASH, _JSON = re.compile(r"[0-9a-f]{32}(?=[,}\]])"), json.JSONDecoder()


def rebuilt(object_hash: str, bodies: dict[str, str]) -> object:
    """The value of ``object_hash``, from the bodies by hash; those of ``whole`` bridges are complete."""
    part = lambda v: rebuilt(v.decode(), bodies) if isinstance(v, bytes) else v
    held = members(bodies[object_hash])
    return {k: part(v) for k, v in held.items()} if isinstance(held, dict) else [part(v) for v in held] if isinstance(held, list) else held


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _texts(body: pd.Series) -> pd.Series:
    text = lambda v: v if v is None or isinstance(v, str) else v.decode() if isinstance(v, bytes) else json.dumps(v, ensure_ascii=False)
    return body.map(lambda b: {k: text(v) for k, v in members(b).items()})


def flat(occurring: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
    """The members of the lists called ``name``, at any depth: their place and parent, and the values
    of ``fields`` as text (the hash of what is itself an object or a list, null where there is none).

    Each distinct object is read once; the occurrences of a hot one meet it in parts.
    """
    rows = written(listed(occurring, (name,)))
    each = objects(rows)
    hot = written(hot_keys(each, "object_hash", "occurrences"))
    values = written(each.select("object_hash", _texts("body").alias("v")).select("object_hash", *[F.try_element_at("v", F.lit(f)).alias(f) for f in fields]))
    return lookup(rows.select("rec_id", "path", "parent_path", "parent_hash", "ordinal", "object_hash"), values, "object_hash", hot, ["rec_id", "path"])
