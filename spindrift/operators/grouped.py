"""Groups of rows as streams: one shuffle and sort, then many groups a batch, a group of any size row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
#: Rows of a batch that is handed on.
ROWS = 10_000


def values(column: pa.Array) -> list:
    """The values of a column as ``to_pylist`` gives them; texts, and numbers without nulls, in one go."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def by_group(df: DataFrame, key: str, order: list[str], run: Callable[[str, Iterator[tuple]], Iterable[tuple]], out: dict[str, str]) -> DataFrame:
    """What ``run`` gives for each ``key`` and its rows in ``order``; it need not read them to their end."""
    at, names, types = itemgetter(df.columns.index(key)), list(out), [_TYPES[t] for t in out.values()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for k, rows in groupby((r for b in batches for r in zip(*map(values, b.columns))), key=at):
            done.extend(run(k, rows))
            if len(done) >= ROWS:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, ", ".join(f"{n} {t}" for n, t in out.items()))
