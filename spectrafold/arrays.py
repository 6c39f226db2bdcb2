"""Bridges between Arrow batches and NumPy blocks.

``x`` columns hold equally long arrays, so a batch is one contiguous (rows × variables)
block: it is viewed, not copied element by element, and leaves the task the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def block(column) -> np.ndarray:
    """A list column as a float matrix; rows must have one common length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0))
    values = column.flatten()
    matrix = np.asarray(values.to_numpy(zero_copy_only=False), dtype=float)
    if len(matrix) % rows:
        raise ValueError("array column holds rows of different lengths")
    return matrix.reshape(rows, -1)


def vector(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list column, one list per row."""
    matrix = np.ascontiguousarray(matrix, dtype=float)
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def column_of(value) -> pa.Array:
    if isinstance(value, (pa.Array, pa.ChunkedArray)):
        return value
    value = np.asarray(value)
    return lists(value) if value.ndim == 2 else pa.array(value)


def map_blocks(df: DataFrame, fn: Callable[[dict], dict], fields: list[tuple[str, str]],
               inputs: list[str], keep: list[str]) -> DataFrame:
    """Row-local step on Arrow batches.

    ``fn`` receives the ``inputs`` of a batch as NumPy blocks (2-D for arrays, 1-D for
    scalars) and returns the new columns named in ``fields``; ``keep`` columns pass through
    untouched. Only the needed columns enter Python.
    """
    needed = list(dict.fromkeys(keep + inputs))
    source = df.select(*needed)
    types = {f.name: f.dataType for f in source.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in keep]
                          + [T.StructField(n, T.DataType.fromDDL(t) if isinstance(t, str) else t)
                             for n, t in fields])
    is_array = {c: isinstance(types[c], T.ArrayType) for c in inputs}
    names = keep + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            given = {c: (block(batch.column(c)) if is_array[c] else vector(batch.column(c)))
                     for c in inputs}
            made = fn(given)
            out = [batch.column(c) for c in keep] + [column_of(made[n]) for n, _ in fields]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(run, schema)


SALTS = 64  # partial vectors per sum that reach the driver


def few_tasks(df: DataFrame) -> bool:
    """Whether a (persisted) frame has so few partitions that its partials need no merge."""
    return df.rdd.getNumPartitions() <= SALTS


def sum_blocks(df: DataFrame, inputs: list[str], fn: Callable[[dict], np.ndarray],
               few: bool = False, lowest: bool = False, minima: int = 0) -> np.ndarray | None:
    """Σ (or the minimum) over all rows of ``fn(block)``, a vector of fixed length.

    With ``minima`` the first numbers, as many as it says, are minima and the others sums.

    One partial vector per task, a salted merge that streams, and at most 64 vectors to the
    driver: the cost there does not grow with the rows. ``few`` skips the merge when the caller
    knows that there are no more tasks than that.
    """
    source = df.select(*inputs)
    is_array = {f.name: isinstance(f.dataType, T.ArrayType) for f in source.schema.fields}
    merge = np.minimum if lowest else np.add

    def both(vectors):
        return np.concatenate([vectors[:, :minima].min(axis=0), vectors[:, minima:].sum(axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            given = {c: (block(batch.column(c)) if is_array[c] else vector(batch.column(c))) for c in inputs}
            part = fn(given)
            held = part if held is None else both(np.stack([held, part])) if minima else merge(held, part)
        if held is not None:
            context = TaskContext.get()
            salt = (context.partitionId() if context else 0) % SALTS
            yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), lists(held[None, :])], names=["salt", "v"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = block(batch.column("v"))
            held = both(part if held is None else np.vstack([held, part]))[None, :]
        if held is not None:
            yield pa.RecordBatch.from_arrays([lists(held)], names=["v"])

    parts = source.mapInArrow(run, "salt int, v array<double>")
    if not few:
        parts = parts.groupBy("salt").applyInArrow(
            fold if minima else _least_vectors if lowest else _add_vectors, "v array<double>")
    table = parts.select("v").toArrow()
    if not table.num_rows:
        return None
    found = block(table["v"])
    return both(found) if minima else merge.reduce(found, axis=0)


def _add_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _fold_vectors(batches, np.add)


def _least_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _fold_vectors(batches, np.minimum)


def _fold_vectors(batches, merge):
    held = None
    for batch in batches:
        part = merge.reduce(block(batch.column("v")), axis=0)
        held = part if held is None else merge(held, part)
    if held is not None:
        yield pa.RecordBatch.from_arrays([lists(held[None, :])], names=["v"])
