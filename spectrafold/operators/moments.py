"""Additive second moments: one scan that feeds every linear and bilinear model.

``n``, the mean vector and the centred cross-product matrix of the stacked (x, y) variables,
per key. Parts merge and subtract exactly (pairwise update of Chan, Golub and LeVeque), so the
training moments of a fold are total minus fold and no fold is scanned twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import block, lists, vector

MAX_WIDTH = 3000          # p² doubles per partial: 72 MB
_SCALAR_WIDTH = 8         # up to here the cross products are plain SQL aggregates
_COLLECT_WIDTH = 256
_HELD_BYTES = 256 << 20   # partials a task holds before it hands them on
_SCHEMA = "key string, salt int, n double, mean array<double>, m2 array<double>"


@dataclass(frozen=True)
class Moments:
    n: float
    mean: np.ndarray
    m2: np.ndarray
    p: int  # the first p variables are x, the rest y

    def __add__(self, other: "Moments") -> "Moments":
        if self.n == 0:
            return other
        if other.n == 0:
            return self
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n),
                       self.m2 + other.m2 + np.outer(step, step) * (self.n * other.n / n), self.p)

    def __sub__(self, part: "Moments") -> "Moments":
        """What remains of the total after taking ``part`` out."""
        n = self.n - part.n
        if part.n == 0 or n <= 0:
            return self if part.n == 0 else Moments(0.0, self.mean * 0, self.m2 * 0, self.p)
        mean = (self.n * self.mean - part.n * part.mean) / n
        step = part.mean - mean
        return Moments(n, mean, self.m2 - part.m2 - np.outer(step, step) * (n * part.n / self.n),
                       self.p)

    @property
    def x_mean(self):
        return self.mean[:self.p]

    @property
    def y_mean(self):
        return self.mean[self.p:]

    @property
    def xx(self):
        return self.m2[:self.p, :self.p]

    @property
    def xy(self):
        return self.m2[:self.p, self.p:]

    @property
    def yy(self):
        return self.m2[self.p:, self.p:]

    def covariance(self, ddof: int = 1):
        return self.xx / (self.n - ddof)

    def std(self, ddof: int = 0):
        return np.sqrt(np.maximum(np.diag(self.xx), 0) / (self.n - ddof))


def total(parts) -> Moments:
    return reduce(lambda a, b: a + b, parts)


def _of_block(z: np.ndarray, w: np.ndarray | None, p: int) -> Moments:
    if w is None:
        n = float(len(z))
        mean = z.mean(axis=0)
        c = z - mean
        return Moments(n, mean, c.T @ c, p)
    n = float(w.sum())
    if n == 0:
        return Moments(0.0, np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2), p)
    mean = (w @ z) / n
    c = z - mean
    return Moments(n, mean, c.T @ (c * w[:, None]), p)


def _emit(held: dict) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([_salt()] * len(keys), pa.int32()),
         pa.array([held[k].n for k in keys], pa.float64()),
         lists(np.stack([held[k].mean for k in keys])),
         lists(np.stack([held[k].m2.reshape(-1) for k in keys]))],
        names=["key", "salt", "n", "mean", "m2"])


def _salt() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) % 64


def partial_moments(df: DataFrame, x: str, y: str | None, key, weight=None) -> DataFrame:
    """One partial per (task, key); rows with a NULL key do not count."""
    columns = [key.cast("string").alias("_k") if key is not None else F.lit("").alias("_k"),
               F.col(x).alias("_x")]
    if y:
        columns.append(F.col(y).alias("_y"))
    if weight is not None:
        columns.append(weight.cast("double").alias("_w"))
    source = df.select(*columns).filter("_k is not null")
    has_y, has_w = y is not None, weight is not None

    def run(batches):
        held: dict[str, Moments] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = block(batch.column("_x"))
            p = z.shape[1]
            if p > MAX_WIDTH:
                raise ValueError(f"moments of {p} variables exceed the limit of {MAX_WIDTH}")
            if has_y:
                z = np.hstack([z, block(batch.column("_y"))])
            w = vector(batch.column("_w")) if has_w else None
            codes = batch.column("_k").dictionary_encode()
            inverse = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                rows = inverse == code
                part = _of_block(z[rows], None if w is None else w[rows], p)
                held[name] = held[name] + part if name in held else part
            if len(held) * z.shape[1] ** 2 * 8 > _HELD_BYTES:
                yield _emit(held)
                held = {}
        if held:
            yield _emit(held)

    return source.mapInArrow(run, _SCHEMA)


def _merge_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the partials of one (key, salt); holds one matrix."""
    held = name = None
    for batch in batches:
        mean, m2, n = block(batch.column("mean")), block(batch.column("m2")), vector(batch.column("n"))
        for i in range(batch.num_rows):
            name = batch.column("key")[i].as_py()
            part = Moments(n[i], mean[i], m2[i].reshape(len(mean[i]), -1), 0)
            held = part if held is None else held + part
    if held is not None:
        yield _emit({name: held})


def merge_moments(partials: DataFrame) -> DataFrame:
    return partials.groupBy("key", "salt").applyInArrow(_merge_group, _SCHEMA)


def moments(df: DataFrame, x="x", y=None, key=None, weight=None, width: int | None = None
            ) -> dict[str, Moments]:
    """Moments per key (key '' when none is given), on the driver as p² numbers each.

    ``x`` and ``y`` name array columns, or are lists of scalar columns. Few scalar columns are
    aggregated in SQL with map-side combine; arrays go through one Arrow pass, a salted merge,
    and at most 64 partials per key reach the driver. ``width`` spares a look at one row.
    """
    key = F.col(key) if isinstance(key, str) else key
    weight = F.col(weight) if isinstance(weight, str) else weight
    if not isinstance(x, str):
        xs, ys = list(x), list(y or [])
        if len(xs) + len(ys) <= _SCALAR_WIDTH and weight is None:
            return _scalar_moments(df, xs, ys, key)
        df = df.withColumn("_xa", F.array(*[F.col(c).cast("double") for c in xs]))
        if ys:
            df = df.withColumn("_ya", F.array(*[F.col(c).cast("double") for c in ys]))
        x, y, width = "_xa", ("_ya" if ys else None), len(xs)
    if width is None:
        first = df.select(F.size(x).alias("p")).first()
        width = first["p"] if first else 0
    partials = partial_moments(df, x, y, key, weight)
    out: dict[str, Moments] = {}
    merged = merge_moments(partials)
    # wide matrices come one by one, narrow ones at once
    for r in merged.collect() if width <= _COLLECT_WIDTH else merged.toLocalIterator():
        mean = np.asarray(r["mean"])
        part = Moments(r["n"], mean, np.asarray(r["m2"]).reshape(len(mean), -1), width)
        out[r["key"]] = out[r["key"]] + part if r["key"] in out else part
    return out


def _scalar_moments(df, xs, ys, key) -> dict[str, Moments]:
    names = xs + ys
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    value = [F.col(c).cast("double") for c in names]
    rows = (df.groupBy((key.cast("string") if key is not None else F.lit("")).alias("_k"))
            .agg(F.count("*").alias("n"),
                 *[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)],
                 *[F.covar_pop(value[i], value[j]).alias(f"c{i}_{j}") for i, j in pairs])
            .filter("_k is not null").collect())
    out = {}
    for r in rows:
        m2 = np.zeros((len(names),) * 2)
        for i, j in pairs:
            m2[i, j] = m2[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[r["_k"]] = Moments(float(r["n"]), np.array([r[f"m{i}"] for i in range(len(names))]),
                               m2, len(xs))
    return out
