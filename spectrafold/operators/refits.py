"""Models refitted once per validation sample, and one common order of their components.

The models are a table, made in tasks or, where a refit needs passes over the calibration rows, by batches of samples on the
driver. Their similarities come from pairs of blocks of models, the medoid is the model with the largest sum of them, and every
model is matched to it by an exact assignment where it lies. Only the medoid and the samples of one batch reach the
driver; how the samples are batched changes nothing in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from ..arrays import block
from ..session import Spool, durable
from .stats import cosine_matrix

BATCH = 256       # samples refitted in one set of passes
TASK_ROWS = 256   # samples refitted in one task
MODELS = 4096     # models of a block of similarities at most
LEAST_MODELS = 128
BLOCK_BYTES = 32 << 20
_SIDE = 8         # blocks at least, of that many models, so that there are cells for many tasks
_STEP_CELLS = 1 << 20
_ORDERS = 4       # components up to which the orders of all pairs of a block are tried at once

_FITS = "ix long, profiles array<double>, scores array<double>, facts array<double>"


def assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row of a square matrix such that the sum of the chosen entries is largest.

    Shortest augmenting paths over row and column prices (Kuhn, 1955; Edmonds and Karp, 1972), exact at any size.
    """
    cost = gain.max(initial=0.0) - np.asarray(gain, dtype=float)
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        reached = np.zeros(n, bool)
        distance, came = np.full(n, np.inf), np.full(n, -1)
        row, column, tree = start, -1, [(start, 0.0)]
        length = 0.0
        while True:
            reduced = length + cost[row] - row_price[row] - col_price
            better = ~reached & (reduced < distance)
            distance[better], came[better] = reduced[better], column
            open_ = np.where(reached, np.inf, distance)
            column = int(open_.argmin())
            length = open_[column]
            reached[column] = True
            row = row_of[column]
            if row < 0:
                break
            tree.append((row, length))
        for r, at in tree:
            row_price[r] += length - at
        col_price[reached] -= length - distance[reached]
        while column >= 0:  # turn the path around
            before = came[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def matched_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The mean absolute cosine of the profiles of two models under their best assignment."""
    sim = np.abs(cosine_matrix(a, b))
    return float(sim[np.arange(len(sim)), assignment(sim)].mean())


def block_similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``matched_similarity`` of every model of ``a`` with every model of ``b``."""
    k = a.shape[1]
    sim = np.abs(cosine_matrix(a.reshape(len(a) * k, a.shape[2]), b.reshape(len(b) * k, b.shape[2])))
    sim = sim.reshape(len(a), k, len(b), k).transpose(0, 2, 1, 3)
    if k > _ORDERS:
        return np.array([[float(s[np.arange(k), assignment(s)].mean()) for s in row] for row in sim]).reshape(len(a), len(b))
    sums = [sim[:, :, np.arange(k), list(order)].mean(2) for order in permutations(range(k))]
    return np.max(sums, axis=0)


@dataclass(frozen=True)
class Similarities:
    """``totals``: (ix, total, least, models) of each model's similarities with all models, itself included."""

    totals: DataFrame
    medoid: int
    cells: GroupedData
    components: int

    @property
    def table(self) -> DataFrame:
        """(ix_a, ix_b, similarity) of all pairs, both ways; made anew by each reader."""
        return _cell_pairs(self.cells, self.components)

    def min(self) -> float:
        return self.totals.agg(F.min("least").alias("m")).first()["m"]


def refit_table(val: DataFrame, fit: Callable[[list], list[tuple]], batch: int = BATCH,
                quick: Callable[[np.ndarray], tuple | None] | None = None) -> DataFrame:
    """(ix, profiles, scores, facts) of each row of ``val``.

    ``quick`` refits with one row in its task, or returns None; ``fit`` gets the rows it returned None for, or all, in lists of ``batch``.
    """
    names = ["ix", "profiles", "scores", "facts"]
    done = None
    if quick is not None:
        numbers = pa.list_(pa.float64())

        def run(batches):
            for given in batches:
                if not given.num_rows:
                    continue
                x = block(given.column("x"))
                made = [quick(row) for row in x]
                parts = [pa.array([None if m is None else np.ravel(m[i]).astype(float) for m in made], numbers) for i in range(3)]
                left = pa.array([row if m is None else None for row, m in zip(x, made)], numbers)
                yield pa.RecordBatch.from_arrays([given.column("ix"), *parts, left], names=[*names, "x"])

        tasks = -(-val.count() // TASK_ROWS)
        tried = durable(val.select("ix", "x").repartition(max(1, tasks)).mapInArrow(run, f"{_FITS}, x array<double>"))
        done, val = tried.filter("profiles is not null").select(*names), tried.filter("profiles is null").select("ix", "x")
        if val.isEmpty():
            return done
    spool = Spool(val.sparkSession, _FITS)
    for rows in batches_of(val, batch):
        spool.add([(ix, [float(v) for v in np.ravel(p)], [float(v) for v in s], [float(v) for v in f]) for ix, p, s, f in fit(rows)])
    return spool.frame() if done is None else done.unionByName(spool.frame())


def batches_of(df: DataFrame, size: int = BATCH) -> Iterator[list]:
    """Rows in lists of bounded length."""
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def similarities(fits: DataFrame, components: int, models: int | None = None) -> Similarities:
    """All pairs of models by pairs of blocks; a model goes to as many cells as there are blocks, and cells hand on sums."""
    n = fits.count()
    if not n:
        raise ValueError("there are no refitted models")
    if models is None:
        width = max(1, fits.select(F.size("profiles").alias("n")).first()["n"])
        most = max(16, min(MODELS, BLOCK_BYTES // (8 * width)))
        models = min(most, max(LEAST_MODELS, -(-n // _SIDE)))
    blocks = -(-n // models)
    cut = fits.select("ix", "profiles").withColumn("own", F.pmod(F.xxhash64("ix"), F.lit(blocks)).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select("ix", "profiles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         (F.col("own") > F.col("other")).alias("back")).groupBy("i", "j")

    def add(table: pa.Table) -> pa.Table:
        across, left, right, steps = _cell(table, components)
        total, count, least = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64), np.full(table.num_rows, np.inf)
        for p, sim in steps:
            for at, axis, others in ((p, 1, right), (right, 0, p))[:2 if across else 1]:
                if len(others) and len(at):
                    total[at] += sim.sum(axis=axis)
                    count[at] += len(others)
                    least[at] = np.minimum(least[at], sim.min(axis=axis))
        return pa.table({"ix": table["ix"], "total": total, "least": least, "models": count})

    sums = cells.applyInArrow(add, "ix long, total double, least double, models long")
    totals = durable(sums.groupBy("ix").agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.sum("models").alias("models")))
    return Similarities(totals, totals.orderBy(F.desc(F.round("total", 9)), "ix").first()["ix"], cells, components)


def _cell(table: pa.Table, components: int):
    """Of a pair of blocks: whether they differ, the rows of either, and steps of (left rows, their similarities with all right rows)."""
    back = table["back"].to_numpy(zero_copy_only=False)
    across = table["i"][0].as_py() != table["j"][0].as_py()
    own = block(table["profiles"]).reshape(table.num_rows, components, -1)
    left, right = (np.flatnonzero(~back), np.flatnonzero(back)) if across else (np.arange(len(back)),) * 2
    step = max(1, _STEP_CELLS // max(1, len(right) * components * components))

    def steps():
        for a in range(0, len(left), step):
            part = left[a:a + step]
            yield part, block_similarities(own[part], own[right])

    return across, left, right, steps()


def _cell_pairs(cells: GroupedData, components: int) -> DataFrame:
    schema = pa.schema([("ix_a", pa.int64()), ("ix_b", pa.int64()), ("similarity", pa.float64())])

    def compare(table: pa.Table) -> pa.Table:
        across, _, right, steps = _cell(table, components)
        ix, found = table["ix"].combine_chunks(), [schema.empty_table()]
        for left, sim in steps:
            p, q = (ix.take(pa.array(at)) for at in (np.repeat(left, len(right)), np.tile(right, len(left))))
            for a, b in ((p, q), (q, p))[:2 if across else 1]:  # both ways
                found.append(pa.Table.from_arrays([a, b, pa.array(sim.ravel())], schema=schema))
        return pa.concat_tables(found)

    return cells.applyInArrow(compare, "ix_a long, ix_b long, similarity double")


def aligned(fits: DataFrame, components: int, medoid: int, signed: bool = False) -> DataFrame:
    """(ix, scores, facts, places, signs): scores in the order of the medoid's components.

    ``signed``: a component whose profile runs against the medoid's has its score turned.
    """
    centre = np.asarray(fits.filter(F.col("ix") == medoid).select("profiles").first()["profiles"]).reshape(components, -1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = block(batch.column("profiles")).reshape(batch.num_rows, components, -1)
            scores = block(batch.column("scores"))
            places, signs = np.empty((batch.num_rows, components), np.int32), np.ones((batch.num_rows, components))
            for k, model in enumerate(own):
                sim = cosine_matrix(centre, model)
                places[k] = assignment(np.abs(sim))
                if signed:
                    signs[k] = np.where(sim[np.arange(components), places[k]] < 0, -1.0, 1.0)
            turned = np.take_along_axis(scores, places, axis=1) * signs
            yield pa.RecordBatch.from_arrays(
                [batch.column("ix"), pa.array(list(turned), pa.list_(pa.float64())), batch.column("facts"),
                 pa.array(list(places), pa.list_(pa.int32())), pa.array(list(signs), pa.list_(pa.float64()))], names=["ix", "scores", "facts", "places", "signs"])

    return fits.mapInArrow(run, "ix long, scores array<double>, facts array<double>, places array<int>, signs array<double>")
