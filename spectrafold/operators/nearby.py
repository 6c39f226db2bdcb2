"""Calibration rows as sums that hold for every model near a centre.

The least-squares scores of a row are linear in it, and with non-negative scores they stay so while the same places are
positive. Models that were refitted with one more sample differ little from the one without it. So rows whose positive places
are the same within some reach of that centre are summed once for all models, as moments per set of places. The few rows on the
verge of another set are kept as rows. A refit is then a task's own work, without a pass over the calibration rows; one that
strays beyond the reach, or whose error is lost in the rounding of sums, tells so and needs the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrays import block, few_tasks, lists, sum_blocks

NEAR_ROWS = 512        # rows kept as rows at most
MOST_CELLS = 1 << 20   # numbers in the moments of one round
ALL_CELLS = 1 << 23    # and of all rounds
LEAST_ERROR = 1e-9     # of the squares; a smaller error is measured by differences
_GAP = 1e-12           # between kept and summed rows, beyond what rounding can bridge


def places(components: int, signed: bool) -> np.ndarray:
    """The sets of places that can be positive; one of all places where signs are free."""
    if not signed:
        return np.ones((1, components), bool)
    return (np.arange(1 << components)[:, None] >> np.arange(components) & 1).astype(bool)


def maps(s: np.ndarray, sets: np.ndarray, signed: bool) -> np.ndarray:
    """(sets, components, columns): what a row is multiplied with for its scores at the places of a set, and for their gradients elsewhere."""
    gram = s @ s.T
    if not signed:
        return (np.linalg.pinv(gram, hermitian=True) @ s)[None]
    k = len(s)
    gram = gram + 1e-14 * max(np.trace(gram) / max(k, 1), 1e-300) * np.eye(k)
    system = np.where(sets[:, :, None] & sets[:, None, :], gram, np.eye(k))
    x = np.linalg.solve(system, np.where(sets[:, :, None], s, 0.0))
    return np.where(sets[:, :, None], x, gram @ x - s)


def _margins(rows: np.ndarray, held: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each row, and how much the maps may turn before it is another one; without bound for a row of zeros."""
    size = np.linalg.norm(rows, axis=1)
    value = (rows @ held.reshape(-1, rows.shape[1]).T).reshape(len(rows), *lengths.shape) / lengths
    least = value.min(axis=2)
    own = least.argmax(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        margin = least[np.arange(len(rows)), own] / size
    return own, np.where(size > 0, np.where(np.isnan(margin), -np.inf, margin), np.inf)


@dataclass(frozen=True)
class Nearby:
    sets: np.ndarray
    signed: bool
    held: np.ndarray      # maps of the centre
    lengths: np.ndarray   # of these
    squares: np.ndarray   # Σ d dᵀ per set
    sums: np.ndarray      # Σ d per set
    rows: np.ndarray      # those kept
    reach: float
    total: float          # Σ d² of the summed rows
    cells: float
    used: np.ndarray      # sets that have rows

    def statistics(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
        """CᵀC, CᵀD, ΣC and residual squares of the summed rows for the model ``s``; None beyond the reach."""
        try:
            own = maps(s, self.sets, self.signed)
        except np.linalg.LinAlgError:
            return None
        if self.signed:
            away = (np.linalg.norm(own - self.held, axis=2) / self.lengths)[self.used].max(initial=0.0)
            if not away + _GAP < self.reach:
                return None
        w = np.where(self.sets[:, :, None], own, 0.0)[self.used]
        crossed = w @ self.squares[self.used]
        cc = (crossed @ w.transpose(0, 2, 1)).sum(axis=0)
        cd = crossed.sum(axis=0)
        sums = np.einsum("pkc,pc->k", w, self.sums[self.used])
        return cc, cd, sums, float(self.total - 2 * (cd * s).sum() + ((cc @ s) * s).sum())


def around(df: DataFrame, unfold: Callable[[np.ndarray], np.ndarray], s: np.ndarray, signed: bool) -> Nearby | None:
    """The rows of ``df`` (its ``x``, as ``unfold`` lays them out) around the model ``s``; None where this can't be had."""
    k, p = s.shape
    if signed and k > 20 or (1 << k if signed else 1) * p * p > MOST_CELLS:
        return None
    sets = places(k, signed)
    try:
        held = maps(s, sets, signed)
    except np.linalg.LinAlgError:
        return None
    lengths = np.linalg.norm(held, axis=2)
    lengths = np.where(lengths > 0, lengths, 1.0)
    if not np.isfinite(held).all():
        return None
    edge = _verge(df, unfold, held, lengths, p) if signed else (np.inf, np.empty((0, p)))
    if edge is None:
        return None
    reach, rows = edge

    def add(c):
        d = unfold(c["x"])
        whole = np.isfinite(d).all(axis=1)
        odd, d = (~whole).sum(), d[whole]
        own, margin = _margins(d, held, lengths) if signed else (np.zeros(len(d), int), np.full(len(d), np.inf))
        kept = margin < reach
        parts = [d[(own == i) & ~kept] for i in range(len(sets))]
        inside = d[~kept]
        return np.concatenate([*[(r.T @ r).ravel() for r in parts], *[r.sum(axis=0) for r in parts], [len(r) for r in parts],
                               [odd, kept.sum(), (inside * inside).sum(), inside.size]])

    found = sum_blocks(df, ["x"], add, few_tasks(df))
    if found is None:
        return None
    n = len(sets)
    squares, found = found[:n * p * p].reshape(n, p, p), found[n * p * p:]
    sums, found = found[:n * p].reshape(n, p), found[n * p:]
    count, (odd, kept, total, cells) = found[:n], found[n:]
    # cells are missing, or the passes saw other rows
    if odd or kept != len(rows):
        return None
    return Nearby(sets, signed, held, lengths, squares, sums, rows, reach, float(total), float(cells), count > 0)


def _verge(df: DataFrame, unfold, held: np.ndarray, lengths: np.ndarray, p: int) -> tuple[float, np.ndarray] | None:
    """The margin beyond which rows are summed, and the rows below it."""
    most = NEAR_ROWS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, margins = np.empty((0, p)), np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = unfold(block(batch.column(0)))
            margin = _margins(d, held, lengths)[1]
            low = np.argsort(margin, kind="stable")[:most]
            rows, margins = np.vstack([rows, d[low]]), np.concatenate([margins, margin[low]])
            low = np.argsort(margins, kind="stable")[:most]
            rows, margins = rows[low], margins[low]
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(margins), lists(rows)], names=["margin", "d"])

    found = df.select("x").mapInArrow(run, "margin double, d array<double>").orderBy("margin").limit(most).toArrow()
    margins = np.asarray(found["margin"], dtype=float)
    if not len(margins):
        return np.inf, np.empty((0, p))
    ends = margins if len(margins) == most else np.append(margins, np.inf)
    with np.errstate(invalid="ignore"):
        wide = np.flatnonzero(np.diff(ends) > 2 * _GAP)
    if not len(wide):
        return None
    reach = (ends[wide[-1]] + ends[wide[-1] + 1]) / 2
    return float(reach), block(found["d"])[margins < reach]


def walk(df: DataFrame, unfold: Callable[[np.ndarray], np.ndarray], start, matrix: Callable, signed: bool,
         advance: Callable, rounds: int) -> list[Nearby]:
    """The rows around the model that they alone give, round by round, ``matrix(state)`` being that model.

    ``advance(state, here)`` takes the next step and tells whether it was the last; two more rounds serve models that end later.
    """
    out, state, spare, size = [], start, 2, 0
    for _ in range(rounds):
        here = around(df, unfold, matrix(state), signed)
        if here is None:
            break
        size += here.squares.size + here.rows.size
        if size > ALL_CELLS:
            break
        out.append(here)
        if advance(state, here):
            if not spare:
                break
            spare -= 1
    return out
