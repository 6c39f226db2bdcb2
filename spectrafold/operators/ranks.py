"""Order statistics by radix selection: at most eight scans, whatever the values are.

Doubles have a 64-bit image that sorts as they do. A scan counts, for every column and every leading part of the image in
which a wanted rank is known to lie, how many values follow with each next digit; the digit that holds the rank
makes the leading part longer. A task sends one histogram, so nothing is exploded, sorted or joined, and infinities, very
small and very large values cost no scan more.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..arrays import few_tasks, sum_blocks

_CELLS = 1 << 17  # counts of a histogram, about a megabyte
_SIGN = np.uint64(1 << 63)


def image(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort as the doubles do; both zeros are one."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def double(number: int) -> float:
    """The double of an image; beyond the infinities it is the infinity."""
    number = min(max(number, int(image(np.array([-np.inf]))[0])), int(image(np.array([np.inf]))[0]))
    bits = number - (1 << 63) if number >> 63 else ~number & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def select(df: DataFrame, inputs: list[str], values: Callable[[dict], dict | list], targets: set[tuple[int, int]],
           few: bool | None = None, separate: bool = False) -> dict[tuple[int, int], float]:
    """The value at each (column, 0-based rank) among the values of a column that are numbers.

    ``values`` gives a block's values by column. With ``separate`` any number will do that has just rank + 1 values
    up to it, which often takes fewer scans. A rank past the last value gives the last one.
    """
    few = few_tasks(df) if few is None else few
    state = {t: (0, t[1]) for t in targets}  # leading part, rank within it
    done: dict[tuple[int, int], float] = {}
    left = 64
    while left and len(done) < len(state):
        open_ = {t: s for t, s in state.items() if t not in done}
        nodes = sorted({(t[0], s[0]) for t, s in open_.items()})
        bits = min(left, max(8, min(13, int(math.log2(max(_CELLS // len(nodes), 1))))))
        left -= bits
        counts = _digits(df, inputs, values, nodes, left, bits, few)
        place = {node: k for k, node in enumerate(nodes)}
        for t, (lead, rank) in open_.items():
            upto = np.cumsum(counts[place[t[0], lead]])
            if upto[-1] == 0:
                done[t] = math.nan
                continue
            rank = min(rank, int(upto[-1]) - 1)
            digit = int(np.searchsorted(upto, rank, "right"))
            lead = lead << bits | digit
            state[t] = lead, rank - (int(upto[digit - 1]) if digit else 0)
            if separate and int(upto[digit]) == rank + 1:
                done[t] = double((lead + 1 << left) - 1)
    return {t: done[t] if t in done else double(s[0]) for t, s in state.items()}


def _digits(df, inputs, values, nodes, shift: int, bits: int, few: bool) -> np.ndarray:
    """For each node (column, leading part) the counts of the next digit."""
    groups: dict[int, tuple[int, np.ndarray]] = {}
    for k, (column, _) in enumerate(nodes):
        if column not in groups:
            groups[column] = k, np.array([lead for c, lead in nodes if c == column], np.uint64)

    def count(b):
        found = values(b)
        out = np.zeros(len(nodes) << bits)
        for column, (first, leads) in groups.items():
            v = found[column] if not isinstance(found, dict) else found.get(column)
            if v is None or not len(v):
                continue
            img = image(v[~np.isnan(v)])
            high = img >> np.uint64(shift + bits) if shift + bits < 64 else np.zeros(len(img), np.uint64)
            at = np.minimum(np.searchsorted(leads, high), len(leads) - 1)
            here = leads[at] == high
            digit = (img[here] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            out[first << bits:first + len(leads) << bits] += np.bincount((at[here] << bits) + digit.astype(np.int64), minlength=len(leads) << bits)
        return out

    total = sum_blocks(df, inputs, count, few)
    return np.zeros((len(nodes), 1 << bits)) if total is None else total.reshape(len(nodes), -1)


def interpolated(n: int, probs: list[float], at: Callable[[int], float]) -> list[float]:
    """Quantiles between the two ranks next to them."""
    out = []
    for p in probs:
        h = (n - 1) * p
        low, high, share = at(math.floor(h)), at(math.ceil(h)), h - math.floor(h)
        out.append(low if low == high or not share else low + (high - low) * share if math.isfinite(high - low)
                   else low * (1 - share) + high * share)
    return out


def wanted(n: int, probs: list[float]) -> set[int]:
    return {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
