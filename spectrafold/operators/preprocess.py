"""Preprocessing: row-local expressions, after one calibration-only statistics pass.

Multiway samples are flattened C-order, so an operation along way ``w`` works on index groups
that are known on the driver; first-order data is one group, the whole row.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import map_blocks, sum_blocks
from ..dataset import Axis, Dataset
from ..functions import vectors as V
from .stats import array_quantiles, column_extremes

_EPS = 1e-10


def _way(ds: Dataset, way: int | None) -> int:
    """0-based way; ``None`` is the last one."""
    way = len(ds.shape) if way is None else int(way)
    if not 1 <= way <= len(ds.shape):
        raise ValueError(f"way {way} does not exist in shape {ds.shape}")
    return way - 1


def _along(ds: Dataset, way: int | None, fn, length: int | None = None) -> Dataset:
    """Apply ``fn`` (rows × variables → rows × new length) along a way of each tensor."""
    w = _way(ds, way)
    shape = ds.shape
    outcome = list(shape)
    if length is not None:
        outcome[w] = length
    outcome = tuple(outcome)

    def run(cols):
        tensor = np.moveaxis(cols["x"].reshape(-1, *shape), w + 1, -1)
        done = fn(tensor.reshape(-1, shape[w])).reshape(*tensor.shape[:-1], outcome[w])
        return {"x": np.moveaxis(done, -1, w + 1).reshape(len(cols["x"]), -1)}

    keep = [c for c in ds.df.columns if c != "x"]
    done = map_blocks(ds.df, run, [("x", "array<double>")], ["x"], keep)
    return ds.with_df(done.select(*ds.df.columns), shape=outcome)


# --- scatter correction -------------------------------------------------------------------

def msc_reference(ds: Dataset, way: int | None = None) -> np.ndarray:
    """Mean calibration profile along a way, averaged over samples and the other ways."""
    stats = column_extremes(ds.cal)
    mean = (stats["s"] / stats["n"]).reshape(ds.shape)
    w = _way(ds, way)
    return mean.mean(axis=tuple(i for i in range(mean.ndim) if i != w))


def msc(ds: Dataset, way: int | None = None, reference=None) -> Dataset:
    """Regress each profile on the reference and undo offset and slope."""
    ref = np.asarray(msc_reference(ds, way) if reference is None else reference, dtype=float)
    if len(ref) != ds.shape[_way(ds, way)]:
        raise ValueError("reference and data differ in length")
    centred = ref - ref.mean()
    power = float(centred @ centred)
    if power / len(ref) < 1e-12:
        raise ValueError("the reference profile is flat")
    if len(ds.shape) == 1:
        fit = F.struct((V.dot("x", V.literal(centred)) / power).alias("b"), V.average("x").alias("m"))
        undo = lambda s: F.when(F.abs(s["b"]) >= 1e-12, V.let(
            s["m"] - s["b"] * float(ref.mean()), lambda a: F.transform("x", lambda v: (v - a) / s["b"]))) \
            .otherwise(F.col("x"))
        return ds.with_x(V.let(fit, undo))
    offset = float(ref.mean())

    def correct(z):
        means = z.mean(axis=1, keepdims=True)
        slopes = ((z - means) @ centred / power)[:, None]
        stable = np.abs(slopes) >= 1e-12
        return np.where(stable, (z - (means - slopes * offset)) / np.where(stable, slopes, 1), z)

    return _along(ds, way, correct)


def snv(ds: Dataset, way: int | None = None) -> Dataset:
    """Centre and scale each profile by its own mean and population deviation."""
    if len(ds.shape) == 1:
        own = F.struct(V.average("x").alias("m"), (V.spread("x") + _EPS).alias("s"))
        return ds.with_x(V.let(own, lambda o: F.transform("x", lambda v: (v - o["m"]) / o["s"])))
    return _along(ds, way, lambda z: (z - z.mean(1, keepdims=True)) / (z.std(1, keepdims=True) + _EPS))


# --- smoothing and derivatives ------------------------------------------------------------

def smoothing_matrix(size: int, window: int) -> np.ndarray:
    """Moving average with repeated edge values, as a banded matrix."""
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i - window // 2, i - window // 2 + window):
            out[i, min(max(j, 0), size - 1)] += 1.0 / window
    return out


def savgol_matrix(size: int, window: int, order: int) -> np.ndarray:
    """Local polynomial smoothing as a banded matrix; the edges use the end windows' fits."""
    if window % 2 == 0:
        window += 1
    if window <= order:
        window = order + 2
    if window > size:
        raise ValueError("the window is longer than the profile")
    t = np.arange(window) - window // 2
    basis = np.vander(t.astype(float), order + 1, increasing=True)
    hat = basis @ np.linalg.pinv(basis)  # row i: the fit evaluated at place i of a window
    out = np.zeros((size, size))
    half = window // 2
    # an even window (order + 2 of an even order) keeps its right-leaning centre
    right = window - 1 - half
    for i in range(size):
        start = min(max(i - half, 0), size - window)
        out[i, start:start + window] = hat[i - start] if (i < half or i >= size - right) else hat[half]
    return out


def moving_average(ds: Dataset, window: int = 5, way: int | None = None) -> Dataset:
    """Centred moving average; first-order data is smoothed along its variables."""
    if len(ds.shape) == 1:
        return ds.with_x(V.running_mean("x", window))
    band = smoothing_matrix(ds.shape[_way(ds, way)], window)
    return _along(ds, way, lambda z: z @ band.T)


def savgol(ds: Dataset, window: int = 5, order: int = 2, way: int | None = None) -> Dataset:
    band = savgol_matrix(ds.shape[_way(ds, way)], window, order)
    return _along(ds, way, lambda z: z @ band.T)


def ma_baseline(ds: Dataset, window: int = 5, way: int | None = None) -> Dataset:
    """Subtract the moving average."""
    if len(ds.shape) == 1:
        return ds.with_x(V.minus("x", V.running_mean("x", window)))
    band = np.eye(ds.shape[_way(ds, way)]) - smoothing_matrix(ds.shape[_way(ds, way)], window)
    return _along(ds, way, lambda z: z @ band.T)


def derivative(ds: Dataset, order: int = 1, way: int | None = None) -> Dataset:
    """Repeated difference along a way; the first ``order`` axis entries go."""
    w = _way(ds, way)
    size = ds.shape[w]
    if order < 1 or size <= order:
        raise ValueError("the order must be at least 1 and below the profile length")
    axes = list(ds.axes)
    axes[w] = axes[w].pick(range(order, size))
    if len(ds.shape) == 1:
        return ds.with_x(V.difference("x", order), shape=(size - order,), axes=tuple(axes))
    out = _along(ds, way, lambda z: np.diff(z, n=order, axis=1), size - order)
    return out.with_df(out.df, axes=tuple(axes))


def baseline(ds: Dataset, method: str = "msc", way: int | None = None, window: int = 5,
             order: int = 1) -> Dataset:
    if method == "msc":
        return msc(ds, way)
    if method in ("snv", "svn"):
        return snv(ds, way)
    if method == "moving_average":
        return ma_baseline(ds, window, way)
    if method == "derivative":
        return derivative(ds, order, way)
    raise ValueError(f"unknown baseline method {method}")


def smooth(ds: Dataset, method: str = "moving_average", window: int = 5, order: int = 2,
           way: int | None = None) -> Dataset:
    if method == "moving_average":
        return moving_average(ds, window, way)
    if method == "savitzky_golay":
        return savgol(ds, window, order, way)
    raise ValueError(f"unknown smoothing method {method}")


# --- centring and scaling -----------------------------------------------------------------

@dataclass(frozen=True)
class ScaleModel:
    """x → (x - shift) / divisor + offset, from calibration statistics."""

    method: str
    shift: np.ndarray
    divisor: np.ndarray
    offset: float = 0.0

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        if self.method == "none":
            return df
        scaled = F.zip_with(F.col(x), F.arrays_zip(V.literal(self.shift).alias("a"),
                                                   V.literal(self.divisor).alias("b")),
                            lambda v, s: (v - s["a"]) / s["b"] + self.offset)
        return df.withColumn(x, scaled)


def fit_scale(df: DataFrame, method: str) -> ScaleModel:
    """Statistics of one scan (two more for exact quantiles) as a small model."""
    if method == "none":
        return ScaleModel(method, np.zeros(0), np.ones(0))
    if method == "robust":
        low, median, high = array_quantiles(df, [0.25, 0.5, 0.75])
        return ScaleModel(method, median, high - low + _EPS)
    stats = column_extremes(df)
    n, mean = stats["n"], stats["s"] / stats["n"]
    zero = np.zeros_like(mean)
    if method == "center":
        return ScaleModel(method, mean, zero + 1)
    if method == "frobenius":
        return ScaleModel(method, zero, zero + np.sqrt(stats["ss"].sum()) + _EPS)
    if method == "range_0_1":
        return ScaleModel(method, stats["lo"], stats["hi"] - stats["lo"] + _EPS)
    if method == "range_-1_1":
        return ScaleModel(method, stats["lo"], (stats["hi"] - stats["lo"] + _EPS) / 2, -1.0)
    if method in ("autoscale", "variance"):
        # centred second pass: a difference of large sums would lose the digits
        variance = _centred_squares(df, mean) / n
        return ScaleModel(method, mean, (np.sqrt(variance) if method == "autoscale" else variance) + _EPS)
    raise ValueError(f"unknown scaling method {method}")


def _centred_squares(df: DataFrame, mean: np.ndarray) -> np.ndarray:
    return sum_blocks(df, ["x"], lambda c: np.square(c["x"] - mean).sum(axis=0))


def scale(ds: Dataset, method: str = "center") -> tuple[Dataset, ScaleModel]:
    """Centre/scale all rows by calibration statistics; ``scaled`` records a real scaling."""
    model = fit_scale(ds.cal, method)
    return ds.with_df(model.transform(ds.df), scaled=method not in ("none", "center")), model


def subtract_blank(ds: Dataset, blank: Dataset) -> Dataset:
    """Subtract the mean profile of the blank samples."""
    if prod(blank.shape) != ds.width or (len(blank.shape) == len(ds.shape) and blank.shape != ds.shape):
        raise ValueError(f"blank shape {blank.shape} does not match {ds.shape}")
    stats = column_extremes(blank.df)
    return ds.with_x(V.minus("x", V.literal(stats["s"] / stats["n"])))


# --- tensor centring / normalisation ------------------------------------------------------

@dataclass(frozen=True)
class ModeModel:
    """Mode after mode, subtract slab means and divide by slab deviations.

    Mode 0 is the sample mode: its slab is the row, so it uses the row's own values and needs
    no statistics. The other modes re-apply what the calibration rows gave.
    """

    steps: tuple[tuple[str, int, np.ndarray | None], ...]
    shape: tuple[int, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.steps:
            return df
        steps, shape = self.steps, self.shape

        def run(cols):
            x = cols["x"].reshape(-1, *shape)
            for kind, mode, values in steps:
                if mode == 0:
                    axes = tuple(range(1, x.ndim))
                    own = np.nanmean if kind == "center" else np.nanstd
                    values = own(x, axis=axes, keepdims=True)
                    if kind != "center":
                        values = np.where(values > 0, values, 1.0)
                x = x - values if kind == "center" else x / values
            return {"x": x.reshape(len(x), -1)}

        keep = [c for c in df.columns if c != "x"]
        return map_blocks(df, run, [("x", "array<double>")], ["x"], keep).select(*df.columns)


def _slab_stats(df: DataFrame, shape, mode: int, shift=0.0):
    """Observed count, sum and sum of squares per slab of an instrument mode."""
    form = [1] * len(shape)
    form[mode - 1] = shape[mode - 1]
    other = tuple(i for i in range(len(shape)) if i != mode - 1)

    def run(cols):
        x = cols["x"].reshape(-1, *shape) - shift
        seen = np.isfinite(x)
        x = np.where(seen, x, 0.0)
        return {"v": np.concatenate([a.sum(axis=tuple(i + 1 for i in other)) for a in (seen, x, x * x)],
                                    axis=1)}

    sums = column_extremes(map_blocks(df, run, [("v", "array<double>")], ["x"], []), "v")["s"]
    return [part.reshape(form) for part in np.split(sums, 3)]


def fit_modes(ds: Dataset, center=(), normalize=()) -> ModeModel:
    """Modes are taken in order, each centred and then normalised if listed (0 = samples)."""
    model = ModeModel((), ds.shape)
    for mode in range(len(ds.shape) + 1):
        for kind, wanted in (("center", center), ("norm", normalize)):
            if mode not in wanted:
                continue
            values = None
            if mode:
                now = model.transform(ds.cal)
                n, s, _ = _slab_stats(now, ds.shape, mode)
                values = s / np.maximum(n, 1)
                if kind == "norm":
                    n, s, ss = _slab_stats(now, ds.shape, mode, values)
                    values = np.sqrt(ss / np.maximum(n, 1))
                    values = np.where(values > 0, values, 1.0)
            model = ModeModel(model.steps + ((kind, mode, values),), ds.shape)
    return model


# --- synchronous fluorescence to excitation-emission --------------------------------------

def sfm_layout(rows: int, cols: int, step_offset: float, step_exc: float):
    """Output column of every (excitation, offset) cell and the emission step positions.

    With the step ratio reduced to m/n, 1-based row i of cycle k = ceil(i/m) and column j go to
    (i - m(k-1)) + m(j-1) + m·n·(k-1). If neither m nor n is 1 the columns interleave and are
    ordered by their emission position n·(c mod m) + m·(c div m).
    """
    if step_offset <= 0 or step_exc <= 0:
        raise ValueError("steps must be positive")
    ratio = Fraction(str(float(step_offset) / float(step_exc))).limit_denominator(1_000_000)
    m, n = ratio.numerator, ratio.denominator
    i = np.arange(rows)[:, None]
    j = np.arange(cols)[None, :]
    target = i % m + m * j + m * n * (i // m)
    count = int(target.max()) + 1
    place = np.arange(count)
    if m != 1 and n != 1:
        position = n * (place % m) + m * (place // m)
        order = np.argsort(position, kind="stable")
        rank = np.empty(count, dtype=int)
        rank[order] = place
        return rank[target], position[order] * (step_offset / m)
    return target, place * (step_offset / m)


def sfm_to_eem(ds: Dataset, step_offset: float, step_exc: float, transpose: bool = False) -> Dataset:
    """Re-index each excitation × offset matrix to excitation × emission; open cells are NaN.

    One table of source positions serves all samples, so this is a row-local gather.
    """
    if len(ds.shape) != 2:
        raise ValueError("samples must be matrices")
    shape = ds.shape[::-1] if transpose else ds.shape
    target, _ = sfm_layout(*shape, step_offset, step_exc)
    rows, width = shape[0], int(target.max()) + 1
    source = np.full((rows, width), -1)
    cells = np.arange(ds.width).reshape(ds.shape)
    cells = cells.T if transpose else cells
    source[np.arange(rows)[:, None], target] = cells
    exc, off = (ds.axes[1], ds.axes[0]) if transpose else ds.axes
    emission = _emission_axis(exc.numbers, off.numbers, target, width, step_offset, step_exc)
    axis = Axis(emission, tuple(f"{v:g}" for v in emission), "Continuous", "Emission")
    flat = (source.T if transpose else source).reshape(-1)
    gather = F.array(*[F.lit(int(p)) for p in flat])
    out = F.transform(gather, lambda g: F.when(g < 0, F.lit(float("nan"))).otherwise(F.get("x", g)))
    return ds.with_x(out, shape=(width, rows) if transpose else (rows, width),
                     axes=(axis, exc) if transpose else (exc, axis))


def _emission_axis(exc, off, target, width, step_offset, step_exc):
    rows, cols = target.shape
    exc = np.arange(rows) * step_exc if exc is None else np.asarray(exc)
    off = np.arange(cols) * step_offset if off is None else np.asarray(off)
    added = np.full((rows, width), np.nan)
    added[np.arange(rows)[:, None], target] = exc[:, None] + off[None, :]
    seen = np.isfinite(added)
    with np.errstate(invalid="ignore"):
        return tuple(float(v) for v in np.where(seen, added, 0).sum(0) / np.where(seen.any(0), seen.sum(0), np.nan))
