"""Sample and variable selection, tensor slicing, mask trimming, column extraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Axis, Dataset
from ..functions import vectors as V
from ..functions.specs import number_list, text_list
from .ordering import with_index

_LITERAL_LIMIT = 1000  # longer selector lists become a joined table


def select_samples(ds: Dataset, spec, mode: str = "keep", by: str = "position") -> Dataset:
    """Keep or drop samples by 1-based position or by label.

    A selector that matches no sample leaves the data as it is, in both modes.
    """
    if by == "position":
        values, column, kind = [int(v) - 1 for v in number_list(spec)], "ix", "long"
    else:
        values, column, kind = text_list(spec), "label", "string"
    if not values:
        return ds
    if len(values) <= _LITERAL_LIMIT:
        hit = F.col(column).isin(values)
        if not ds.df.filter(hit).limit(1).count():
            return ds
        return ds.with_df(ds.df.filter(hit if mode == "keep" else ~hit))
    wanted = ds.df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {kind}").distinct()
    if not ds.df.join(wanted, column, "left_semi").limit(1).count():
        return ds
    return ds.with_df(ds.df.join(wanted, column, "left_semi" if mode == "keep" else "left_anti"))


def axis_positions(axis: Axis, size: int, spec) -> list[int]:
    """Positions a selector names: axis values if the axis has numbers, else places or labels."""
    if axis.numbers is not None:
        wanted = number_list(spec)
        return [i for i, v in enumerate(axis.numbers) if any(abs(v - w) <= 1e-9 for w in wanted)]
    if axis.texts is not None:
        labels = set(text_list(spec if not isinstance(spec, (int, float)) else str(spec)))
        found = [i for i, t in enumerate(axis.texts) if t in labels]
        if found:
            return found
    try:
        places = {int(v) - 1 for v in number_list(spec)}
    except ValueError:
        return []
    return [i for i in range(size) if i in places]


def select_variables(ds: Dataset, variables: dict[int, object], mode: str = "keep") -> Dataset:
    """Keep or drop variables per 1-based way; calibration and validation alike."""
    keeps, axes = [], []
    for w, (axis, size) in enumerate(zip(ds.axes, ds.shape), start=1):
        keep = list(range(size))
        if w in variables:
            hit = axis_positions(axis, size, variables[w])
            if hit:
                keep = hit if mode == "keep" else [i for i in keep if i not in set(hit)]
        keeps.append(keep)
        axes.append(axis.pick(keep))
    cells = np.arange(ds.width).reshape(ds.shape)[np.ix_(*keeps)]
    out = ds.with_x(V.take("x", cells.reshape(-1)), shape=cells.shape, axes=tuple(axes))
    if ds.has("mask"):
        out = out.with_df(out.df.withColumn("mask", V.take("mask", cells.reshape(-1))))
    return out


def reindex(ds: Dataset) -> Dataset:
    """Close the gaps a selection left in the positions; repeated labels get a suffix."""
    df, _ = with_index(ds.df.withColumnRenamed("ix", "_old"), ["_old"])
    return ds.with_df(df.drop("_old"))


def tensor_slice(ds: Dataset, fixed: dict[int, int]) -> Dataset:
    """Fix 0-based places of 1-based ways; the fixed ways go."""
    cut = tuple(fixed.get(w, slice(None)) for w in range(1, len(ds.shape) + 1))
    cells = np.arange(ds.width).reshape(ds.shape)[cut]
    axes = tuple(a for w, a in enumerate(ds.axes, start=1) if w not in fixed)
    shape = cells.shape or (1,)
    return ds.with_x(V.take("x", np.ravel(cells)), shape=shape, axes=axes or (Axis(),))


def unfold(ds: Dataset) -> Dataset:
    """Samples × everything else: the flattening that ``x`` already has."""
    return ds.with_df(ds.df, shape=(ds.width,), axes=(Axis(),))


def mode_unfold(ds: Dataset, way: int) -> DataFrame:
    """Matricisation in long form: (ix, row = place along the way, col = place among the rest)."""
    w = way - 1
    cells = np.arange(ds.width).reshape(ds.shape)
    order = np.moveaxis(cells, w, 0).reshape(ds.shape[w], -1)
    row = np.empty(ds.width, dtype=int)
    col = np.empty(ds.width, dtype=int)
    row[order] = np.arange(order.shape[0])[:, None]
    col[order] = np.arange(order.shape[1])[None, :]
    places = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("pos"))
    return (ds.df.select("ix", F.posexplode("x").alias("pos", "value"))
            .select("ix", places(row).alias("row"), places(col).alias("col"), "value"))


def mode_fold(long: DataFrame, shape: tuple[int, ...], way: int) -> DataFrame:
    """Inverse of ``mode_unfold``: (ix, x)."""
    order = np.moveaxis(np.arange(int(np.prod(shape))).reshape(shape), way - 1, 0)
    order = order.reshape(shape[way - 1], -1)
    width = order.shape[1]
    place = F.get(F.array(*[F.lit(int(v)) for v in order.reshape(-1)]),
                  (F.col("row") * width + F.col("col")).cast("int"))
    return (long.withColumn("_p", place).groupBy("ix")
            .agg(F.array_sort(F.collect_list(F.struct("_p", "value"))).alias("_s"))
            .select("ix", F.transform("_s", lambda s: s["value"]).alias("x")))


def trim_masked(ds: Dataset) -> Dataset:
    """Cut every sample to the shortest observed length of way 1; drop fully padded samples.

    ``mask`` is true where a value was observed.
    """
    if not ds.has("mask"):
        return ds
    inner = ds.width // ds.shape[0]
    observed = F.ceil(F.size(F.filter("mask", lambda m: m)) / inner)
    df = ds.df.withColumn("_len", observed).filter("_len > 0")
    common = df.agg(F.min("_len").alias("n")).first()["n"]
    if not common:
        raise ValueError("no sample has an observed value")
    common = int(common)
    cells = range(common * inner)
    df = df.withColumn("x", V.take("x", cells)).withColumn("mask", V.take("mask", cells)).drop("_len")
    return ds.with_df(df, shape=(common, *ds.shape[1:]),
                      axes=(ds.axes[0].pick(range(common)), *ds.axes[1:]))


def extract_columns(ds: Dataset, y=None, classes=None, label=None) -> Dataset:
    """Move 1-based columns of ``x`` to responses, class layers or labels.

    A column named both a response and a class is a class.
    """
    class_at = [int(v) - 1 for v in number_list(classes)]
    y_at = [int(v) - 1 for v in number_list(y) if int(v) - 1 not in class_at]
    label_at = [int(v) - 1 for v in number_list(label)]
    for at in (*class_at, *y_at, *label_at):
        if not 0 <= at < ds.width:
            raise ValueError(f"column {at + 1} is outside 1..{ds.width}")
    gone = set(class_at) | set(y_at) | set(label_at)
    keep = [i for i in range(ds.width) if i not in gone]
    df = ds.df
    text = lambda i: F.when(F.get("x", F.lit(i)) == F.floor(F.get("x", F.lit(i))),
                            F.get("x", F.lit(i)).cast("long").cast("string")) \
        .otherwise(F.get("x", F.lit(i)).cast("string"))
    if y_at:
        df = df.withColumn("y", V.take("x", y_at))
    if class_at:
        df = df.withColumn("classes", F.array(*[text(i) for i in class_at]))
    if label_at:
        df = df.withColumn("label", text(label_at[0]))
    names = ds.y_names
    if y_at:
        texts = ds.axes[0].texts
        names = tuple(texts[i] if texts else f"Y{n}" for n, i in enumerate(y_at, start=1))
    return ds.with_df(df.withColumn("x", V.take("x", keep)), shape=(len(keep),),
                      axes=(ds.axes[0].pick(keep),), y_names=names)


def suffix_duplicates(df: DataFrame, key: str, order: str = "ix") -> DataFrame:
    """key, key__2, key__3 … in sample order; a hot key is ranked over many tasks."""
    from .ordering import rank_within
    ranked = rank_within(df, key, [order], "_rank")
    return ranked.withColumn(key, F.when(F.col("_rank") == 0, F.col(key)).otherwise(
        F.concat_ws("__", F.col(key), (F.col("_rank") + 1).cast("string")))).drop("_rank")
