"""The sample-by-variable data model.

One row per sample: ``ix`` (0-based position), ``x`` ARRAY<DOUBLE> (a tensor sample is its
C-order flattening) and, when known, ``y`` ARRAY<DOUBLE>, ``classes`` ARRAY<STRING>, ``label``,
``split`` ('cal'/'val'), ``mask`` ARRAY<BOOLEAN>. What is equal for all rows (tensor shape,
axes, response names) lives beside the DataFrame, not in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """Descriptor of one non-sample way."""

    numbers: tuple[float, ...] | None = None
    texts: tuple[str, ...] | None = None
    nature: str = "Continuous"
    name: str = ""

    def pick(self, keep) -> "Axis":
        return replace(self,
                       numbers=None if self.numbers is None else tuple(self.numbers[i] for i in keep),
                       texts=None if self.texts is None else tuple(self.texts[i] for i in keep))


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    shape: tuple[int, ...]
    axes: tuple[Axis, ...] = ()
    y_names: tuple[str, ...] = ()
    scaled: bool = False
    info: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.axes:
            object.__setattr__(self, "axes", tuple(Axis() for _ in self.shape))

    @property
    def width(self) -> int:
        return prod(self.shape)

    @property
    def cal(self) -> DataFrame:
        """Rows that statistics and models are fitted on."""
        return self.df.filter(F.col("split") == "cal") if "split" in self.df.columns else self.df

    @property
    def val(self) -> DataFrame:
        return self.df.filter(F.col("split") == "val")

    def has(self, column: str) -> bool:
        return column in self.df.columns

    def with_df(self, df: DataFrame, **changes) -> "Dataset":
        return replace(self, df=df, **changes)

    def with_x(self, expression, **changes) -> "Dataset":
        return self.with_df(self.df.withColumn("x", expression), **changes)

    def axes_frame(self) -> DataFrame:
        """The axes as rows ``(way, pos, num, txt, nature, dim)``."""
        rows = [(w, i, None if a.numbers is None else float(a.numbers[i]),
                 None if a.texts is None else a.texts[i], a.nature, a.name)
                for w, (a, n) in enumerate(zip(self.axes, self.shape), start=1) for i in range(n)]
        return self.df.sparkSession.createDataFrame(
            rows, "way int, pos int, num double, txt string, nature string, dim string")


def dataset(df: DataFrame, shape=None, **more) -> Dataset:
    """Wrap a DataFrame that has ``ix`` and ``x``; the width is read from one row if not given."""
    if shape is None:
        first = df.select(F.size("x").alias("n")).first()
        shape = (first["n"] if first else 0,)
    return Dataset(df, tuple(int(s) for s in shape), **more)


def class_layer(layer: int = 1):
    """The class label of a 1-based layer; a layer past the end means the last one."""
    return F.element_at("classes", F.greatest(F.lit(1), F.least(F.lit(int(layer)), F.size("classes"))))
