"""The catalogue of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Axis, Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WIDTH = 64  # values per embedding

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

# the embeddings as (vec_id, label, pos, v) rows, for the SQL side
LONG = ("long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, "
        "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")

# lineitem with its 0-based position
INDEXED = (f"indexed AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS ix, "
           "count(*) OVER () AS n FROM lineitem)")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spectra(spark: SparkSession, folder: str, shape=(WIDTH,)) -> Dataset:
    """The embeddings as samples: 64 variables, or the same values as a matrix."""
    df = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("ix"), F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("string").alias("label"), F.array(F.col("label").cast("string")).alias("classes"))
    return Dataset(df, tuple(shape), axes=tuple(Axis(texts=tuple(f"V{i + 1}" for i in range(n))) for n in shape))


def regression_spectra(spark: SparkSession, folder: str) -> Dataset:
    """Response = first value of the embedding, variables = the other 63."""
    ds = spectra(spark, folder)
    df = ds.df.withColumn("y", F.slice("x", 1, 1)).withColumn("x", F.slice("x", 2, WIDTH - 1))
    return Dataset(df, (WIDTH - 1,), y_names=("y",))


def lines(spark: SparkSession, folder: str) -> Dataset:
    """lineitem as samples: quantity, discount and tax."""
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("x"))
    return Dataset(df, (3,), axes=(Axis(texts=("quantity", "discount", "tax")),))


def r6(c, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def long_x(df: DataFrame, *keep: str, value: str = "value") -> DataFrame:
    # the outer form: the plain one adds a filter that computes ``x`` a second time
    return (df.select(*keep, F.posexplode_outer("x").alias("pos", "_v")).filter("pos is not null")
            .select(*keep, F.col("pos").cast("long").alias("pos"), r6("_v").alias(value)))
