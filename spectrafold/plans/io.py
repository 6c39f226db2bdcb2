"""Queries that write a table as files, read it back through a source, or stream it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import latent, preprocess
from ..session import ensure_checkpoint_dir
from ..sources import files, models, tables, text
from ..sources.text import Format
from ..streaming import scoring
from .registry import LONG, long_x, query, r6, spectra, table


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_text(df, separator: str, path: str, with_label: bool = False):
    """One line per sample, in sample order inside each file, files in order as well."""
    values = F.concat_ws(separator, F.transform("x", lambda v: v.cast("string")))
    line = F.concat_ws(separator, F.col("label"), values) if with_label else values
    (df.repartitionByRange(4, "ix").sortWithinPartitions("ix").select(line.alias("value")).write.mode("overwrite").text(path))


_ROWS = f"WITH {LONG} SELECT vec_id, pos, round(v, 6) + 0.0 AS value FROM long"


@query("read_matrix_comma", _ROWS)
def read_matrix_comma(spark, folder):
    """Spectra written as comma-separated lines and read back: positions, width and values."""
    path = _folder(spark, "matrix")
    _as_text(spectra(spark, folder).df, ",", path)
    ds = text.read_samples(spark, path)
    return long_x(ds.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("read_matrix_tabs_classes", f"""
WITH {LONG} SELECT vec_id, CAST(label AS VARCHAR) AS class, pos, round(v, 6) + 0.0 AS value FROM long""")
def read_matrix_tabs_classes(spark, folder):
    """Tab-separated with the class in the first column, which is taken out as a class."""
    path = _folder(spark, "classes")
    _as_text(spectra(spark, folder).df, "\t", path, with_label=True)
    ds = text.read_samples(spark, path, classes=1)
    df = ds.df.withColumnRenamed("ix", "vec_id").withColumn("class", F.get("classes", F.lit(0)))
    return long_x(df, "vec_id", "class").select("vec_id", "class", "pos", "value")


@query("read_vector_files", f"WITH {LONG} SELECT vec_id, round(sum(v), 5) + 0.0 AS total, count(*) AS n FROM long GROUP BY vec_id")
def read_vector_files(spark, folder):
    """One file per sample with a value per line, read back whole."""
    path = _folder(spark, "vectors")
    lines = spectra(spark, folder).df.select(
        F.col("ix").alias("vec_id"), F.concat_ws("\n", F.transform("x", lambda v: v.cast("string"))).alias("value"))
    _written(lines, "vec_id", path)
    rows = F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")
    sample = F.transform(rows, lambda s: text.number(s))
    vec = F.regexp_extract("file_path", "vec_id=([0-9]+)", 1).cast("long")
    return text.scan_files(spark, path).select(
        vec.alias("vec_id"), r6(F.aggregate(sample, F.lit(0.0), lambda a, v: a + v), 5).alias("total"),
        F.size(sample).cast("long").alias("n"))


_FILES = 1000  # files that a task writes


def _written(df, key: str, path: str) -> None:
    """A file for each key; as many tasks as the rows need."""
    spread = df.repartitionByRange(max(8, -(-df.count() // _FILES)), key)
    if files.known(path):
        files.write_each(spread, key, path)
    else:
        spread.write.mode("overwrite").partitionBy(key).text(path)


def _as_files(df, path: str, value) -> None:
    """A file for each sample, named by its id."""
    name = F.lpad(F.col("ix").cast("string"), 12, "0").alias("name")
    _written(df.select(name, value.alias("value")), "name", path)


def _named(ds):
    """A read dataset with the id that its file is named by."""
    return ds.df.withColumn("vec_id", F.regexp_extract("meta.file_path", "name=([0-9]+)", 1).cast("long"))


def _rows_text(width, from_=0, to=None):
    """The values of ``x`` as lines of ``width`` comma-separated cells."""
    last = F.size("x") if to is None else to
    lines = F.transform(F.sequence(F.lit(from_), last - width, F.lit(width)),
                        lambda k: F.concat_ws(",", F.transform(F.slice("x", k + 1, width), lambda v: v.cast("string"))))
    return F.concat_ws("\n", lines)


@query("read_tensor_files", f"""
WITH {LONG} SELECT vec_id, (pos % 8) * 8 + pos // 8 AS pos, round(v, 6) + 0.0 AS value FROM long""")
def read_tensor_files(spark, folder):
    """A file of 64 values for each sample, read as 8 x 8 tensors in Fortran order."""
    path = _folder(spark, "tensors")
    _as_files(spectra(spark, folder).df, path, _rows_text(1))
    ds = text.read_samples(spark, path, ways=2, dims=(8, 8))
    return long_x(_named(ds), "vec_id")


@query("read_ragged_matrices", f"""
WITH {LONG}, cells AS (SELECT vec_id, pos, CASE WHEN pos < 8 * (4 + vec_id % 5) THEN round(v, 6) + 0.0 END AS value FROM long)
SELECT vec_id, pos, coalesce(value, -1.0) AS value, value IS NOT NULL AS found FROM cells""")
def read_ragged_matrices(spark, folder):
    """A matrix file of 4 to 8 rows for each sample, filled up with -1 and masked."""
    path = _folder(spark, "ragged")
    _as_files(spectra(spark, folder).df, path, _rows_text(8, 0, (8 * (4 + F.col("ix") % 5)).cast("int")))
    ds = text.read_samples(spark, path, Format(layout="x_matrix"), ways=2, pad=-1.0)
    pairs = F.arrays_zip(F.col("x").alias("x"), F.col("mask").alias("m"))
    rows = _named(ds).select("vec_id", F.posexplode(pairs).alias("pos", "p"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("p.x").alias("value"), F.col("p.m").alias("found"))


@query("read_stacked_files", f"""
WITH {LONG}, ranked AS (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS ix FROM long)
SELECT ix, 'Sample_' || (ix + 1) AS label, (pos % 32) * 2 + pos // 32 AS pos, round(v, 6) + 0.0 AS value FROM ranked""")
def read_stacked_files(spark, folder):
    """Two files of 32 values for each sample, stacked as a 32 x 2 tensor."""
    path = _folder(spark, "stacked")
    df = spectra(spark, folder).df
    halves = df.select("ix", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.slice("x", 32 * k + 1, 32).alias("x")) for k in (0, 1)])).alias("h"))
    _as_files(halves.select((F.col("ix") * 2 + F.col("h.k")).alias("ix"), F.col("h.x").alias("x")), path, _rows_text(1))
    ds = text.read_samples(spark, path, Format(layout="x_vector", separator="comma"), ways=2, dims=(32, 2), files_per_sample=2)
    return long_x(ds.df, "ix", "label")


@query("read_xy_files", f"""
WITH {LONG} SELECT vec_id, 'part-' AS stem, pos, round(v, 6) + 0.0 AS value, 1 AS row_in_file, 64 AS cells FROM long""")
def read_xy_files(spark, folder):
    """Axis and value a line: the separator and the layout are found, the values are the samples."""
    path = _folder(spark, "pairs")
    lines = F.transform("x", lambda v, i: F.concat((400 + i).cast("string"), F.lit("\t"), v.cast("string")))
    _as_files(spectra(spark, folder).df, path, F.concat_ws("\n", lines))
    ds = text.read_samples(spark, path)
    rows = _named(ds).withColumn("row_in_file", F.col("meta.row_in_file")).withColumn("stem", F.substring("label", 1, 5)).withColumn("cells", F.size("x"))
    return long_x(rows, "vec_id", "stem", "row_in_file", "cells").select("vec_id", "stem", "pos", "value", F.col("row_in_file").cast("int").alias("row_in_file"), "cells")


def _one_file(df, path: str) -> None:
    """Lines (``ix``, ``value``) as one file in their order."""
    df.coalesce(1).sortWithinPartitions("ix").select("value").write.mode("overwrite").text(path)


@query("read_headers", f"""
WITH {LONG} SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS ix, 3 AS header_rows, 2 AS header_columns, 'tabs' AS separator,
  pos, round(v, 6) + 0.0 AS value FROM long""")
def read_headers(spark, folder):
    """Three header lines and two text columns are found and left out."""
    path = _folder(spark, "headers")
    cells = F.concat_ws("\t", F.concat(F.lit("s"), F.col("ix").cast("string")), F.lit("kind"), F.concat_ws("\t", F.transform("x", lambda v: v.cast("string"))))
    head = spark.range(-3, 0).select(F.col("id").alias("ix"), F.lit("title\tof the\tcolumns 1 a").alias("value"))
    _one_file(spectra(spark, folder).df.select("ix", cells.alias("value")).unionByName(head), path)
    ds = text.read_samples(spark, path)
    fmt = ds.info["format"]
    df = ds.df.select("ix", "x", F.lit(fmt.header_rows).alias("header_rows"), F.lit(fmt.header_columns).alias("header_columns"), F.lit(fmt.separator).alias("separator"))
    return long_x(df, "ix", "header_rows", "header_columns", "separator")


@query("read_side_files", """
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS ix FROM embeddings)
SELECT ix, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS y1, CASE WHEN ix % 7 <> 0 THEN round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 END AS y2,
  CAST(label AS VARCHAR) AS layer1, CASE WHEN ix % 3 = 0 THEN '' ELSE 'g' || ix % 4 END AS layer2,
  CAST(CASE WHEN ix % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS mark FROM ranked""")
def read_side_files(spark, folder):
    """Responses with a header line and the wrong separator asked for, class layers of unequal number, and a selection."""
    df = spectra(spark, folder).df
    n = df.count()
    a, b, c = (_folder(spark, name) for name in ("responses", "classes", "selection"))
    y = F.concat_ws("\t", F.get("x", F.lit(0)).cast("string"), F.when(F.col("ix") % 7 != 0, F.get("x", F.lit(1)).cast("string")).otherwise("none"))
    head = spark.range(-1, 0).select(F.col("id").alias("ix"), F.lit("first\tsecond").alias("value"))
    _one_file(df.select("ix", y.alias("value")).unionByName(head), a)
    _one_file(df.select("ix", F.concat_ws(",", "label", F.when(F.col("ix") % 3 != 0, F.concat(F.lit("g"), (F.col("ix") % 4).cast("string")))).alias("value")), b)
    _one_file(df.select("ix", F.when(F.col("ix") % 5 == 0, "2").otherwise("1").alias("value")), c)
    responses, _ = text.read_responses(spark, a, samples=n, separator="comma")
    second = F.get("y", F.lit(1))
    out = responses.join(text.read_classes(spark, b), "ix").join(text.read_selection(spark, c, n), "ix")
    return out.select("ix", r6(F.get("y", F.lit(0))).alias("y1"), r6(F.when(~F.isnan(second), second)).alias("y2"),
                      F.get("classes", F.lit(0)).alias("layer1"), F.get("classes", F.lit(1)).alias("layer2"), "mark")


@query("stream_scores", f"""
WITH {LONG} SELECT vec_id, pos, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10), 6) + 0.0 AS value
FROM long WINDOW w AS (PARTITION BY vec_id)""")
def stream_scores(spark, folder):
    """SNV of arriving spectra as a stream; the table is the stream's backlog."""
    source = table(spark, folder, "embeddings")
    stream = scoring.table_stream(spark, f"{folder}/embeddings.parquet", source.schema)
    samples = stream.select(F.col("vec_id").alias("ix"), F.col("embedding").cast("array<double>").alias("x"))
    ds = spectra(spark, folder)
    scored = scoring.score_stream(samples, lambda df: preprocess.snv(ds.with_df(df)).df)
    path = _folder(spark, "scores")
    started = scoring.write_scores(scored, path, uuid.uuid4().hex, available_now=True)
    started.awaitTermination()
    return long_x(spark.read.parquet(path).withColumnRenamed("ix", "vec_id"), "vec_id")


@query("saved_model_scores")
def saved_model_scores(spark, folder):
    """A scaling and a principal component model are saved, loaded and applied to a stream."""
    ds = spectra(spark, folder)
    scaled, scale = preprocess.scale(ds, "autoscale")
    path = _folder(spark, "saved")
    models.save_model(spark, [scale, latent.pca(scaled, 3)], path)
    scale, model = models.load_model(spark, path)
    stream = scoring.table_stream(spark, f"{folder}/embeddings.parquet", table(spark, folder, "embeddings").schema)
    samples = stream.select(F.col("vec_id").alias("ix"), F.col("embedding").cast("array<double>").alias("x"))
    out = _folder(spark, "scores")
    scoring.write_scores(scoring.score_stream(samples, scale.transform, model.transform), out, uuid.uuid4().hex,
                         available_now=True).awaitTermination()
    done = spark.read.parquet(out)
    return done.select(F.col("ix").alias("vec_id"), r6("t2").alias("t2"), r6("q").alias("q"))


@query("output_table", f"""
WITH {LONG} SELECT vec_id, round(max(v) FILTER (pos = 0), 3) + 0.0 AS x_1, round(max(v) FILTER (pos = 1), 3) + 0.0 AS x_2,
round(max(v) FILTER (pos = 2), 3) + 0.0 AS x_3 FROM long GROUP BY vec_id""")
def output_table(spark, folder):
    """The report table: first values of each sample at three decimals."""
    df = spectra(spark, folder).df.select(F.col("ix").alias("vec_id"), "x")
    out = tables.output_table(df, ["vec_id", "x"], max_cols=4, decimals=3)
    return out.select("vec_id", *[(F.col(f"x_{i}") + 0.0).alias(f"x_{i}") for i in (1, 2, 3)])


