"""Delimited text files of measurements: detection, layouts, tensors, responses and labels.

Two kinds of files, two scans of the data source in ``files``. A file that is one sample is bounded by the sample
and becomes a tensor in the task that reads it. A file whose rows are samples may be of any size and is read by line,
a slice of bytes a task. Detection reads the first file only. Paths in stores that only Spark opens are read by its
text source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Axis, Dataset
from ..operators.ordering import with_index
from ..operators.selection import extract_columns
from ..session import durable
from . import files as source

_SEPARATORS = {"comma": ",", "tabs": "\t", "spaces": r"\s+"}
_HEAD_ROWS = 30          # rows looked at for header columns
_NUMERIC_SHARE = 0.6     # share of numeric tokens that makes a line data
LAYOUTS = ("x_vector", "xy_vector", "xyz_vector", "x_matrix", "xy_matrix")


@dataclass(frozen=True)
class Format:
    separator: str = "auto"        # auto, comma, tabs, spaces
    header_rows: int | None = None
    header_columns: int | None = None
    layout: str = "auto"


# --- expressions --------------------------------------------------------------------------

def tokens(line: Column, separator: str) -> Column:
    text = F.trim(line) if separator == "spaces" else F.rtrim(line)
    return F.transform(F.split(text, _SEPARATORS[separator]), lambda t: F.trim(t))


def number(token: Column) -> Column:
    """A token as a number; anything else is NaN."""
    return F.coalesce(token.try_cast("double"), F.lit(float("nan")))


def _is_number(token: Column) -> Column:
    return token.try_cast("double").isNotNull()


def numeric_share(line: Column, separator: str) -> Column:
    found = F.filter(tokens(line, separator), lambda t: t != "")
    return F.size(F.filter(found, _is_number)) / F.greatest(F.size(found), F.lit(1))


def separator_of(line: Column) -> Column:
    """Tab if there is one, else comma, else spaces."""
    text = F.trim(line)
    return F.when(text.contains("\t"), "tabs").when(text.contains(","), "comma").otherwise("spaces")


# --- scans --------------------------------------------------------------------------------

def _local_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "/")


def _listed(paths) -> list[str]:
    if isinstance(paths, str):
        paths = paths.split(";")
    return [p.strip() for p in paths if p and p.strip()]


def _numbered_files(df: DataFrame, paths: list[str]) -> DataFrame:
    """``file_no`` in the given order; inside a folder or pattern, in path order."""
    spark = df.sparkSession
    known = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "_given int, _path string")
    exact = df.join(known, F.col("file_path") == F.col("_path"), "left")
    return exact.drop("_path").withColumn("file_no", F.coalesce("_given", F.lit(len(paths)))).drop("_given")


def scan_lines(spark: SparkSession, paths, head: bool = False) -> DataFrame:
    """(file_path, file_no, line_no, value) and file facts; ``head``: of the first file only."""
    return source.numbered_lines(spark, paths, head) if source.known(paths) else _first_only(spark, paths, head)


def _ordered_lines(spark: SparkSession, paths, head: bool = False) -> DataFrame:
    """As ``scan_lines`` in one scan: line numbers grow along a file and are true in its first slice, which holds the header."""
    return source.lines(spark, paths, head) if source.known(paths) else _first_only(spark, paths, head)


def _first_only(spark: SparkSession, paths, head: bool) -> DataFrame:
    lines = _spark_lines(spark, paths)
    if not head:
        return lines
    first = lines.agg(F.min(F.struct("file_no", "file_path")).alias("f")).first()["f"]
    return lines.filter(F.col("file_path") == first["file_path"]) if first else lines


def _spark_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines by Spark's text source: within a split the running id grows by one per line; the table of splits is small."""
    paths = _listed(paths)
    raw = spark.read.text(paths).select(
        "value", _local_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"), F.lit(None).cast("timestamp").alias("created"),
        F.monotonically_increasing_id().alias("_id"))
    splits = sorted((r["file_path"], r["_start"], r["first"], r["n"]) for r in raw.groupBy("file_path", "_start").agg(
        F.min("_id").alias("first"), F.count("*").alias("n")).collect())
    offsets, last, before = [], None, 0
    for path, start, first, n in splits:
        before = before if path == last else 0
        offsets.append((path, start, before - first))
        last, before = path, before + n
    table = spark.createDataFrame(offsets, "file_path string, _start long, _shift long")
    # one row per input split; the planner decides how to join it
    numbered = raw.join(table, ["file_path", "_start"]).withColumn("line_no", F.col("_id") + F.col("_shift"))
    return _numbered_files(numbered.drop("_id", "_shift", "_start"), paths)


def scan_files(spark: SparkSession, paths) -> DataFrame:
    """(file_path, file_no, value) with the whole content of each file."""
    if source.known(paths):
        return source.contents(spark, paths).drop("created")
    paths = _listed(paths)
    raw = spark.read.text(paths, wholetext=True).select(
        "value", _local_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"))
    return _numbered_files(raw, paths)


# --- detection ----------------------------------------------------------------------------

def detect(lines: DataFrame, fmt: Format = Format(), ways: int = 1) -> Format:
    """Fill in what ``fmt`` leaves open, from the first file (``lines`` of ``scan_lines`` with ``head``)."""
    own = lines.filter(F.trim("value") != "")
    separator = fmt.separator
    head = own.agg(F.min_by(separator_of(F.col("value")), "line_no").alias("s"), F.count("*").alias("n")).first()
    if not head["n"]:
        raise ValueError("there is nothing to read")
    if separator == "auto":
        separator = head["s"] or "comma"
    rows = fmt.header_rows
    if rows is None:
        rows = own.filter(numeric_share(F.col("value"), separator) >= _NUMERIC_SHARE).agg(
            F.min("line_no").alias("n")).first()["n"] or 0
    data = own.filter(F.col("line_no") >= rows)
    columns = fmt.header_columns
    if columns is None:
        place = F.array_position(F.transform(tokens(F.col("value"), separator), _is_number), True)
        heads = (data.select("line_no", place.alias("p")).filter("p > 0").orderBy("line_no").limit(_HEAD_ROWS)
                 .groupBy("p").agg(F.count("*").alias("n"), F.min("line_no").alias("f")))
        best = heads.agg(F.max_by("p", F.struct("n", -F.col("f"))).alias("p")).first()["p"]
        columns = int(best) - 1 if best else 0
    layout = fmt.layout
    if layout == "auto":
        layout = _infer_layout(data, separator, columns, ways)
    return Format(separator, int(rows), columns, layout)


def _infer_layout(data: DataFrame, separator: str, skip: int, ways: int) -> str:
    """Layout from the shape and from monotone leading columns of the first file."""
    cells = F.transform(F.slice(tokens(F.col("value"), separator), skip + 1, 1 << 30), number)
    table = data.select("line_no", cells.alias("c"))
    shape = table.agg(F.count("*").alias("rows"), F.max(F.size("c")).alias("cols")).first()
    rows, cols = shape["rows"], shape["cols"] or 0
    if rows <= 1:
        return {2: "xy_vector", 3: "xyz_vector"}.get(cols, "x_vector")
    if cols <= 1:
        return "x_vector"
    rising = lambda i: _monotone(table, i)
    if cols == 2 and rising(0):
        return "xy_vector"
    if ways > 1 and cols == 3 and rising(0) and rising(1):
        return "xyz_vector"
    if ways == 2 and cols >= 4:
        seen = table.select([F.max((~F.isnan(F.get("c", F.lit(i)))).cast("int")).alias(f"s{i}") for i in range(cols)]).first()
        used = [i for i in range(cols) if seen[f"s{i}"]]
        axes = used[0::2]
        if len(used) >= 4 and len(used) % 2 == 0:
            gap = lambda a, b: (F.abs(F.get("c", F.lit(a)) - F.get("c", F.lit(b))) <=
                                1e-8 + 1e-5 * F.abs(F.get("c", F.lit(b)))) | (F.isnan(F.get("c", F.lit(a))) & F.isnan(F.get("c", F.lit(b))))
            same = table.agg(*[F.bool_and(gap(a, axes[0])).alias(f"e{a}") for a in axes[1:]]).first()
            if all(same) and rising(axes[0]):
                return "xy_matrix"
    return "x_matrix"


def _monotone(table: DataFrame, column: int) -> bool:
    """At least three finite values that never fall, or never rise; steps need no sort of the file:
    neighbours meet through a lag over blocks of line positions."""
    from ..operators.ordering import block_window, halo_blocks, own_rows
    values = table.select(F.get("c", F.lit(column)).alias("v"), "line_no").filter(~F.isnan("v"))
    indexed, n = with_index(values, ["line_no"])
    if n < 3:
        return False
    step = F.col("v") - F.lag("v").over(block_window())
    steps = own_rows(halo_blocks(indexed, before=1).withColumn("step", step))
    r = steps.agg(F.min("step").alias("low"), F.max("step").alias("high")).first()
    return bool(r["low"] >= 0 or r["high"] <= 0)


# --- layouts ------------------------------------------------------------------------------

def _meta(mode: str) -> Column:
    return F.struct(F.lit(mode).alias("source_mode"), F.col("file_path"), F.col("file_size"),
                    F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_time"),
                    F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created_time"),
                    F.col("ix").alias("sample_index"),
                    F.col("_row").cast("long").alias("row_in_file"))


def _stem() -> Column:
    name = F.element_at(F.split("file_path", "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def read_samples(spark: SparkSession, paths, fmt: Format = Format(), ways: int = 1, dims: tuple[int, ...] | None = None,
                 transpose: bool = False, order: str = "F", pad: float = float("nan"), files_per_sample: int = 1,
                 y=None, classes=None, label=None) -> Dataset:
    """Load measurement files as a dataset.

    ``ways`` = 1 gives spectra; more ways give tensors, one file (or ``files_per_sample`` files)
    per sample. ``y``, ``classes`` and ``label`` name 1-based columns to take out of row files.
    """
    fmt = detect(_ordered_lines(spark, paths, head=True), fmt, ways)
    if fmt.layout not in LAYOUTS:
        raise ValueError(f"unknown layout {fmt.layout}")
    if ways == 1 and fmt.layout == "x_matrix" and not transpose:
        ds = _row_samples(spark, paths, fmt)
        return extract_columns(ds, y, classes, label) if (y or classes or label) else ds
    if ways == 1 and fmt.layout == "xy_matrix":
        raise ValueError("xy_matrix holds two-way samples")
    return _file_samples(spark, paths, fmt, ways, dims, transpose, order, pad, files_per_sample)


def _row_samples(spark, paths, fmt) -> Dataset:
    """Every line is a sample; short lines are filled with NaN."""
    lines = _ordered_lines(spark, paths).filter((F.col("line_no") >= fmt.header_rows) & (F.trim("value") != ""))
    cells = F.transform(F.slice(tokens(F.col("value"), fmt.separator), fmt.header_columns + 1, 1 << 30), number)
    table, _ = with_index(lines.withColumn("x", cells).drop("value"), ["file_no", "file_path", "line_no"])
    facts = table.agg(F.max(F.size("x")).alias("w")).first()
    width = facts["w"] or 0
    first = table.groupBy("file_path").agg(F.min("ix").alias("_first"))
    table = table.join(first, "file_path").withColumn("_row", F.col("ix") - F.col("_first") + 1)
    padded = F.concat("x", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("x")))
    df = table.select("ix", padded.alias("x"), F.concat_ws("_", _stem(), F.col("_row").cast("string")).alias("label"),
                      _meta("matrix_rows").alias("meta"))
    return Dataset(df, (width,), axes=(Axis(tuple(float(i + 1) for i in range(width)),
                                            tuple(f"V{i + 1}" for i in range(width))),), info={"format": fmt})


def _file_samples(spark, paths, fmt, ways, dims, transpose, order, pad, files_per_sample) -> Dataset:
    matrix = fmt.layout in ("x_matrix", "xy_matrix")
    if ways > 1 and not matrix and dims is None:
        raise ValueError("vector files of tensors need dimensions")
    if files_per_sample > 1:
        outer = dims[2 if matrix else 1:]
        if prod(outer) != files_per_sample:
            raise ValueError(f"dimensions {dims} need {prod(outer)} files per sample")
    spec = {"separator": fmt.separator, "header_rows": fmt.header_rows, "header_columns": fmt.header_columns, "layout": fmt.layout,
            "transpose": bool(transpose and matrix), "dims": list(dims) if dims and ways > 1 else None, "order": order, "files": files_per_sample}
    files = source.tensors(spark, paths, spec) if source.known(paths) else _spark_tensors(spark, paths, spec)
    files = durable(files)
    if ways == 1 and matrix:  # transposed matrix files: their columns are samples
        rows = F.transform(F.sequence(F.lit(0), F.get("shape", F.lit(0)) - 1),
                           lambda i: F.slice("x", i * F.get("shape", F.lit(1)) + 1, F.get("shape", F.lit(1))))
        files = files.filter(F.get("shape", F.lit(0)) > 0).select("*", F.posexplode(rows).alias("_at", "_sample"))
        table, _ = with_index(files.drop("ix", "x", "real", "shape").withColumnRenamed("_sample", "x").withColumn("_row", F.col("_at") + 1),
                              ["file_no", "file_path", "_at"])
        width = table.agg(F.max(F.size("x")).alias("w")).first()["w"] or 0
        padded = F.concat("x", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("x")))
        df = table.select("ix", padded.alias("x"), F.concat_ws("_", _stem(), F.col("_row").cast("string")).alias("label"),
                          _meta("matrix_rows").alias("meta"))
        return Dataset(df, (width,), axes=(_plain_axis(width),), info={"format": fmt})
    files = files.withColumn("_row", F.lit(1))
    if files_per_sample > 1:
        df = files.select("ix", "x", F.concat(F.lit("Sample_"), (F.col("ix") + 1).cast("string")).alias("label"), _meta("multi_file").alias("meta"))
        return Dataset(df, tuple(dims), axes=tuple(_plain_axis(d) for d in dims), info={"format": fmt})
    side = lambda k: F.get("shape", F.lit(k))
    most = files.agg(*[f(side(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("low", F.min), ("high", F.max))],
                     F.max(F.col("real").isNotNull()).alias("ragged")).first()
    if ways > 1 and not matrix:
        return _finish(files, F.col("x"), tuple(dims), fmt, None)
    if ways == 1:
        if most["low0"] != most["high0"]:
            raise ValueError("vector files have different lengths")
        return _finish(files, F.col("x"), (most["high0"],), fmt, None)
    # matrices: pad to the largest and remember what was real
    r, c = most["high0"], most["high1"]
    ragged = bool(most["ragged"]) or most["low0"] != r or most["low1"] != c
    if not ragged:
        return _finish(files, F.col("x"), (r, c), fmt, None)
    return _finish(_padded(files, r, c, float(pad)), F.col("x"), (r, c), fmt, F.col("mask"))


def _padded(files: DataFrame, r: int, c: int, pad: float) -> DataFrame:
    """``files`` with x and mask as r x c matrices."""
    schema = T.StructType([*files.drop("real", "shape").schema.fields, T.StructField("mask", T.ArrayType(T.BooleanType()))])

    def run(batches):
        for batch in batches:
            xs, masks = [], []
            for shape, x, real in zip(batch.column("shape").to_pylist(), batch.column("x"), batch.column("real")):
                own = np.full((r, c), pad)
                mask = np.zeros((r, c), bool)
                here = np.asarray(x.values).reshape(shape) if len(x) else np.empty(shape)
                kept = np.asarray(real.values.to_numpy(zero_copy_only=False)).reshape(shape) if real.is_valid else np.ones(shape, bool)
                own[:shape[0], :shape[1]] = np.where(kept, here, pad)
                mask[:shape[0], :shape[1]] = kept
                xs.append(own.reshape(-1))
                masks.append(mask.reshape(-1))
            columns = [pa.array(xs, pa.list_(pa.float64())) if f.name == "x" else pa.array(masks, pa.list_(pa.bool_())) if f.name == "mask"
                       else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files.mapInArrow(run, schema)


def _spark_tensors(spark, paths, spec: dict) -> DataFrame:
    """Samples of one file each, by Spark's binary files."""
    if spec["files"] > 1:
        raise ValueError("several files per sample are read from stores that Arrow opens")
    raw = spark.read.format("binaryFile").load(_listed(paths)).select(
        "content", _local_path(F.col("path")).alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    files, _ = with_index(_numbered_files(raw, _listed(paths)), ["file_no", "file_path"])
    keep = ["ix", "file_no", "file_path", "file_size", "modified"]

    def run(batches):
        for batch in batches:
            made = [source.file_matrix(c.as_buffer().to_pybytes().decode("utf-8", "replace"), spec) for c in batch.column("content")]
            built = [source.stacked([x], spec) for x, _ in made]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array([list(t.shape) for t in built], pa.list_(pa.int32())),
                 pa.array([t.reshape(-1) for t in built], pa.list_(pa.float64())),
                 pa.array([None if real is None else real.reshape(-1) for _, real in made], pa.list_(pa.bool_()))], names=[*keep, "shape", "x", "real"])

    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", shape array<int>, x array<double>, real array<boolean>"
    return files.select(*keep, "content").mapInArrow(run, ddl).withColumn("created", F.lit(None).cast("timestamp"))


def _plain_axis(size: int) -> Axis:
    return Axis(tuple(float(i + 1) for i in range(size)), tuple(f"V{i + 1}" for i in range(size)))


def _finish(files, x, shape, fmt, mask) -> Dataset:
    columns = [F.col("ix"), x.alias("x"), _stem().alias("label"), _meta("file").alias("meta")]
    if mask is not None:
        columns.append(mask.alias("mask"))
    return Dataset(files.select(*columns), shape, axes=tuple(_plain_axis(s) for s in shape), info={"format": fmt})


# --- files beside the measurements --------------------------------------------------------

def _rows_of(spark, path, keep=None) -> tuple[DataFrame, int]:
    """Non-blank lines with dense positions."""
    lines = _ordered_lines(spark, path).filter(F.trim("value") != "")
    if keep is not None:
        lines = lines.filter(keep)
    return with_index(lines, ["file_no", "file_path", "line_no"])


def read_responses(spark: SparkSession, path, samples: int | None = None, names_in_file: bool = False,
                   separator: str = "auto") -> tuple[DataFrame, tuple[str, ...]]:
    """(ix, y) and response names. A separator that yields no number is detected again, and one
    leading row without numbers goes if it is exactly one row too many."""
    lines = _ordered_lines(spark, path).filter(F.trim("value") != "")
    head = lines.agg(F.min_by("value", "line_no").alias("v"), F.min("line_no").alias("n")).first()
    found = lines.agg(F.min_by(separator_of(F.col("value")), "line_no").alias("s")).first()["s"]
    asked = found if separator == "auto" else separator
    finite = lambda s: lines.agg(F.max(F.size(F.filter(tokens(F.col("value"), s), _is_number))).alias("n")).first()["n"]
    if asked != found and not finite(asked):
        asked = found
    names: tuple[str, ...] = ()
    if names_in_file:
        names = tuple(t for t in re.split({"comma": ",", "tabs": "\t"}.get(asked, r"\s+"), head["v"].strip()) if t.strip())
        lines = lines.filter(F.col("line_no") > head["n"])
    cells = F.transform(tokens(F.col("value"), asked), number)
    table, n = with_index(lines.withColumn("y", cells), ["file_no", "file_path", "line_no"])
    if not names_in_file and samples is not None and n == samples + 1:
        empty = table.filter(F.col("ix") == 0).select(F.forall("y", F.isnan).alias("e")).first()["e"]
        if empty:
            table = table.filter(F.col("ix") > 0).withColumn("ix", F.col("ix") - 1)
    width = table.agg(F.max(F.size("y")).alias("w")).first()["w"] or 0
    padded = F.concat("y", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("y")))
    names = tuple(names[i].strip() if i < len(names) else f"Y{i + 1}" for i in range(width))
    return table.select("ix", padded.alias("y")), names


def read_classes(spark: SparkSession, path) -> DataFrame:
    """(ix, classes): one or more layers per line, short lines filled with ''."""
    table, _ = _rows_of(spark, path)
    line = F.trim("value")
    split = F.when(line.contains(","), F.split(line, ",")).when(line.contains("\t"), F.split(line, "\t")) \
        .otherwise(F.split(line, r"\s+"))
    table = table.withColumn("c", F.filter(F.transform(split, lambda t: F.trim(t)), lambda t: t != "")).filter(F.size("c") > 0)
    width = table.agg(F.max(F.size("c")).alias("w")).first()["w"] or 1
    return table.select("ix", F.concat("c", F.array_repeat(F.lit(""), F.lit(width) - F.size("c"))).alias("classes"))


def read_labels(spark: SparkSession, path) -> DataFrame:
    table, _ = _rows_of(spark, path)
    return table.select("ix", F.trim("value").alias("label"))


def read_selection(spark: SparkSession, path, samples: int) -> DataFrame:
    """(ix, mark): 1 = calibration, 2 = validation, one line per sample."""
    lines = _ordered_lines(spark, path)
    table, n = with_index(lines, ["file_no", "file_path", "line_no"])
    if n != samples:
        raise ValueError(f"the selection has {n} lines for {samples} samples")
    return table.select("ix", F.trim("value").cast("int").alias("mark"))


def attach(ds: Dataset, responses=None, classes=None, labels=None) -> Dataset:
    """Join side files by position. ``responses`` is what ``read_responses`` gives."""
    df, names = ds.df, ds.y_names
    if responses is not None:
        frame, names = responses
        df = df.drop("y").join(frame, "ix", "left")
    if classes is not None:
        df = df.drop("classes").join(classes, "ix", "left")
    if labels is not None:
        df = df.drop("label").join(labels, "ix", "left")
    return ds.with_df(df, y_names=tuple(names))


def read_axis(spark: SparkSession, path) -> Axis:
    """Axis labels, one or more per line; numbers become the numeric axis as well."""
    table, _ = _rows_of(spark, path)
    words = [w for r in table.orderBy("ix").select("value").collect() for w in re.split(r"[\t,\s]+", r["value"].strip()) if w]
    try:
        numbers = tuple(float(w) for w in words)
    except ValueError:
        numbers = None
    return Axis(numbers, tuple(words), "Continuous" if numbers else "Discrete")


def spaced_axis(start: float, end: float, size: int, scale: str = "Linear") -> Axis:
    """Evenly spaced values, linear or in a logarithm; a logarithm needs positive ends."""
    base = {"Log10": 10.0, "Log2": 2.0, "Ln": float(np.e)}.get(scale)
    if base is None or start <= 0 or end <= 0:
        values = np.linspace(start, end, size)
    else:
        values = base ** (np.linspace(np.log(start) / np.log(base), np.log(end) / np.log(base), size))
    return Axis(tuple(float(v) for v in values), tuple(f"{v:g}" for v in values))


def axis_expression(start: float, end: float, size: int) -> Column:
    """The linear axis as an array column."""
    step = (end - start) / max(size - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lit(float(start)) + i * F.lit(step))
