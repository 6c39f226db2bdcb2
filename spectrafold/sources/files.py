"""Measurement files as a Spark data source: planned by file and slice, parsed where they are read.

``measurement_lines`` gives the lines of files of any length: a long file is cut into slices of bytes, and a slice
begins with the first line that starts in it. ``measurement_contents`` gives whole files. ``measurement_tensors`` gives a row for each sample that is a file or an
equal number of files: the task that reads the files also builds the tensor, so neither cells nor files are shuffled.
Small files share a task up to ``PACK`` bytes, each counted with ``OPEN`` bytes more for opening it. Planning lists the files
and nothing else, and of a local folder only what leads to the first file where no other is asked for.

Files are opened by the file systems of Arrow (local, hdfs, s3, gs, abfs); ``known`` says whether a path has one.
``write_each`` writes such files in tasks of Spark by the same file systems.
"""

from __future__ import annotations

import fnmatch
import heapq
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLICE = 64 << 20  # bytes of a long file that one task reads
PACK = 32 << 20  # bytes of small files in one task
OPEN = 64 << 10  # bytes that could be read while a file is opened: 512 small files in one task
BATCH = 4 << 20  # bytes of small files in one batch of rows
PIECE = 4 << 20  # bytes read at once
SLICES = 200_000  # line counts that may be broadcast, some 10 MB
BEYOND = 1 << 40  # line numbers after a file's first slice: this and the byte at which the line starts
SPLIT = {"comma": ",", "tabs": "\t", "spaces": None}
_SCHEMES = ("file", "hdfs", "s3", "gs", "abfs")


def listed(paths) -> list[str]:
    if isinstance(paths, str):
        paths = paths.split(";")
    return [p.strip() for p in paths if p and p.strip()]


def known(paths) -> bool:
    """Whether all paths lie in stores that Arrow opens itself."""
    return all((m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", p)) is None or m[1].lower() in _SCHEMES for p in listed(paths))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Found:
    """A file: its place in the order of all, where it is, its size and times."""

    number: int
    given: str
    path: str
    size: int
    modified: float | None
    created: float | None


def _first_inside(folder: str) -> str | None:
    """The first file of a local folder in path order."""
    with os.scandir(folder) as entries:
        inside = [(e.name + "/" * e.is_dir(), e.path) for e in entries if e.name[:1] not in "._"]
    heapq.heapify(inside)
    while inside:
        name, path = heapq.heappop(inside)
        first = _first_inside(path) if name.endswith("/") else path if os.path.isfile(path) else None
        if first:
            return first
    return None


def first_found(paths) -> list[Found]:
    """The first of the files of the paths, if there is one."""
    for given in listed(paths):
        store, path = _opened(given)
        if isinstance(store, fs.LocalFileSystem) and os.path.isdir(path):
            first = _first_inside(path)
            if first is None:
                continue
            info, times = store.get_file_info(first), os.stat(first)
            return [Found(0, given, first, info.size, info.mtime.timestamp(), times.st_ctime)]
        files = found([given])
        if files:
            return [files[0]]
    return []


def packed(items: list, size) -> list[Part]:
    """Small items in parts of up to ``PACK`` bytes with those for opening; ``size`` gives an item's files and bytes."""
    parts, pack, held = [], [], 0
    for item in items:
        n, own = size(item)
        if pack and held + own + n * OPEN > PACK:
            parts.append(Part(pack))
            pack, held = [], 0
        pack.append(item)
        held += own + n * OPEN
    return parts + ([Part(pack)] if pack or not parts else [])


def found(paths) -> list[Found]:
    """The files of the paths in the given order; those of a folder or a pattern in path order."""
    out: list[Found] = []
    for given in listed(paths):
        store, path = _opened(given)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            infos = [info]
        else:
            base, pattern = path, None
            if info.type == fs.FileType.NotFound:
                parts = path.split("/")
                k = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), None)
                if k is None:
                    raise FileNotFoundError(given)
                base, pattern = "/".join(parts[:k]) or "/", path
            inside = store.get_file_info(fs.FileSelector(base, recursive=True))
            hidden = lambda p: re.search(r"/[._]", p[len(base.rstrip("/")):]) is not None
            infos = sorted((i for i in inside if i.type == fs.FileType.File and not hidden(i.path)
                            and (pattern is None or fnmatch.fnmatch(i.path, pattern) or fnmatch.fnmatch(i.path, pattern.rstrip("/") + "/*"))),
                           key=lambda i: i.path)
        for i in infos:
            created = os.stat(i.path).st_ctime if isinstance(store, fs.LocalFileSystem) else None
            out.append(Found(len(out), given, i.path, i.size, None if i.mtime is None else i.mtime.timestamp(), created))
    return out


@dataclass
class Part(InputPartition):
    """What a task reads: (file, first byte, last byte), or groups of files of one sample each."""

    files: list = field(default_factory=list)

    def __init__(self, files):
        super().__init__(None)
        self.files = files


# -- parsing -----------------------------------------------------------------------------

def tokens(line: str, separator: str) -> list[str]:
    mark = SPLIT[separator]
    return [t.strip() for t in line.rstrip().split(mark)] if mark else line.split()


def number(token: str) -> float:
    """A token as a number; anything else is NaN."""
    try:
        return float(token) if "_" not in token else float("nan")
    except ValueError:
        return float("nan")


def matrix(lines: list[str], separator: str, skip: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The numbers of lines, short ones filled with NaN, and which cells a line has (None: all)."""
    if not lines:
        return np.empty((0, 0)), None
    mark = SPLIT[separator]
    width = lines[0].rstrip().count(mark) + 1 if mark else len(lines[0].split())
    text = "\n".join(lines)
    if not skip and "_" not in text:
        # all lines alike and every token a number
        flat = (text.replace(mark, " ") if mark else text).split()
        if len(flat) == width * len(lines) and (not mark or all(line.count(mark) == width - 1 for line in lines)):
            try:
                return np.array(flat, dtype=np.float64).reshape(len(lines), width), None
            except ValueError:
                pass
    rows = [[number(t) for t in tokens(line, separator)[skip:]] for line in lines]
    width = max(map(len, rows))
    out, real = np.full((len(rows), width), np.nan), np.zeros((len(rows), width), bool)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
        real[i, :len(row)] = True
    return out, None if real.all() else real


def _time(stamp: float | None) -> datetime | None:
    return None if stamp is None else datetime.fromtimestamp(stamp, timezone.utc)


# -- lines -------------------------------------------------------------------------------

LINES = pa.schema([("file_no", pa.int32()), ("file_path", pa.string()), ("file_size", pa.int64()), ("modified", pa.timestamp("us", "UTC")),
                   ("created", pa.timestamp("us", "UTC")), ("slice", pa.int64()), ("place", pa.int64()), ("line_no", pa.int64()), ("value", pa.string())])
_LINES_DDL = ("file_no int, file_path string, file_size long, modified timestamp, created timestamp, slice long, place long, line_no long, "
              "value string")


def sliced_lines(file: Found, first: int, last: int) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of the lines that start in the bytes first..last of a file, piece by piece."""
    store, path = _opened(file.given) if file.given and not re.search(r"[*?\[]", file.given) else _opened(file.path)
    at, count = first, 0
    with store.open_input_file(file.path) as source:
        held = b""
        if first:  # the line that a slice begins within belongs to the slice before
            source.seek(first - 1)
            at = first - 1
            while b"\n" not in held:
                more = source.read(PIECE)
                if not more:
                    return
                if b"\n" not in more:
                    at += len(more)
                    if at > last:
                        return
                    continue
                cut = more.index(b"\n") + 1
                at += cut
                held = more[cut:]
                break
        begin = at  # byte at which ``held`` starts
        while begin < last:
            more = source.read(PIECE)
            held += more
            done = not more
            end = len(held) if done else held.rfind(b"\n") + 1
            if not end:
                if done:
                    return
                continue
            block, held = held[:end], held[end:]
            lines = block.split(b"\n")
            if block.endswith(b"\n"):
                lines.pop()
            starts, here = [], begin
            for line in lines:
                starts.append(here)
                here += len(line) + 1
            kept = sum(s < last for s in starts)
            numbers = [count + i for i in range(kept)] if not first else [BEYOND + s for s in starts[:kept]]
            count += kept
            yield numbers, [line.rstrip(b"\r").decode("utf-8", "replace") for line in lines[:kept]]
            begin += end
            if done:
                return


class LineSource(DataSource):
    @classmethod
    def name(cls):
        return "measurement_lines"

    def schema(self):
        return _LINES_DDL

    def reader(self, schema):
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.slice = int(options.get("slice", SLICE))
        self.head = options.get("head", "false") == "true"

    def partitions(self):
        files = first_found(self.paths) if self.head else found(self.paths)
        long = [Part([(f, a, min(a + self.slice, f.size))]) for f in files if f.size > self.slice for a in range(0, f.size, self.slice)]
        small = [(f, 0, f.size) for f in files if f.size <= self.slice]
        return long + packed(small, lambda part: (1, part[2])) if small or not long else long

    def read(self, partition):
        for f, first, last in partition.files:
            count = 0
            for numbers, values in sliced_lines(f, first, last):
                n = len(values)
                places = range(count, count + n)
                count += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.number] * n, pa.int32()), pa.array([f.path] * n), pa.array([f.size] * n, pa.int64()),
                     pa.array([_time(f.modified)] * n, LINES.field("modified").type), pa.array([_time(f.created)] * n, LINES.field("created").type),
                     pa.array([first] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(numbers, pa.int64()), pa.array(values, pa.string())],
                    schema=LINES)


# -- whole files -------------------------------------------------------------------------

CONTENTS = pa.schema([LINES.field(k) for k in ("file_no", "file_path", "file_size", "modified", "created", "value")])
_CONTENTS_DDL = "file_no int, file_path string, file_size long, modified timestamp, created timestamp, value string"


def _facts(files: list[Found], schema: pa.Schema) -> list[pa.Array]:
    """file_no, file_path, file_size, modified and created of files."""
    return [pa.array([f.number for f in files], pa.int32()), pa.array([f.path for f in files]), pa.array([f.size for f in files], pa.int64()),
            pa.array([_time(f.modified) for f in files], schema.field("modified").type),
            pa.array([_time(f.created) for f in files], schema.field("created").type)]


def _content(file: Found) -> str:
    store, _ = _opened(file.given if not re.search(r"[*?\[]", file.given) else file.path)
    with store.open_input_file(file.path) as source:
        return source.read().decode("utf-8", "replace")


class ContentSource(DataSource):
    @classmethod
    def name(cls):
        return "measurement_contents"

    def schema(self):
        return _CONTENTS_DDL

    def reader(self, schema):
        return ContentReader(self.options)


class ContentReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])

    def partitions(self):
        return packed(found(self.paths), lambda f: (1, f.size))

    def read(self, partition):
        held, size = [], 0
        for f in partition.files:
            held.append((f, _content(f)))
            size += f.size
            if size >= BATCH:
                yield self._rows(held)
                held, size = [], 0
        if held:
            yield self._rows(held)

    @staticmethod
    def _rows(held):
        return pa.RecordBatch.from_arrays([*_facts([f for f, _ in held], CONTENTS), pa.array([v for _, v in held], pa.string())], schema=CONTENTS)


# -- tensors -----------------------------------------------------------------------------

TENSORS = pa.schema([("ix", pa.int64()), ("file_no", pa.int32()), ("file_path", pa.string()), ("file_size", pa.int64()),
                     ("modified", pa.timestamp("us", "UTC")), ("created", pa.timestamp("us", "UTC")), ("shape", pa.list_(pa.int32())),
                     ("x", pa.list_(pa.float64())), ("real", pa.list_(pa.bool_()))])
_TENSORS_DDL = ("ix long, file_no int, file_path string, file_size long, modified timestamp, created timestamp, shape array<int>, "
                "x array<double>, real array<boolean>")


def file_matrix(content: str, spec: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """The numbers of a whole file as its layout has them, and which cells are real (None: all)."""
    lines = [line for line in content.replace("\r\n", "\n").split("\n")[spec["header_rows"]:] if line.strip()]
    table, real = matrix(lines, spec["separator"], spec["header_columns"])
    layout = spec["layout"]
    if layout == "x_vector":
        table = table[real] if real is not None else table
        return table.reshape(-1, 1), None
    if layout in ("xy_vector", "xyz_vector"):
        k = 1 if layout == "xy_vector" else 2
        return (table[:, k:k + 1] if table.shape[1] > k else np.full((len(table), 1), np.nan)), None
    if layout == "xy_matrix":
        table, real = table[:, 1::2], None if real is None else real[:, 1::2]
    if spec["transpose"]:
        table, real = table.T, None if real is None else real.T
    return table, None if real is None or real.all() else real


def stacked(parts: list[np.ndarray], spec: dict) -> np.ndarray:
    """One tensor from the files of a sample: their own ways first, the files over the ways behind."""
    dims, order = spec["dims"], spec["order"]
    if len(parts) == 1 and dims is None:
        return parts[0]
    if len(parts) == 1 and spec["layout"] not in ("x_matrix", "xy_matrix"):
        return parts[0].reshape(-1).reshape(dims, order=order)
    if len(parts) == 1:
        return parts[0]
    own = 2 if spec["layout"] in ("x_matrix", "xy_matrix") else 1
    out = np.empty(dims)
    for k, part in enumerate(parts):
        out[(slice(None),) * own + np.unravel_index(k, dims[own:], order=order)] = part.reshape(dims[:own])
    return out


class TensorSource(DataSource):
    @classmethod
    def name(cls):
        return "measurement_tensors"

    def schema(self):
        return _TENSORS_DDL

    def reader(self, schema):
        return TensorReader(self.options)


class TensorReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.spec = json.loads(options["paths"]), json.loads(options["spec"])

    def partitions(self):
        files, each = found(self.paths), self.spec["files"]
        if len(files) % each:
            raise ValueError(f"{len(files)} files do not divide into groups of {each}")
        groups = [(k // each, files[k:k + each]) for k in range(0, len(files), each)]
        return packed(groups, lambda group: (each, sum(f.size for f in group[1])))

    def read(self, partition):
        held, size = [], 0
        for ix, files in partition.files:
            parts, real = [], None
            for f in files:
                own, real = file_matrix(_content(f), self.spec)
                parts.append(own)
            tensor = stacked(parts, self.spec)
            held.append((ix, files[0], list(tensor.shape), tensor.reshape(-1), None if real is None or len(files) > 1 else real.reshape(-1)))
            size += tensor.nbytes
            if size >= BATCH:
                yield self._rows(held)
                held, size = [], 0
        if held:
            yield self._rows(held)

    @staticmethod
    def _rows(held):
        ix, files, shapes, tensors_, real = map(list, zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(ix, pa.int64()), *_facts(files, TENSORS), pa.array(shapes, pa.list_(pa.int32())),
             pa.array(tensors_, pa.list_(pa.float64())), pa.array(real, pa.list_(pa.bool_()))], schema=TENSORS)


def write_each(df: DataFrame, key: str, folder: str) -> None:
    """The lines ``value`` of each key as a file ``key=.../part-0.txt``, written by the tasks that hold them (all rows of a key in one)."""
    store, base = _opened(folder)
    store.create_dir(base, recursive=True)
    null = "__HIVE_DEFAULT_PARTITION__"

    def run(batches):
        last, out = None, None
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or name != last:
                    if out is not None:
                        out.close()
                    own, root = _opened(folder)
                    place = f"{root}/{key}={null if name is None else name}"
                    own.create_dir(place, recursive=True)
                    last, out = name, own.open_output_stream(f"{place}/part-0.txt")
                out.write(((value or "") + "\n").encode())
        if out is not None:
            out.close()
        yield from ()

    rows = df.sortWithinPartitions(key).select(F.col(key).cast("string").alias("k"), "value")
    rows.mapInArrow(run, "k string").write.format("noop").mode("overwrite").save()


def _session_slice(spark: SparkSession) -> int:
    """The session's bytes of a file partition."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes", str(SLICE)).strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else SLICE


def lines(spark: SparkSession, paths, head: bool = False, slice_bytes: int | None = None) -> DataFrame:
    """file_no, file_path, file_size, modified, created, slice (its first byte), place (within the slice), line_no, value of every line.

    line_no grows along a file; it is the line's number in the first slice, and ``BEYOND`` and a byte in later ones.
    ``head``: of the first file only.
    """
    spark.dataSource.register(LineSource)
    slice_bytes = slice_bytes or _session_slice(spark)
    return (spark.read.format("measurement_lines").option("paths", json.dumps(listed(paths))).option("head", str(head).lower())
            .option("slice", str(slice_bytes)).load())


def numbered_lines(spark: SparkSession, paths, head: bool = False) -> DataFrame:
    """``lines`` with true line numbers. Files of one slice have them; else the lines of each slice are counted.

    The counts, a row a slice, are broadcast while there are no more than ``SLICES``; the lines are then not shuffled.
    """
    rows, size = lines(spark, paths, head), _session_slice(spark)
    slices = [-(-f.size // size) for f in (first_found(paths) if head else found(paths))]
    if max(slices, default=0) <= 1:
        return rows
    counts = rows.groupBy("file_no", "slice").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each slice of a file
    before = W.partitionBy("file_no").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("file_no", "slice", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    shift = F.broadcast(shift) if sum(slices) <= SLICES else shift
    return rows.join(shift, ["file_no", "slice"]).withColumn("line_no", F.col("place") + F.col("_before")).drop("_before")


def contents(spark: SparkSession, paths) -> DataFrame:
    """A row for each file: file facts and its whole text as ``value``."""
    spark.dataSource.register(ContentSource)
    return spark.read.format("measurement_contents").option("paths", json.dumps(listed(paths))).load()


def tensors(spark: SparkSession, paths, spec: dict) -> DataFrame:
    """A row for each sample: ix, file facts, shape, x (C order) and, where cells are missing, real."""
    spark.dataSource.register(TensorSource)
    return (spark.read.format("measurement_tensors").option("paths", json.dumps(listed(paths))).option("spec", json.dumps(spec)).load())
