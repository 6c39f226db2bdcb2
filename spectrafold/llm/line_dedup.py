"""Removal of passages that repeat over the corpus, by the shortest runs of lines, compared in bytes.

A passage is a run of at least ``WINDOW`` lines and ``LEAST_BYTES`` bytes. The shortest such run from every line
on, and the shortest up to every line, are counted by digest over all documents. Any passage is covered
by those of them that lie inside it, so none depends on what stands around it. Where a digest
repeats, the run that comes first (smallest id, then first line) leads; every line of the others is compared
with its counterpart byte by byte, and runs of two and more equal lines are removed. Every removed line
so has an equal one earlier in the corpus. A single line that repeats between other lines stays.

Counts are combined before the shuffle; the join that brings leads back to their occurrences may be
split where a digest is hot, and lines of a lead with more than ``WIDE`` occurrences are compared in
``SALTS`` parts. Only lines of repeated runs are shuffled one by one; the texts themselves are
shuffled once, for the comparison and for the cut.

Results for odd input: a null text stays null and an empty one empty; a text whose lines all go
becomes empty and its row stays; rows that repeat id and text are one document and get the same
result; a null id comes last; an empty table gives an empty result; other columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .registry import query, table
from .textblocks import binary_column, blocks, plain, span_hashes

WINDOW = 2  # the least lines of a passage
LEAST_BYTES = 64  # shorter runs repeat by chance
WIDE, SALTS = 64, 32


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; a text has one line more than line feeds."""
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    end = offsets[row + 1].copy()
    inner = row[1:] == row[:-1]
    end[:-1][inner] = begin[1:][inner] - 1
    return begin, end, row


def line_runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Row, first line (a), line after the last (b) and digest of the shortest runs from and up to each line."""
    begin, end, row = line_bounds(data, offsets)
    value = span_hashes(data, begin, end)
    first = np.searchsorted(row, row)
    last = np.searchsorted(row, row, "right") - 1
    at = np.arange(len(begin))
    stops = np.maximum(np.searchsorted(end, begin + LEAST_BYTES), at + WINDOW - 1)
    starts = np.minimum(np.searchsorted(begin, end - LEAST_BYTES, "right") - 1, at - WINDOW + 1)
    ahead, back = stops <= last, starts >= first
    both = np.concatenate([np.column_stack([at, stops + 1])[ahead], np.column_stack([starts, at + 1])[back]])
    a, b = np.unique(both, axis=0).T if len(both) else (np.empty(0, np.int64),) * 2
    digest = np.column_stack([span_hashes(data, begin[a], end[b - 1]), span_hashes(value, a, b)]) if len(a) else np.empty((0, 2), np.uint64)
    return {"row": row[a], "a": a - first[a], "b": b - first[a], "digest": digest}


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns c0, c1 ... as in ``docs``, and key, a name that rows with equal id and text share."""
    name = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.unhex(name).alias("key"))
    return named.filter(F.col("key").isNotNull())


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = _named(docs, id_col, text_col)
    source = named.select(F.col(f"c{docs.columns.index(id_col)}").alias("doc_id"), "key", F.col(f"c{docs.columns.index(text_col)}").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in blocks(batch.column("text")):
                made = line_runs(data, offsets)
                at = pa.array(made["row"] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("key").take(at), binary_column(made["digest"], 16),
                     *(pa.array(made[c].astype(np.int64)) for c in ("a", "b"))],
                    names=["doc_id", "key", "digest", "a", "b"])

    return source.mapInArrow(run, f"doc_id {kind}, key binary, digest binary, a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of lines with one counterpart for each line, from the overlapping spans of a document."""
    schema = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("lead", pa.binary()), ("shift", pa.int64()),
                        ("wide", pa.bool_())])
    for batch in batches:
        made = []
        for key, spans in zip(batch.column("key").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            done = 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["stop"], s["lead"], s["shift"])):
                start = max(done, s["start"])
                if start < s["stop"]:
                    before = made[-1] if made else None
                    if before and (before["key"], before["stop"], before["lead"], before["shift"]) == (key, start, s["lead"], s["shift"]):
                        before["stop"] = s["stop"]
                        before["wide"] |= s["wide"]
                    else:
                        made.append(s | {"key": key, "start": start})
                    done = s["stop"]
        yield pa.RecordBatch.from_pylist(made, schema)


def _lines(text_at: str):
    """The wanted lines of each text: its own to be compared, and those that it lends as a lead."""
    schema = pa.schema([("lead", pa.binary()), ("place", pa.int64()), ("salt", pa.int32()), ("leads", pa.bool_()), ("key", pa.binary()),
                        ("line", pa.int64()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, wanted = plain(batch.column(text_at)), batch.column("key").to_pylist(), batch.column("wanted")
            made = []
            for i, key in enumerate(keys):
                lines = texts[i].as_py().split("\n")
                lent: dict[int, bool] = {}
                for w in wanted[i].as_py():
                    stop = min(w["stop"], len(lines))
                    for line in range(max(0, w["start"]), stop):
                        if w["lead"] is None:
                            lent[line] = lent.get(line, False) or w["wide"]
                        else:
                            salt = key[0] % SALTS if w["wide"] else 0
                            made.append((w["lead"], line + w["shift"], salt, False, key, line, lines[line]))
                for line, wide in lent.items():
                    made += [(key, line, salt, True, key, line, lines[line]) for salt in range(SALTS if wide else 1)]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], schema.types[c]) for c in range(7)], schema=schema)

    return run


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that equal their counterpart, from rows sorted so that the counterpart comes first."""
    group, content = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lead", "place", "salt", "leads", "key", "line", "content")]
        keys, lines = [], []
        for lead, place, salt, leads, key, line, own in zip(*columns, strict=True):
            if leads:
                group, content = (lead, place, salt), own
            elif (lead, place, salt) == group and own == content:
                keys.append(key)
                lines.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.int64())], names=["key", "line"])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of at least ``WINDOW`` lines among the equal lines of each document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        keys, cuts = [], []
        for key, lines in zip(batch.column("key").to_pylist(), batch.column("lines"), strict=True):
            at = np.unique(np.asarray(lines.values))
            edge = np.flatnonzero(np.diff(at) != 1)
            starts, stops = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)] + 1
            made = [{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= WINDOW]
            if made:
                keys.append(key)
                cuts.append(made)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(cuts, kind)], names=["key", "cuts"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key and cuts (ranges of lines to remove) of the documents that lose lines."""
    found = _occurrences(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "a", "b")
    whole = (found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
             .filter("first <> last"))  # places differ, so the run occurs twice
    hits = (found.join(whole.select("digest", "first", (F.col("n") > WIDE).alias("wide")), "digest")
            .filter((F.col("key") != F.col("first.key")) | (F.col("a") != F.col("first.a"))))
    span = F.struct(F.col("a").alias("start"), F.col("b").alias("stop"), F.col("first.key").alias("lead"),
                    (F.col("first.a") - F.col("a")).alias("shift"), "wide")
    spans = hits.groupBy("key").agg(F.collect_set(span).alias("spans"))
    own = durable(spans.mapInArrow(_runs, "key binary, start long, stop long, lead binary, shift long, wide boolean"))
    lent = own.select(F.col("lead").alias("key"), (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"),
                      F.lit(None).cast("binary").alias("lead"), F.lit(0).cast("long").alias("shift"), "wide").distinct()
    wanted = own.unionByName(lent).groupBy("key").agg(F.collect_list(F.struct("start", "stop", "lead", "shift", "wide")).alias("wanted"))
    texts = _named(docs, id_col, text_col).join(wanted, "key")
    lines = texts.mapInArrow(_lines(f"c{docs.columns.index(text_col)}"),
                             "lead binary, place long, salt int, leads boolean, key binary, line long, content string")
    lines = lines.repartition("lead", "place", "salt").sortWithinPartitions("lead", "place", "salt", F.col("leads").desc())
    same = lines.mapInArrow(_same, "key binary, line long").groupBy("key").agg(F.collect_list("line").alias("lines"))
    return same.mapInArrow(_cuts, "key binary, cuts array<struct<start:bigint,stop:bigint>>")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                        counted: bool = False) -> DataFrame:
    """``docs`` without the repeated lines, ``chars_col`` (if there is one) renewed where lines went.

    ``counted`` adds n_lines and n_removed.
    """
    # the comparison reads the same columns, so that one shuffle of the texts serves both
    rows = _named(docs, id_col, text_col).join(repeated_lines(docs, id_col, text_col), "key", "left")
    whole = F.col(f"c{docs.columns.index(text_col)}")
    lines = F.split(whole, "\n", -1)
    cut = F.col("cuts").isNotNull()
    stay = F.when(cut, F.filter(lines, lambda line, i: ~F.exists("cuts", lambda c: (c["start"] <= i) & (i < c["stop"]))))
    out = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"c{i}")
        if c == text_col:
            value = F.when(cut, F.array_join("stay", "\n")).otherwise(value)
        elif c == chars_col:
            value = F.when(cut, F.length(F.array_join("stay", "\n")).cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    if counted:
        total = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        out += [total.alias("n_lines"), F.when(cut, total - F.size("stay")).otherwise(0).cast("long").alias("n_removed")]
    return rows.withColumn("stay", stay).select(*out)


@query("op7_line_dedup")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, counted=True)
