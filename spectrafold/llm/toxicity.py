"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary documents and one that also
holds what windows of toxic documents have more often than chance. Every window of a text (a few
words) is compressed with both; the bytes that the toxic dictionary saves are its gain. Thresholds
on a document's gains are calibrated by a logistic fit on labelled documents that trained no
dictionary, weighted to the share of toxic documents among all labels.

Bounds of the training sample: ``PER_CLASS`` labelled documents of either class, the first by hash,
and ``DOC_WINDOWS`` windows of each, again by hash. Scoring reads every window of every text.

Results for odd input: a null or empty text has no windows and gets the score of gains of 0; without
labels of both classes every score is the share of toxic labels (0 without labels); conflicting
labels of an id count by majority, ties as toxic; rows that repeat an id are scored separately;
an empty table gives an empty result; other columns are not read, and the filter keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .registry import query, table
from .textblocks import plain

WORDS = 2  # a window
LEARNT_WORDS = 4  # a window to learn from
GRAM = 5  # bytes whose frequency is compared
PER_CLASS = 2500
DOC_WINDOWS = 200
SIGNIFICANT, TIMES = 4.5, 5  # standard deviations and times above ordinary windows
MIN_MATCH = 6
CALIBRATE = 4  # one sampled document in so many calibrates
THRESHOLD = 0.3
# the ordinary dictionary stays small: one that knows every ordinary syllable also compresses toxic words made of them
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 300, 3000, 1500
HARD_ROUNDS = 3
TEXT_BYTES = 1 << 20  # of a very long text that are split into words at once
# LEAD opens every window and closes every dictionary, or else short windows would be stored and not compressed;
# TRAIL closes every window, because the last eight bytes of an input never start a match
LEAD, TRAIL = b"a window of words that is compressed: ", b" ========"
_BEFORE_CONTENT = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"  # the repeat offsets that close a dictionary's header
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def windows(text: bytes, words: int) -> Iterator[bytes]:
    """Runs of words of the whole text, folded, each after LEAD."""
    at, carried = 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + TEXT_BYTES)
        end = cut.end() if cut else len(text)
        found = carried + text[at:end].lower().split()
        full = len(found) - len(found) % words
        for i in range(0, full, words):
            yield LEAD + b" ".join(found[i:i + words]) + TRAIL
        carried, at = found[full:], end
    if carried:
        yield LEAD + b" ".join(carried) + TRAIL


def _bare(window: bytes) -> bytes:
    """The words of a window between spaces."""
    return window[len(LEAD) - 1:len(window) - len(TRAIL) + 1]


def _content(samples: list[bytes], size: int) -> bytes:
    """What a trained dictionary refers to; samples too few to train on are their own dictionary."""
    try:
        made = zstandard.train_dictionary(size + 400, samples, k=16, d=6).as_bytes()
        return made.rpartition(_BEFORE_CONTENT)[2][-size:]
    except zstandard.ZstdError:
        return b"\n".join(dict.fromkeys(samples))[:size]


def _completed(content: bytes, samples: list[bytes], size: int) -> bytes:
    """The content with the commonest samples that it lacks in front, as far as they fit."""
    for sample, _ in Counter(samples).most_common():
        if len(content) + len(sample) > size:
            break
        if sample not in content:
            content = sample + content
    return content


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def _grams(blob: np.ndarray) -> np.ndarray:
    """Codes of the byte runs of length GRAM."""
    code = np.zeros(max(0, len(blob) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | blob[i:i + len(code)].astype(np.uint64)
    return code


def telling_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic windows that are made of byte runs frequent only there.

    Windows are counted once however often they are repeated, so copies prove nothing.
    """
    blob = b"".join(toxic)
    here = _grams(np.frombuffer(blob, np.uint8))
    grams, n = np.unique(here, return_counts=True)
    other, m = np.unique(_grams(np.frombuffer(b"".join(ordinary), np.uint8)), return_counts=True)
    if not len(grams) or not len(other):
        return []
    at = np.minimum(np.searchsorted(other, grams), len(other) - 1)
    m = np.where(other[at] == grams, m[at], 0) + 1
    ratio = len(blob) / max(1, sum(map(len, ordinary)))
    significant = (n - ratio * m) / np.sqrt(n + ratio * ratio * m) > SIGNIFICANT
    inner = [(grams >> np.uint64(8 * i)) & np.uint64(255) == 32 for i in range(1, GRAM - 1)]
    good = grams[significant & (n >= TIMES * ratio * m) & ~np.logical_or.reduce(inner)]
    if not len(good):
        return []
    near = np.minimum(np.searchsorted(good, here), len(good) - 1)
    hit = np.flatnonzero(good[near] == here)
    edge = np.zeros(len(blob) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + GRAM, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return [blob[a:b] for a, b in zip(turns[::2], turns[1::2]) if b - a > GRAM]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    weights: np.ndarray | None = None
    share: float = 0.0

    def features(self, texts: list[bytes]) -> np.ndarray:
        plainly, toxically = _compressor(self.ordinary).compress, _compressor(self.ordinary + b"\n" + self.toxic).compress
        return np.array([_summary([len(plainly(w)) - len(toxically(w)) for w in windows(t, WORDS)]) for t in texts]).reshape(len(texts), -1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.mean[0]) / self.mean[1]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _summary(gains: list[int]) -> list[float]:
    """What the thresholds are on: the largest gains, and how many windows exceed some."""
    g = np.array(gains or [0])
    top = np.sort(g)[::-1][:3]
    n = len(g)
    return [top[0], top.mean(), *[np.log1p((g >= t).sum()) for t in (2, 3, 4, 5, 6)],
            *[(g >= t).sum() / n for t in (2, 3, 4, 5)], np.log(n), np.maximum(g - 2, 0).sum() / n]


def fit_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    toxic, ordinary = ([_bare(w) for w in sorted(set(ws))] for ws in (toxic, ordinary))
    rng = np.random.default_rng(0)
    rng.shuffle(ordinary)
    content = _content(ordinary, ORDINARY_BYTES)
    spans = telling_spans(toxic, ordinary)
    rng.shuffle(spans)
    telling = _completed(_content(spans, TOXIC_BYTES), spans, TOXIC_BYTES) if spans else b""
    # ordinary windows that gain nevertheless are learnt by both
    probe = [p for w in ordinary for p in windows(w, WORDS)]
    for _ in range(HARD_ROUNDS if telling else 0):
        a, b = _compressor(content).compress, _compressor(content + b"\n" + telling).compress
        hard = [_bare(w) for w in probe if len(a(w)) - len(b(w)) >= 3]
        if len(hard) < 20:
            break
        content = _content(hard, HARD_BYTES) + content
    return content, telling


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def majority(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and its label: the commoner one, 1 where both are as common."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id")
            .agg((F.avg(F.col(column).cast("int")) >= 0.5).cast("int").alias("label")))


def labelled_sample(labels: DataFrame, column: str, allowed, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` ids of either label, first by hash, and how many there are of each."""
    known = durable(majority(labels, column).filter(allowed))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(column))
    # so many that per_class and more remain, whatever the number of labels
    share = {c: int(min(1.0, 2 * per_class / n) * (1 << 40)) for c, n in counts.items()}
    picked = [known.filter((F.col("label") == c) & (F.pmod(order, F.lit(1 << 40)) < share.get(c, 0))).orderBy(order, "doc_id").limit(per_class)
              for c in (0, 1)]
    return durable(picked[0].unionByName(picked[1])), counts


def train(docs: DataFrame, labels: DataFrame, allowed=None, per_class: int = PER_CLASS) -> ToxicityModel:
    """A model from labelled rows of which ``allowed`` (a condition on doc_id) holds."""
    sample, counts = labelled_sample(labels, "toxic", F.lit(True) if allowed is None else allowed, per_class)
    total = sum(counts.values())
    model = ToxicityModel(share=counts.get(1, 0) / total if total else 0.0)
    if len(counts) < 2:
        return model
    # the sample has at most 2 * per_class rows
    texts = durable(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id").cast("string")), F.lit(CALIBRATE)) == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            made, label = [], []
            for text, y in zip(plain(batch.column("text")).cast(pa.binary()), batch.column("label").to_pylist(), strict=True):
                own = sorted(set(windows(text.as_py(), LEARNT_WORDS)), key=lambda w: (zlib.crc32(w), w))[:DOC_WINDOWS]
                made += own
                label += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(label, pa.int32())], names=["w", "label"])

    got = texts.filter(~part).mapInArrow(cut, "w binary, label int").toArrow()
    label = np.asarray(got["label"])
    words = got["w"].to_pylist()
    model.ordinary, model.toxic = fit_dictionaries([w for w, y in zip(words, label) if y], [w for w, y in zip(words, label) if not y])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features([t.as_py() for t in plain(batch.column("text")).cast(pa.binary())])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    got = texts.filter(part).orderBy("doc_id").mapInArrow(measure, "x array<double>, label int").toArrow()
    y = np.asarray(got["label"], dtype=float)
    if len(y) and 0 < y.mean() < 1:
        x = np.array(got["x"].to_pylist())
        model.mean = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-6])
        share = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
        model.weights = logistic((x - model.mean[0]) / model.mean[1], y, share * len(y) / share.sum())
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.scores([t.as_py() for t in plain(batch.column("text")).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(at)).cast(pa.binary())
            yield batch.filter(pa.array(model.scores([t.as_py() for t in texts]) < threshold, pa.bool_()))

    # plain names on the way, whatever the columns are called
    plainly = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plainly.mapInArrow(run, plainly.schema).toDF(*docs.columns)


def held_out(column="doc_id", parts: int = 4, part: int = 2):
    """Rows whose labels nothing may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


@query("op6_toxicity")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
