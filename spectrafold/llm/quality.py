"""Quality classification by a generalised additive model with pairwise interactions.

Numbers about a text (how words, lines, characters and repetitions are made up) are cut into
bins. Boosting goes round the features in turn; each turn adds a small tree on one feature's bins
to that feature's table. Then the pairs of features that explain most of what is left get tables
of their own in the same way. A score is a sum of table entries, one addition per table and row.

Bound of the training sample: ``PER_CLASS`` labelled documents of either class, the first by hash,
weighted to the share of the classes among all labels. Features are taken from whole texts of all
documents, once, and kept; training and scoring read only them.

Results for odd input: a null or empty text has features of 0 and is scored by them; without labels
of both classes every score is the share of good labels (0 without labels); conflicting labels of
an id count by majority, ties as good; rows that repeat an id are scored separately; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import block, lists
from ..session import durable
from .registry import query, table
from .textblocks import blocks, row_of, shingle_hashes, span_hashes, word_bounds
from .toxicity import held_out, labelled_sample

PER_CLASS = 10_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 40, 10
RATE = 0.15
THRESHOLD = 0.5

_KINDS = ["upper", "lower", "digit", "space", "line", "stop", "loud", "bar", "symbol", "bracket", "dash", "wide", "other"]


def _kinds() -> np.ndarray:
    kind = np.full(256, _KINDS.index("other"), np.uint8)
    for name, members in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\x0b\x0c\r",
                          "line": b"\n", "stop": b".,;:", "loud": b"!?", "bar": b"|", "symbol": b"#%&$*@^~+=<>_`\\/",
                          "bracket": b"()[]{}\"'", "dash": b"-", "wide": range(128, 256)}.items():
        kind[list(members)] = _KINDS.index(name)
    return kind


_KIND = _kinds()
FEATURES = ([f"share_{k}" for k in _KINDS] + ["log_bytes", "log_words", "word_bytes", "word_spread", "ends_odd", "short_words", "long_words",
            "distinct_words", "distinct_pairs", "same_next", "distinct_triples", "log_lines", "line_words", "distinct_lines", "top_word"])


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per row, and how often the commonest one occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(v))))
    return np.bincount(r[at], minlength=n).astype(float), top


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    total = np.maximum(size, 1)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(owner * 16 + _KIND[data], minlength=n * 16).reshape(n, 16)[:, :len(_KINDS)]
    starts, ends, row = word_bounds(data, offsets)
    length = (ends - starts).astype(float)
    words = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(row, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, n) / some - mean * mean, 0))
    last = _KIND[data[ends - 1]] if len(ends) else np.empty(0, np.uint8)
    odd = np.isin(last, [_KINDS.index(k) for k in ("loud", "bar", "symbol", "bracket", "other")])
    value = span_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    distinct, top = _distinct(value, row, n)
    more = []
    for k in (2, 3):
        v, r = shingle_hashes(value, row, k)
        d, _ = _distinct(v, r, n)
        more.append(np.where(words >= k, d / np.maximum(words - k + 1, 1), 1))
    same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(np.append(breaks + 1, offsets[:-1]), [len(data)])
    edges = edges[edges <= len(data)]
    begin, end = edges[:-1], edges[1:]
    line_row = row_of(offsets, begin) if len(begin) else np.empty(0, np.int64)
    lines = np.bincount(line_row, minlength=n).astype(float)
    line_hash = span_hashes(data, begin, np.where(data[end - 1] == 10, end - 1, end)) if len(begin) else np.empty(0, np.uint64)
    line_distinct, _ = _distinct(line_hash, line_row, n)
    return np.column_stack([
        counts / total[:, None], np.log1p(size), np.log1p(words), mean, spread, np.bincount(row, odd, n) / some,
        np.bincount(row, length <= 2, n) / some, np.bincount(row, length >= 12, n) / some, distinct / some, more[0],
        np.bincount(row[1:], same, n) / some, more[1], np.log1p(lines), words / np.maximum(lines, 1),
        line_distinct / np.maximum(lines, 1), top / some])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the numbers of its whole text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(data, offsets) for _, _, data, offsets in blocks(batch.column("text"))]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(np.vstack(made))], names=["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {kind}, x array<double>")


# -- the additive model ---------------------------------------------------------------------

def _gain(g, h, ridge=1.0):
    return g * g / (h + ridge)


def small_tree(g: np.ndarray, h: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree on one ordered feature, from sums of gradients and weights."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    won = np.where((left_h >= least) & (right_h >= least), _gain(left_g, left_h) + _gain(right_g, right_h), -1)
    at = int(won.argmax())
    if won[at] <= _gain(g.sum(), h.sum()) + 1e-9:
        return value
    return np.concatenate([small_tree(g[:at + 1], h[:at + 1], least, depth - 1), small_tree(g[at + 1:], h[at + 1:], least, depth - 1)])


def quarter_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four, as values per cell, and what it wins."""
    sums = [np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h)]
    best, found = 0.0, None
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            (ga, gb, gc, gd), (ha, hb, hc, hd) = [(s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])
                                                  for s in sums]
            if min(ha, hb, hc, hd) < least:
                continue
            won = _gain(ga, ha) + _gain(gb, hb) + _gain(gc, hc) + _gain(gd, hd) - _gain(sums[0][-1, -1], sums[1][-1, -1])
            if won > best:
                best, found = won, (i, j, [x / (y + 1.0) for x, y in ((ga, ha), (gb, hb), (gc, hc), (gd, hd))])
    made = np.zeros(g.shape)
    if found:
        i, j, v = found
        made[:i, :j], made[:i, j:], made[i:, :j], made[i:, j:] = v
    return made, best


@dataclass
class AdditiveModel:
    share: float = 0.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # fine bin to coarse bin
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)]

    def logits(self, own: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(own[0]) if own else 0, self.base)
        for b, t in zip(own, self.tables):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][own[i]], self.coarse[j][own[j]]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the features' tables, then of the pairs' tables."""
    weight = weight * len(y) / weight.sum()
    model = AdditiveModel(share=float((weight * y).sum() / weight.sum()))
    model.base = float(np.log(model.share / (1 - model.share)))
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        model.cuts.append(cuts)
        model.coarse.append(np.minimum(np.arange(len(cuts) + 1) * COARSE // (len(cuts) + 1), COARSE - 1))
        model.tables.append(np.zeros(len(cuts) + 1))
    own = model.bins(x)
    total = np.full(len(y), model.base)
    least = max(2.0, 0.0005 * len(y))
    least_h = least * 0.05

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-4)

    for _ in range(ROUNDS):
        for j, b in enumerate(own):
            g, h = slopes()
            step = RATE * np.clip(small_tree(np.bincount(b, g, len(model.tables[j])), np.bincount(b, h, len(model.tables[j])), least_h), -4, 4)
            model.tables[j] += step
            total += step[b]
    g, h = slopes()
    wide = [c[b] for c, b in zip(model.coarse, own)]

    def grid(i, j, v):
        return np.bincount(wide[i] * COARSE + wide[j], v, COARSE * COARSE).reshape(COARSE, COARSE)

    wins = [(quarter_tree(grid(i, j, g), grid(i, j, h), least_h)[1], i, j) for i in range(x.shape[1]) for j in range(i)]
    chosen = [(i, j) for won, i, j in sorted(wins, reverse=True)[:PAIRS] if won > 0]
    made = {p: np.zeros((COARSE, COARSE)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slopes()
            step = RATE * np.clip(quarter_tree(grid(i, j, g), grid(i, j, h), least_h)[0], -4, 4)
            made[i, j] += step
            total += step[wide[i], wide[j]]
    model.pairs = [(i, j, t) for (i, j), t in made.items()]
    return model


def train(known: DataFrame, labels: DataFrame, allowed=None, per_class: int = PER_CLASS) -> AdditiveModel:
    """A model from the features of labelled documents of which ``allowed`` (on doc_id) holds."""
    sample, counts = labelled_sample(labels, "quality", F.lit(True) if allowed is None else allowed, per_class)
    total = sum(counts.values())
    model = AdditiveModel(share=counts.get(1, 0) / total if total else 0.0)
    if len(counts) < 2:
        return model
    # at most 2 * per_class rows
    got = known.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("x", "label").toArrow()
    y = np.asarray(got["label"], dtype=float)
    if not len(y) or y.min() == y.max():
        return model
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    return fit(block(got["x"]), y, weight)


def score(known: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score from doc_id and x."""
    kind = known.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(block(batch.column("x"))))],
                                                 names=["doc_id", "score"])

    return known.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


@query("op10_quality")
def op10(spark, folder):
    known = durable(features(table(spark, folder, "documents")))
    model = train(known, table(spark, folder, "labels"), ~held_out(parts=3, part=1))
    return score(known, model).select("doc_id", held_out(parts=3, part=1).alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
