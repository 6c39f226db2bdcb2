"""Secret scanning by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that every match must
contain. Documents are indexed in blocks: the postings of the trigrams that the queries name are
computed in one vectorised pass over the block's folded bytes, the queries intersect and unite
them, and only documents that remain meet the regular expression itself. A rule without mandatory
trigrams, or one whose letters ignore case beyond ASCII, scans every document. Whole texts are scanned; positions are code points.

Results for odd input: a null or empty text has no spans; rows that repeat an id are separate rows;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .textblocks import LOWER, blocks, plain, row_of

MOST_STRINGS = 64  # alternatives that a query spells out


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 and more
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

# -- trigram queries: True (no condition), bytes (a trigram), ("and" | "or", parts) ---------


def _join(kind: str, parts: list):
    if kind == "or" and True in parts:
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _spelled(strings: set[bytes]):
    """What texts share that hold one of the strings."""
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _folds_beyond_ascii(flags: int) -> bool:
    """Whether a letter may match one of another script (the Kelvin sign a k), of which the index knows nothing."""
    return bool(flags & re.IGNORECASE and not flags & re.ASCII)


def _item(op, arg) -> tuple[set[bytes] | None, object]:
    """The strings an element can match, if these are few, and else its query."""
    if op is C.LITERAL:
        return {chr(arg).encode().lower()}, True
    if op is C.IN:
        if all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).encode().lower() for _, a in arg}, True
        return None, True
    if op is C.SUBPATTERN:
        return (None, True) if _folds_beyond_ascii(arg[1]) else _sequence(arg[-1])
    if op is C.BRANCH:
        found = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in found):
            exact = set().union(*(e for e, _ in found))
            if len(exact) <= MOST_STRINGS:
                return exact, True
        return None, _join("or", [q if e is None else _spelled(e) for e, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        exact, mandatory = _sequence(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {b""}, True
        if low == high == 1:
            return exact, mandatory
        return None, True if low == 0 else mandatory if exact is None else _spelled(exact)
    return None, True


def _sequence(tokens) -> tuple[set[bytes] | None, object]:
    exact, run, parts = True, {b""}, []
    for op, arg in tokens:
        strings, mandatory = _item(op, arg)
        if strings is None:
            parts += [_spelled(run), mandatory]
            exact, run = False, {b""}
        elif len(run) * len(strings) > MOST_STRINGS:
            parts.append(_spelled(run))
            exact, run = False, strings
        else:
            run = {a + b for a in run for b in strings}
    return (run, True) if exact else (None, _join("and", parts + [_spelled(run)]))


def trigram_query(pattern: str):
    """A condition on the folded trigrams of a text that each text with a match fulfils."""
    parsed = _parser.parse(pattern)
    if _folds_beyond_ascii(parsed.state.flags):
        return True
    exact, mandatory = _sequence(parsed)
    return mandatory if exact is None else _spelled(exact)


def query_trigrams(condition) -> set[bytes]:
    if condition is True:
        return set()
    return {condition} if isinstance(condition, bytes) else set().union(*map(query_trigrams, condition[1]))


class TrigramIndex:
    """Postings of chosen trigrams over a block of documents."""

    def __init__(self, trigrams: set[bytes]):
        self.number = {t: i for i, t in enumerate(sorted(trigrams))}
        self.codes = np.zeros(1 << 24, np.uint8 if len(trigrams) < 255 else np.uint16)
        for t, i in self.number.items():
            self.codes[int.from_bytes(t, "big")] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which row (second index) has which trigram (first index)."""
        have = np.zeros((len(self.number), len(offsets) - 1), bool)
        if len(data) < 3 or not self.number:
            return have
        folded = LOWER[data].astype(np.uint32)
        found = self.codes[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
        at = np.flatnonzero(found)
        row = row_of(offsets, at)
        inside = at + 2 < offsets[row + 1]
        have[found[at[inside]].astype(np.int64) - 1, row[inside]] = True
        return have

    def candidates(self, condition, have: np.ndarray) -> np.ndarray:
        if condition is True:
            return np.ones(have.shape[1], bool)
        if isinstance(condition, bytes):
            return have[self.number[condition]]
        merge = np.logical_and if condition[0] == "and" else np.logical_or
        return merge.reduce([self.candidates(c, have) for c in condition[1]])


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans found in its text, by start and then by the order of the rules."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    conditions = [trigram_query(r.pattern) for r in rules]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(set().union(*map(query_trigrams, conditions)))
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            texts, out = plain(batch.column("text")), [[] for _ in range(batch.num_rows)]
            for first, last, data, offsets in blocks(texts):
                have = index.postings(data, offsets)
                wanted = np.stack([index.candidates(c, have) for c in conditions])
                for i in np.flatnonzero(wanted.any(axis=0)).tolist():
                    text = texts[first + i].as_py()
                    found = [(m.start(), k, m.end(), m.group()) for k, r in enumerate(rules) if wanted[k, i]
                             for m in compiled[k].finditer(text) if len(m.group(r.group)) >= r.least]
                    out[first + i] = [{"kind": rules[k].kind, "start": a, "end": b, "value": v} for a, k, b, v in sorted(found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, span_type)], names=["doc_id", "spans"])

    return source.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


@query("op8_secret_scan")
def op8(spark, folder):
    found = secret_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
