"""Token ids of a byte-level tokenizer file.

The file's vocabulary and merges are those of a rank table (an id is the rank of its merge), so
the faster encoder for rank tables gives the same ids; a file for which that doesn't hold, and a
text with one of the file's special strings, goes through the file's own library. The pattern's
look-ahead only matters where white space follows white space; other texts use it without.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys

import numpy as np
import tiktoken
from tokenizers import Tokenizer

PIECE_CHARS = 1 << 18  # of a very long text that are encoded at once
_AHEAD = r"|\s+(?!\S)"
# the word pattern of byte-level tokenizers
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+" + _AHEAD + r"|\s+"
_GAP = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")  # no token spans the start of such a space


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The file as a rank table, or None where it is something else."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix")):
        return None
    to_byte = _byte_of()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in pairs]
    if None in ids or ids != sorted(ids):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(to_byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}


class FileTokens:
    """Ids as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._path, self._library = path, None
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = _ranks(spec)
        self._near = self._far = None
        if ranks:
            self._far = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._near = tiktoken.Encoding("file", pat_str=PATTERN.replace(_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    @property
    def _own(self) -> Tokenizer:
        """The file's own library, read when a text needs it: workers keep what they have read."""
        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
        return self._library

    def encode(self, text: str) -> bytes:
        if self._near is None or any(s in text for s in self._special):
            return np.asarray(self._own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        encoding = self._far if _GAP.search(text) else self._near
        if len(text) <= PIECE_CHARS:
            return _packed(encoding.encode_ordinary(text))
        parts, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + PIECE_CHARS)
            end = cut.start() if cut else len(text)
            parts.append(_packed(encoding.encode_ordinary(text[at:end])))
            at = end
        return b"".join(parts)


def _packed(ids: list[int]) -> bytes:
    made = array.array("I", ids)
    if sys.byteorder != "little" or made.itemsize != 4:
        return np.asarray(ids, "<u4").tobytes()
    return made.tobytes()


_KNOWN: dict[str, FileTokens] = {}


def file_tokens(path: str) -> FileTokens:
    """One encoder per worker process and file."""
    if path not in _KNOWN:
        _KNOWN[path] = FileTokens(path)
    return _KNOWN[path]
