"""Argument helpers: number lists such as ``1,2,3-6,12:0.5:15`` and text tokens."""

from __future__ import annotations

import re

_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_RANGE = re.compile(rf"({_NUMBER})\s*([:-])\s*({_NUMBER})(?:\s*\2\s*({_NUMBER}))?")


def number_list(spec) -> list[float]:
    """Single values and inclusive ranges (``a-b``, ``a:b``, ``a:step:b``), in given order."""
    if spec is None:
        return []
    if isinstance(spec, (int, float)):
        return [spec]
    if not isinstance(spec, str):
        return [v for item in spec for v in number_list(item)]
    text = spec.strip()
    parts = re.split(r"[,;\n]+", text)
    if len(parts) == 1:
        parts = re.split(r"\s+", text)
    out: list[float] = []
    for part in filter(None, (p.strip() for p in parts)):
        found = _RANGE.fullmatch(part)
        if not found:
            out.append(float(part))
            continue
        start, middle, stop = float(found[1]), float(found[3]), found[4]
        end = middle if stop is None else float(stop)
        step = (1.0 if end >= start else -1.0) if stop is None else middle
        if step == 0:
            raise ValueError(f"step 0 in '{part}'")
        # inclusive end, with room for the rounding of decimal steps
        count = int((end - start) / step + 1e-9) + 1 if (end - start) * step >= 0 else 0
        out.extend(start + i * step for i in range(count))
    return [int(v) if float(v).is_integer() else v for v in out]


def text_list(spec) -> list[str]:
    if spec is None:
        return []
    if isinstance(spec, str):
        spec = re.split(r"[;,\n]+", spec)
    return [t.strip() for t in spec if str(t).strip()]
