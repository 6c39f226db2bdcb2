"""Column expressions on ARRAY<DOUBLE> variables, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c) -> Column:
    return col(c).cast("array<double>")


def literal(values) -> Column:
    """A driver-side vector as one constant array (folded once, not per row)."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>") \
        if any(v != v or abs(v) == float("inf") for v in values) \
        else F.array(*[F.lit(float(v)) for v in values])


def let(value, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(c) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda a, v: a + v)


def average(c) -> Column:
    return total(c) / F.size(col(c))


def dot(a, b) -> Column:
    return F.aggregate(F.arrays_zip(col(a).alias("l"), col(b).alias("r")), F.lit(0.0),
                       lambda acc, s: acc + s["l"] * s["r"])


def sum_squares(c) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda a, v: a + v * v)


def spread(c) -> Column:
    """Population standard deviation, two passes over the row's own values."""
    c = col(c)
    return let(average(c), lambda m: F.sqrt(
        F.aggregate(c, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(c)))


def plus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda u, v: u + v)


def minus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda u, v: u - v)


def difference(c, order: int = 1) -> Column:
    """Repeated first difference; the result is ``order`` values shorter."""
    out = col(c)
    for _ in range(order):
        size = F.size(out)
        out = F.zip_with(F.slice(out, F.lit(2), size - 1), F.slice(out, F.lit(1), size - 1),
                         lambda u, v: u - v)
    return out


def running_mean(c, window: int) -> Column:
    """Centred moving average with the edge values repeated.

    ``window // 2`` values lie to the left, so an even window leans left. Prefix sums are not
    used: adding the window keeps rounding local.
    """
    left = window // 2
    c = col(c)
    last = F.size(c) - 1

    def at(i):
        return F.get(c, F.greatest(F.lit(0), F.least(last, i)))

    def mean(i):
        acc = at(i - left)
        for step in range(1, window):
            acc = acc + at(i - left + step)
        return acc / window

    return F.transform(F.sequence(F.lit(0), last), mean)


def take(c, positions) -> Column:
    """Values at the given 0-based positions, in that order."""
    c = col(c)
    return F.transform(F.array(*[F.lit(int(p)) for p in positions]), lambda i: F.get(c, i))


def trapezoid(c) -> Column:
    """Unit-step trapezoid area; a single value passes through."""
    c = col(c)
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))) \
        .otherwise(total(c) - (F.get(c, F.lit(0)) + F.element_at(c, -1)) / 2)


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), col(c)))))


def softmax(c) -> Column:
    c = col(c)
    raised = let(F.array_max(c), lambda top: F.transform(c, lambda v: F.exp(v - top)))
    return let(raised, lambda r: let(total(r), lambda s: F.transform(r, lambda v: v / s)))
