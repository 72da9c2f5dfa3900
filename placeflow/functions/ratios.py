"""Ratios, clamps, bins and paddings as column expressions; none of them raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b where b > 0, else null or the given value."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def zero_fill(code: Column, width: int) -> Column:
    """Left-pads with zeros and never shortens."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def number(x: Column) -> Column:
    """A double, or null for what is none."""
    return x.try_cast("double")


def code(x: Column) -> Column:
    return F.trim(x.cast("string"))


def bin_label(x: Column, edges: list[float], labels: list[str], closed: str = "left") -> Column:
    """The label of the interval that holds x: [a, b) for closed='left', (a, b] for 'right'; null outside."""
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = (x >= a) & (x < b) if closed == "left" else (x > a) & (x <= b)
        out = F.when(inside, label).otherwise(out)
    return out


def rank_quartile(rank: Column, n: Column, parts: int = 4) -> Column:
    """Quantile group of a tie-free rank of n, with linear interpolation between ranks: not ntile. A single row is in group 1."""
    return F.when(n > 1, F.greatest(F.lit(1), F.ceil((rank - 1) * parts / (n - 1)))).otherwise(1).cast("int")


def size_threshold(size: Column, small: float = 3500.0, big: float = 25000.0, sc_small: float = 0.75, sc_big: float = 2.0 / 3.0) -> Column:
    """Self-containment that an area of a size must reach: sc_small up to small, sc_big from big, linear between."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (size - small) / (big - small)))
    return F.lit(sc_small) + share * (sc_big - sc_small)
