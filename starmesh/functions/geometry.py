"""Column expressions for distances, wrapping and boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(dx: Column, boxsize: float | None) -> Column:
    """The shortest image of a difference of positions in a periodic box; one image only."""
    if not boxsize:
        return dx
    return F.when(dx < -boxsize / 2, dx + boxsize).when(dx >= boxsize / 2, dx - boxsize).otherwise(dx)


def wrap_centred(dx: Column, boxsize: float | None) -> Column:
    """((dx + L/2) mod L) - L/2, as group catalogues use it."""
    return dx if not boxsize else F.pmod(dx + boxsize / 2, F.lit(float(boxsize))) - boxsize / 2


def into_box(x: Column, boxsize: float | None) -> Column:
    return x if not boxsize else F.pmod(x, F.lit(float(boxsize)))


def squared_distance(a: list[Column], b: list[Column], boxsize: float | None = None) -> Column:
    """Sum of squared differences, dimensions in order."""
    parts = [wrap(x - y, boxsize) for x, y in zip(a, b, strict=True)]
    return reduce(lambda s, t: s + t, [d * d for d in parts])


def least_squared_distance(ca: list[Column], ha: list[Column], cb: list[Column], hb: list[Column], boxsize: float | None = None) -> Column:
    """Between two boxes of centres c and half extents h, the least squared distance."""
    parts = [F.greatest(F.abs(wrap(x - y, boxsize)) - (h + k), F.lit(0.0)) for x, h, y, k in zip(ca, ha, cb, hb, strict=True)]
    return reduce(lambda s, t: s + t, [d * d for d in parts])


def greatest_squared_distance(ca: list[Column], ha: list[Column], cb: list[Column], hb: list[Column], boxsize: float | None = None) -> Column:
    """Between two boxes, an upper bound of the squared distance."""
    parts = [F.abs(wrap(x - y, boxsize)) + (h + k) for x, h, y, k in zip(ca, ha, cb, hb, strict=True)]
    return reduce(lambda s, t: s + t, [d * d for d in parts])


def node_levels(depth: Column, dim: int, top: int) -> list[Column]:
    """For a node of `depth` prefix bits the exponents of its extent in each dimension; the first
    bit of a dimension has exponent `top`."""
    return [F.lit(top + 1) - F.floor((depth + dim - 1 - i) / dim) for i in range(dim)]


def node_centre(x: Column, level: Column) -> Column:
    """Centre of the interval of length 2 ** level that holds x."""
    side = F.pow(F.lit(2.0), level)
    return (F.floor(x / side) + 0.5) * side


def node_extent(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)
