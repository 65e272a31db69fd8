"""Leaves, planes of nodes above them, and tiles: what joins of near points are pruned and dealt by.

Points are numbered in z-order. A leaf is a run of a fixed number of them, whatever the number of
points and their density; a node of plane p is a run of UNITS[p] leaves. Each node has the box of its
points. Pairs of nodes are walked from coarse to fine (`walk`). A tile is a run of leaves that is
shuffled together, with the leaves around it that it needs; where these are many they come in
chunks, so no group has more than a tile and a chunk of points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from starmesh.functions.zkey import bit_range, zkey
from starmesh.plans.shared import stored

from .points import dims
from .zorder import morton, with_position

#: Points of a tile, at most, and coordinates of a chunk of leaves around it.
TILE_POINTS, CHUNK_VALUES = 32_768, 1_500_000
#: Leaves of a node, by plane.
UNITS = tuple(8 ** min(p, 1) * 64 ** max(p - 1, 0) for p in range(7))
#: Dimensions of a key at most; more hardly help to keep neighbours together.
KEY_DIMS = 6
#: With more dimensions than this points are ordered by pivots, of a sample of so many points.
MANY_DIMS, PIVOTS, SAMPLE = 8, 24, 4096


class Boxes:
    """Boxes of nodes as arrays, with their numbers, how many points they have, and for receivers a
    squared distance beyond which they need nothing. The last `pivots` columns are no coordinates but
    distances of the points from pivots."""

    def __init__(self, node: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, boxsize: float | None, bound: np.ndarray | None = None, pivots: int = 0):
        self.node, self.n, self.boxsize, self.all = node, n, boxsize, (lo, hi, pivots)
        dim = lo.shape[1] - pivots
        lo, hi, self.near_pivot, self.far_pivot = lo[:, :dim], hi[:, :dim], lo[:, dim:], hi[:, dim:]
        self.lo, self.hi = lo, hi
        self.bound = np.full(len(node), np.inf) if bound is None else bound
        with np.errstate(invalid="ignore"):
            self.centre, self.half = (lo + hi) / 2, (hi - lo) / 2 * (1 + 1e-12)
        # Where a coordinate is infinite the centre is too, and nothing is ruled out.
        self.half = np.where(np.isfinite(self.centre) & np.isfinite(self.half), self.half, np.inf)
        self.centre = np.where(np.isfinite(self.half), self.centre, 0.0)

    def __len__(self) -> int:
        return len(self.node)

    def part(self, rows) -> Boxes:
        lo, hi, pivots = self.all
        return Boxes(self.node[rows], self.n[rows], lo[rows], hi[rows], self.boxsize, self.bound[rows], pivots)

    def whole(self) -> Boxes:
        """One box around all of them."""
        lo, hi, pivots = self.all
        return Boxes(self.node[:1], self.n.sum(keepdims=True), lo.min(0, keepdims=True), hi.max(0, keepdims=True), self.boxsize, self.bound.max(keepdims=True), pivots)

    def gaps(self, other: Boxes) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) squared distances of each of these boxes from each other one; slightly widened."""
        near, far = np.zeros((len(self), len(other))), np.zeros((len(self), len(other)))
        for i in range(self.centre.shape[1]):
            d = np.abs(self.centre[:, None, i] - other.centre[None, :, i])
            if self.boxsize:
                d = np.minimum(d, np.abs(self.boxsize - d))
            w = self.half[:, None, i] + other.half[None, :, i]
            near += np.maximum(d - w, 0) ** 2
            far += (d + w) ** 2
        # Two points are as far apart as their distances from a pivot differ, and no farther than these together.
        for i in range(self.near_pivot.shape[1]):
            a, b, c, d = self.near_pivot[:, None, i], self.far_pivot[:, None, i], other.near_pivot[None, :, i], other.far_pivot[None, :, i]
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(a - d, c - b) - 1e-12 * (b + d), 0)
            near = np.fmax(near, gap * gap)
            far = np.fmin(far, (b + d) ** 2)
        return near * (1 - 1e-9), far * (1 + 1e-9)

    def limits(self, other: Boxes) -> tuple[np.ndarray, np.ndarray]:
        """The same from the ends of the boxes: whatever is rounded, boxes inside these give no smaller
        least and no larger greatest distances. So what a rule accepts for two nodes it accepts for all in them."""
        near, far = np.zeros((len(self), len(other))), np.zeros((len(self), len(other)))
        for i in range(self.lo.shape[1]):
            up, down = self.hi[:, None, i] - other.lo[None, :, i], other.hi[None, :, i] - self.lo[:, None, i]
            gap, reach = np.maximum(np.maximum(-up, -down), 0), np.maximum(up, down)
            for shift in (-self.boxsize, self.boxsize) if self.boxsize else ():
                gap = np.minimum(gap, np.maximum(np.maximum(-(up + shift), -(down - shift)), 0))
                reach = np.minimum(reach, np.maximum(up + shift, down - shift))
            near += gap * gap
            far += reach * reach
        return near * (1 - 1e-9), far * (1 + 1e-9)

    def diameters(self) -> np.ndarray:
        """Squared diameters, slightly widened."""
        return ((2 * self.half) ** 2).sum(1) * (1 + 1e-9)


def boxes_of(frame, xs: list[str], boxsize: float | None) -> Boxes:
    """From a pandas frame of `nodes`."""
    frame = frame.sort_values("node")
    return Boxes(frame["node"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), frame[[f"lo{x}" for x in xs]].to_numpy(float), frame[[f"hi{x}" for x in xs]].to_numpy(float), boxsize, frame["bound"].to_numpy(float), pivots_of(xs))


def pivots_of(names: list[str]) -> int:
    """How many of the columns are distances from pivots."""
    return sum(c.startswith("pivot") for c in names)


def boxes_in(node: np.ndarray, x: np.ndarray, boxsize: float | None, far: list[np.ndarray] | None = None) -> Boxes:
    """Boxes of the runs of equal numbers in node; far has distances from pivots, an array for each."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, int)
    count = np.diff(np.append(first, len(node)))
    lo, hi = (np.column_stack([f.reduceat(x, first), *[f.reduceat(d, first) for d in far or []]]) for f in (np.minimum, np.maximum))
    return Boxes(node[first], count, lo, hi, boxsize, None, len(far or []))


def matrix(side, xs: list[str], order: np.ndarray | None = None) -> np.ndarray:
    """The columns xs of a table or frame as one array, its rows in an order: the only copy that is made of them."""
    out = np.empty((len(side), len(xs)))
    for i, c in enumerate(xs):
        x = side[c].to_numpy()
        out[:, i] = x if order is None else x[order]
    return out


def packed(x: np.ndarray, size: int) -> np.ndarray:
    """For each row the number of a compact box of about `size` rows: rows are cut into equal shares by
    their first coordinate, each of these by the second, and so on."""
    box, boxes, dim = np.zeros(len(x), np.int64), -(-len(x) // size), x.shape[1]
    for i in range(dim):
        cuts = int(np.ceil(boxes ** (1 / (dim - i)) - 1e-9))
        order = np.lexsort((x[:, i], box))
        own = box[order]
        first = np.searchsorted(own, own)
        count = np.searchsorted(own, own, side="right") - first
        box[order] = own * cuts + (np.arange(len(x)) - first) * cuts // count
        boxes = -(-boxes // cuts)
    return box


def with_leaves(points: DataFrame, leaf_size: int, exact: bool = True) -> tuple[DataFrame, int]:
    """points with zindex and leaf, stored in that order, and the number of points.

    With exact the order is the z-order of all bits, otherwise a z-curve through the points' box,
    which is all that pruning needs and takes no Python.
    """
    xs = dims(points)
    if exact:
        n = points.count()
        keyed = points.withColumn("zkey", zkey(xs[:KEY_DIMS] if len(xs) > KEY_DIMS else xs, bit_range(points, xs)))
    else:
        some = xs[:KEY_DIMS]
        finite = lambda x: F.when(F.abs(x) < float("inf"), F.col(x))
        n, *ends = points.agg(F.count(F.lit(1)), *[f(finite(x)) for x in some for f in (F.min, F.max)]).first()
        ends = [e or 0.0 for e in ends]
        keyed = points.withColumn("zkey", morton(some, ends[::2], ends[1::2]))
    # Equal points are next to each other, also where the key does not tell all dimensions apart.
    order = ["zkey", *xs, "id"] if not exact or len(xs) > KEY_DIMS else ["zkey", "id"]
    placed = with_position(keyed, order, "zindex", n).drop("zkey")
    return placed.withColumn("leaf", F.floor(F.col("zindex") / leaf_size)), n


def pivot_points(points: DataFrame, xs: list[str]) -> np.ndarray:
    """PIVOTS points that lie far from one another, of a sample of at most SAMPLE points by a hash of
    their ids: the next is always the one farthest from those before it. Fewer if points are equal."""
    rows = points.where(reduce(lambda a, b: a & b, [F.abs(x) < float("inf") for x in xs])).select("id", *xs).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    x = rows[xs].to_numpy(float)
    if not len(x):
        return np.empty((0, len(xs)))
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points from pivots."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1) if len(pivots) else np.empty((len(x), 0))


def by_pivots(points: DataFrame, leaf_size: int) -> tuple[DataFrame, int, np.ndarray]:
    """with_leaves for many dimensions: points of the same nearest pivot are together, in the order of
    their distance from it; and the pivots, a bounded number."""
    xs = dims(points)
    pivots = pivot_points(points, xs)
    schema = points.schema
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(invalid="ignore", over="ignore"):
                d = from_pivots(np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in xs]), shared.value)
            d = np.where(np.isnan(d), np.inf, d)
            near = d.argmin(1) if d.shape[1] else np.zeros(len(d), np.int64)
            far = d[np.arange(len(d)), near] if d.shape[1] else np.zeros(len(d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "__near", "__far"])

    keyed = points.mapInArrow(run, StructType([*schema.fields, StructField("__near", IntegerType()), StructField("__far", DoubleType())]))
    n = points.count()
    placed = with_position(keyed, ["__near", "__far", *xs, "id"], "zindex", n).drop("__near", "__far")
    return placed.withColumn("leaf", F.floor(F.col("zindex") / leaf_size)), n, pivots


def leaf_nodes(leaved: DataFrame, xs: list[str], bound: str | None = None) -> DataFrame:
    """(node, n, bound, lo*, hi*) of plane 0; the bound is the greatest of a column of points."""
    most = F.max(bound) if bound else F.lit(float("inf"))
    return leaved.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), most.alias("bound"), *[f(x).alias(f"{k}{x}") for x in xs for k, f in (("lo", F.min), ("hi", F.max))])


def coarser(nodes: DataFrame, times: int, xs: list[str]) -> DataFrame:
    """Nodes of `times` nodes each."""
    return nodes.groupBy(F.floor(F.col("node") / times).alias("node")).agg(F.sum("n").alias("n"), F.max("bound").alias("bound"), *[f(f"{k}{x}").alias(f"{k}{x}") for x in xs for k, f in (("lo", F.min), ("hi", F.max))])


def plane_of(leaves: DataFrame, p: int, xs: list[str]) -> DataFrame:
    """The nodes of plane p."""
    return leaves if p == 0 else coarser(leaves, UNITS[p], xs)


def segments(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows whose zindex goes on by one: a range partition each, in whatever order a task reads them,
    or several that it reads in their order. With most they are cut to so many rows."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        z = batch.column(batch.schema.get_field_index("zindex")).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(z) != 1) + 1, [len(z)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and z[lo] != last + 1:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            last = int(z[hi - 1])
            while most and rows + hi - lo >= most:
                held.append(batch.slice(lo, most - rows))
                lo += most - rows
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            if lo < hi:
                held.append(batch.slice(lo, hi - lo))
                rows += hi - lo
    if held:
        yield pa.Table.from_batches(held)


def tile_leaves(n: int, leaf_size: int, slots: int) -> int:
    """Leaves of a tile: few enough points for one task, and for small sets fewer, so that all slots have some."""
    return max(1, min(TILE_POINTS, -(-n // (2 * slots))) // leaf_size)


def differences(a: np.ndarray, b: np.ndarray, boxsize: float | None) -> np.ndarray:
    """Squared distances (len(a), len(b)), dimensions in order, wrapped as in `geometry.wrap`."""
    out = None
    for i in range(a.shape[1]):
        d = wrapped(a[:, None, i] - b[None, :, i], boxsize)
        d *= d
        if out is None:
            out = d
        else:
            out += d
    return out


def wrapped(d: np.ndarray, boxsize: float | None) -> np.ndarray:
    return np.where(d < -boxsize / 2, d + boxsize, np.where(d >= boxsize / 2, d - boxsize, d)) if boxsize else d


def row_distances(a: np.ndarray, b: np.ndarray, boxsize: float | None, at: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Squared distances of a's rows from b's, row by row, or of the rows at[0] of a from the rows at[1]
    of b, which are never gathered as a whole; dimensions in order."""
    out = None
    for i in range(a.shape[1]):
        d = wrapped(a[:, i] - b[:, i] if at is None else a[at[0], i] - b[at[1], i], boxsize)
        out = d * d if out is None else out + d * d
    return out


def chunk_leaves(leaf_size: int, dim: int) -> int:
    """Leaves of a chunk."""
    return max(1, CHUNK_VALUES // (dim * leaf_size))


def in_chunks(need: DataFrame, leaves: int) -> DataFrame:
    """(tile, leaf, chunk): the leaves that a tile needs, dealt to chunks of so many."""
    at = F.row_number().over(W.partitionBy("tile").orderBy("leaf")) - 1
    return stored(need.withColumn("chunk", F.floor(at / leaves)), "tiles-needs")


def few_in_chunks(spark, tile: np.ndarray, leaf: np.ndarray, leaves: int) -> tuple[DataFrame, dict[int, int]]:
    """The same of pairs that are on the driver, and the number of chunks of each tile."""
    both = np.unique(np.column_stack([tile, leaf]).astype(np.int64), axis=0)
    tiles, first, count = np.unique(both[:, 0], return_index=True, return_counts=True)
    chunk = (np.arange(len(both)) - np.repeat(first, count)) // leaves
    last = dict(zip(tiles.tolist(), (chunk[first + count - 1] + 1).tolist(), strict=True))
    return spark.createDataFrame(pa.table({"tile": both[:, 0], "leaf": both[:, 1], "chunk": chunk.astype(np.int64)})), last
