"""Radix trees over z-order: adaptive leaves, planes of nodes, and their geometry.

A node is a prefix of z-order keys. Points are sorted once; from then on a leaf is a run of rows,
and what tells runs apart is how many leading bits a row shares with the next. Each partition
finds its runs by itself. Only nodes that go on in other partitions need to be counted across
them: they are prefixes of the partition's first or last key, of which there are as many as bits.
They are counted in a tree: partitions in blocks on the executors, BLOCKS blocks on the driver, and
back. Nodes of a plane are made of those of the plane below.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from starmesh.functions.geometry import node_centre, node_extent, node_levels
from starmesh.functions.zkey import BitRange, IntRange, bit_range, key_bits
from starmesh.plans.observed import note
from starmesh.plans.shared import stored

from .points import dims
from .tiles import segments
from .zorder import with_position, with_zkey

#: Blocks of partitions, at most, whose ends come to the driver.
BLOCKS = 256
_ENDS = "z long, first binary, last binary, of_first array<long>, of_last array<long>, start array<long>"
_ZEROS = np.array([8 - int(i).bit_length() for i in range(256)])


def common_bits(a: np.ndarray, b: np.ndarray, dim: int, total: int) -> np.ndarray:
    """Leading bits that keys (rows of bytes) share: two bits of class per dimension, then the body."""
    x = a ^ b
    x[:, 0] = 0
    at = (x != 0).argmax(1)
    value = x[np.arange(len(x)), at]
    head = 2 * (at - 1) + _ZEROS[value] - 6
    body = 2 * dim + 8 * (at - 1 - dim) + _ZEROS[value]
    return np.where(value == 0, total, np.where(at <= dim, head, body)).astype(np.int32)


def extents(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the first and last place of the stretch around it where nothing is below shared[i]."""
    n = len(shared)
    table = [shared]
    while 2 << (len(table) - 1) <= n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    left, right = np.arange(n), np.arange(n)
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        at = left - step
        ok = (at >= 0) & (table[k][np.maximum(at, 0)] >= shared)
        left = np.where(ok, at, left)
        at = right + 1
        ok = (at + step <= n) & (table[k][np.minimum(at, n - step)] >= shared)
        right = np.where(ok, at + step - 1, right)
    return left, right


class _Part:
    """A segment's keys in order, and the bits that each shares with the next."""

    def __init__(self, rows: pa.Table, dim: int, total: int):
        self.n = rows.num_rows
        self.keys = np.frombuffer(b"".join(rows["zkey"].to_pylist()), np.uint8).reshape(self.n, -1)
        self.z = rows["zindex"].to_numpy()
        self.types = rows["ptype"].to_numpy().astype(np.int64) if "ptype" in rows.column_names else np.zeros(self.n, np.int64)
        self.shared = common_bits(self.keys[:-1], self.keys[1:], dim, total)


def _ends(dim: int, total: int, n_types: int):
    """A row per partition: part, first and last key, and for each number of bits how many points
    (by type) share so many with the first and with the last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in segments(batches):
            part = _Part(rows, dim, total)
            of_first = np.concatenate([[total], np.minimum.accumulate(part.shared)])
            of_last = np.concatenate([np.minimum.accumulate(part.shared[::-1])[::-1], [total]])
            counts = []
            for bits in (of_first, of_last):
                by = np.zeros((n_types, total + 1), np.int64)
                np.add.at(by, (part.types, bits), 1)
                counts.append(by[:, ::-1].cumsum(1)[:, ::-1])
            start = part.z[np.searchsorted(of_last, np.arange(total + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([int(part.z[0])]), pa.array([part.keys[0].tobytes()], pa.binary()), pa.array([part.keys[-1].tobytes()], pa.binary()), *(pa.array([c.ravel().tolist()], pa.list_(pa.int64())) for c in counts), pa.array([start.tolist()], pa.list_(pa.int64()))], names=["z", "first", "last", "of_first", "of_last", "start"])

    return run


class _Seams:
    """Partitions next to one another, in order, with their ends: for each number of bits how many
    points share so many with a partition's last key up to there (upto), and from where on (begin),
    and how many with its first key from there on (onward)."""

    def __init__(self, rows: list[dict], dim: int, total: int, n_types: int):
        self.rows = sorted(rows, key=lambda r: r["z"])
        first, last = (np.array([np.frombuffer(r[c], np.uint8) for r in self.rows]) for c in ("first", "last"))
        bits = np.arange(total + 1)
        of_first, of_last = (np.array([r[c] for r in self.rows], np.int64).reshape(len(rows), n_types, total + 1) for c in ("of_first", "of_last"))
        self.whole = common_bits(first, last, dim, total)[:, None] >= bits
        self.seam = np.zeros((len(rows) + 1, total + 1), bool)
        if len(rows) > 1:
            self.seam[1:-1] = common_bits(last[:-1], first[1:], dim, total)[:, None] >= bits
        self.upto, self.begin, self.onward = of_last, np.array([r["start"] for r in self.rows], np.int64), of_first
        for p in range(1, len(rows)):
            on = self.whole[p] & self.seam[p]
            self.upto[p] += np.where(on, self.upto[p - 1], 0)
            self.begin[p] = np.where(on, self.begin[p - 1], self.begin[p])
        for p in range(len(rows) - 2, -1, -1):
            self.onward[p] += np.where(self.whole[p] & self.seam[p + 1], self.onward[p + 1], 0)

    def as_one(self) -> dict:
        """The ends of all of them together."""
        a, z = self.rows[0], self.rows[-1]
        return {"z": a["z"], "first": a["first"], "last": z["last"], "of_first": self.onward[0].ravel().tolist(), "of_last": self.upto[-1].ravel().tolist(), "start": self.begin[-1].tolist()}

    def around(self, p: int) -> list[dict]:
        """What is before and after one of them, as partitions of which only the facing ends count."""
        out = []
        if p:
            own = self.rows[p - 1]
            out.append(own | {"first": own["last"], "of_last": self.upto[p - 1].ravel().tolist(), "start": self.begin[p - 1].tolist()})
        if p + 1 < len(self.rows):
            own = self.rows[p + 1]
            out.append(own | {"last": own["first"], "of_first": self.onward[p + 1].ravel().tolist()})
        return out

    def depths(self, p: int, caps: Sequence[int], levels: Sequence[int | None], total: int) -> tuple[list[int], list[int], list[int]]:
        """Of one partition: the depths of the nodes of its first and of its last key, on each plane,
        and where the former begin."""
        last = p + 1 == len(self.rows)
        of_f = (self.onward[p] + np.where(self.seam[p], self.upto[p - 1], 0) if p else self.onward[p]).max(0)
        of_l = (self.upto[p] + np.where(self.seam[p + 1], self.onward[p + 1], 0) if not last else self.upto[p]).max(0)
        head = np.where(self.seam[p], self.begin[p - 1], self.rows[p]["z"]) if p else np.full(total + 1, self.rows[p]["z"])

        def depth(counts: np.ndarray) -> list[int]:
            out = []
            for cap, lv in zip(caps, levels, strict=True):
                few = counts <= cap
                out.append(min(total, max(int(np.argmax(few)) if few.any() else total, 0 if lv is None else total - lv + 1)))
            return out

        firsts = depth(of_f)
        return firsts, depth(of_l), [int(head[d]) for d in firsts]


def _across(ends: DataFrame, n: int, caps: Sequence[int], levels: Sequence[int | None], dim: int, total: int, n_types: int) -> dict[int, tuple[list, list, list]]:
    """By a partition's first z-index, what `_Seams.depths` tells. Some kilobytes per block come to the
    driver, and some numbers per partition, of which there are at most zorder.MOST_RANGES."""
    spark = ends.sparkSession
    dealt = stored(ends.withColumn("block", F.least(F.floor(F.col("z") * BLOCKS / max(1, n)), F.lit(BLOCKS - 1))), "tree-ends")
    names = ["z", "first", "last", "of_first", "of_last", "start"]

    def up(rows: pa.Table) -> pa.Table:
        one = _Seams(rows.select(names).to_pylist(), dim, total, n_types).as_one()
        return pa.Table.from_pylist([one | {"block": rows["block"][0].as_py()}], schema=rows.schema)

    blocks = _Seams([r.asDict() for r in dealt.groupBy("block").applyInArrow(up, dealt.schema).collect()], dim, total, n_types)  # at most BLOCKS rows
    note("tree.driver_rows", len(blocks.rows))
    beside = spark.sparkContext.broadcast({r["block"]: blocks.around(i) for i, r in enumerate(blocks.rows)})

    def down(rows: pa.Table) -> pa.Table:
        own = rows.select(names).to_pylist()
        mine = {r["z"] for r in own}
        seams = _Seams(own + beside.value[rows["block"][0].as_py()], dim, total, n_types)
        found = [{"z": r["z"], "d": seams.depths(p, caps, levels, total)} for p, r in enumerate(seams.rows) if r["z"] in mine]
        return pa.Table.from_pylist(found, schema=pa.schema([("z", pa.int64()), ("d", pa.list_(pa.list_(pa.int64())))]))

    return {r["z"]: tuple(r["d"]) for r in dealt.groupBy("block").applyInArrow(down, "z long, d array<array<long>>").collect()}


def _runs(ends, caps: Sequence[int], levels: Sequence[int | None], dim: int, total: int, n_types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in segments(batches):
            part = _Part(rows, dim, total)
            firsts, lasts, heads = ends.value[int(part.z[0])]
            n, shared = part.n, part.shared
            left, right = extents(shared)
            most = np.zeros(n - 1, np.int64)
            for t in range(n_types):
                seen = np.concatenate([[0], np.cumsum(part.types == t)])
                most = np.maximum(most, seen[right + 2] - seen[left])
            for i, (cap, lv, nf, nl, head) in enumerate(zip(caps, levels, firsts, lasts, heads, strict=True)):
                # A node that reaches an end is a prefix of the key there; others are counted here.
                split = np.where(left == 0, shared < nf, np.where(right == n - 2, shared < nl, most > cap))
                if lv is not None:
                    split |= shared <= total - lv
                at = np.flatnonzero(split & (shared < total))
                first = np.concatenate([[0], at + 1])
                edge = np.concatenate([[-1], shared[at], [-1]])
                depth = np.maximum(edge[:-1], edge[1:]) + 1
                if lv is not None:
                    depth = np.maximum(depth, total - lv + 1)
                size = np.diff(np.append(first, n))
                # More points than the cap are left together only if they are equal: their node is the whole key.
                depth = np.where(np.maximum.reduce([np.add.reduceat(part.types == t, first, dtype=np.int64) for t in range(n_types)]) > cap, total, depth)
                depth[-1], start = nl, part.z[first].copy()
                depth[0], start[0] = nf, head
                rows = rows.append_column(f"node{i}", pa.array(np.repeat(start, size))).append_column(f"depth{i}", pa.array(np.repeat(depth, size).astype(np.int32)))
            yield from rows.combine_chunks().to_batches()

    return run


def key_length(dim: int, span: BitRange | IntRange) -> int:
    """Bits of a key: two of class per dimension, and those of the interleaved numbers."""
    return 2 * dim + dim * span.bits


def placed_points(points: DataFrame, span: BitRange | IntRange) -> DataFrame:
    """points with zkey and zindex, in order; the types of a union are told apart only by ptype."""
    keyed = with_zkey(points, span)
    return with_position(keyed, ["zkey", *(["ptype"] if "ptype" in points.columns else []), "id"], "zindex")


def assign_nodes(placed: DataFrame, caps: Sequence[int], span: BitRange | IntRange, levels: Sequence[int | None] | None = None) -> DataFrame:
    """Adds node0, depth0, node1, ...: for each cap the node that a point lies in, named by the
    z-index of its first point, and its number of prefix bits.

    The node is the shortest prefix with at most cap points, of each type if there is a column
    ptype. Points that are equal stay together, however many. With a level for a plane its nodes
    are also below that level. placed has zkey and zindex, as `placed_points` stores them. One row
    per range partition, of some kilobytes, comes to the driver.
    """
    spark, dim = placed.sparkSession, len(dims(placed))
    total = key_length(dim, span)
    levels = list(levels) if levels is not None else [None] * len(caps)
    typed = "ptype" in placed.columns
    n_types = (placed.agg(F.max("ptype")).first()[0] or 0) + 1 if typed else 1
    ends = placed.select("zindex", "zkey", *(["ptype"] if typed else [])).mapInArrow(_ends(dim, total, n_types), _ENDS)
    known = spark.sparkContext.broadcast(_across(ends, placed.count(), caps, levels, dim, total, n_types))
    schema = StructType([*placed.schema.fields, *[f for i in range(len(caps)) for f in (StructField(f"node{i}", LongType()), StructField(f"depth{i}", IntegerType()))]])
    return stored(placed.mapInArrow(_runs(known, caps, levels, dim, total, n_types), schema), "tree-nodes")


def _placed(points, span: BitRange | IntRange | None) -> tuple[DataFrame, BitRange | IntRange]:
    """points in order, and what their keys hold; those of an index are in order."""
    if isinstance(points, DataFrame):
        span = span or bit_range(points, dims(points))
        return placed_points(points, span), span
    return points.points.drop("leaf"), points.span


def assign_leaves(points: DataFrame, cap: int, span: BitRange | IntRange | None = None) -> DataFrame:
    """points (or those of an index) with zkey, zindex, and leaf, the z-index of the first point of the
    leaf, and depth, its prefix bits."""
    placed, span = _placed(points, span)
    return assign_nodes(placed, [cap], span).withColumnsRenamed({"node0": "leaf", "depth0": "depth"})


def node_name(key: Column, depth: Column, dim: int, span: BitRange | IntRange) -> Column:
    """A node's prefix as text, from the key of any of its points."""
    return F.substr(key_bits(key, dim, span), F.lit(1), depth)


def planes(n_points: int, max_leaf_size: int, coarse_fac: float, stop_coarsen: int) -> list[int]:
    """Caps of the planes, finest first: so many that the coarsest has about stop_coarsen nodes, if
    leaves are half full."""
    leaves = -(-n_points // max(1, max_leaf_size // 2)) + 1
    n = max(1, math.ceil(math.log(leaves / stop_coarsen) / math.log(coarse_fac)))
    return [int(max_leaf_size * coarse_fac**p) for p in range(n)]


def build_nodes(points: DataFrame, max_leaf_size: int = 32, coarse_fac: float = 6.0, stop_coarsen: int = 1024, span: BitRange | IntRange | None = None, regularize: tuple[float, float] | None = None) -> DataFrame:
    """One row per node: plane (0 are the leaves), node (its prefix as text), first (the z-index of
    its first point), parent (that of the node above), lvl (prefix bits left), npart [, npart_0,
    npart_1, ... by type], cent*, ext* of the radix cell, lo*, hi* of the points, and mass,
    mass_cent* if points have a mass; null mass centres where the mass is not positive.

    regularize is (percentile, volume factor): leaves, and nodes of each plane above, whose level
    `regularization_level` finds too large are split, though they have few points. An index is taken as
    it is stored; its points are of one type.
    """
    placed, span = _placed(points, span)
    xs = dims(placed)
    dim, total = len(xs), key_length(len(xs), span)
    caps = planes(placed.count(), max_leaf_size, coarse_fac, stop_coarsen)
    if not regularize:
        named = assign_nodes(placed, caps, span)
    else:
        named = _regular(placed, caps, span, total, regularize)
    types = range((placed.agg(F.max("ptype")).first()[0] or 0) + 1) if "ptype" in placed.columns else ()
    # Points are grouped once, into leaves; each plane above is made of the nodes of the one below.
    above = [f"{c}{p}" for p in range(1, len(caps)) for c in ("node", "depth")]
    rows = named.groupBy("node0", "depth0").agg(F.min("zkey").alias("zkey"), *[F.min(c).alias(c) for c in above], *_summary(named, xs, types))
    rows = stored(rows.withColumnsRenamed({"node0": "first", "depth0": "depth"}), "tree-plane")
    out = None
    for p in range(len(caps)):
        parent = (F.col(f"node{p + 1}") if p + 1 < len(caps) else F.lit(None).cast("long")).alias("parent")
        kept = [c for c in rows.columns if c not in above]
        plane = rows.select(F.lit(p).alias("plane"), parent, *kept)
        out = plane if out is None else out.unionByName(plane)
        if p + 1 < len(caps):
            further = [c for c in above if int(c[4:] if c[0] == "n" else c[5:]) > p + 1 and c in rows.columns]
            rows = rows.groupBy(F.col(f"node{p + 1}").alias("first"), F.col(f"depth{p + 1}").alias("depth")).agg(F.min("zkey").alias("zkey"), *[F.min(c).alias(c) for c in further], *_merged(rows))
            rows = stored(rows, "tree-plane")
    if "mass" in out.columns:
        centres = [F.when(F.col("mass") > 0, F.col(f"__m{x[1:]}") / F.col("mass")).alias(f"mass_cent{i}") for i, x in enumerate(xs)]
        out = out.select("*", *centres).drop(*[f"__m{x[1:]}" for x in xs])
    note("tree.planes", len(caps))
    out = out.withColumn("node", node_name(F.col("zkey"), F.col("depth"), dim, span))
    geometry = node_levels(F.greatest(F.col("depth") - 2 * dim, F.lit(0)), dim, span.top)
    cells = [node_centre(F.col(f"lo{x[1:]}"), lv).alias(f"cent{i}") for i, (x, lv) in enumerate(zip(xs, geometry, strict=True))]
    ext = [node_extent(lv).alias(f"ext{i}") for i, lv in enumerate(geometry)]
    given = ("plane", "node", "first", "parent", "depth", "zkey")
    return out.select("plane", "node", "first", "parent", (F.lit(total) - F.col("depth")).alias("lvl"), *cells, *ext, *[c for c in out.columns if c not in given])


def _regular(placed: DataFrame, caps: list[int], span: BitRange | IntRange, total: int, regularize: tuple[float, float]) -> DataFrame:
    """assign_nodes with the levels above which nodes of each plane are too large."""

    def too_large(named: DataFrame, i: int) -> int | None:
        lvl = (F.lit(total) - F.col(f"depth{i}")).alias("lvl")
        return regularization_level(named.groupBy(lvl).agg(F.count(F.lit(1)).alias("weight")), *regularize)

    leaved = assign_nodes(placed, caps[:1], span)
    level = too_large(leaved, 0)
    levels = [level] + [None] * (len(caps) - 1)
    if level is None and len(caps) == 1:
        return leaved
    named = assign_nodes(placed, caps, span, levels)
    if len(caps) == 1:
        return named
    above = [too_large(named, i) for i in range(1, len(caps))]
    # Nodes of a plane are regular above its level; those of the plane below lie in them.
    levels = [level]
    for lv in above:
        floor = max((x for x in levels if x is not None), default=0)
        levels.append(max(lv + 1, floor) if lv is not None else None)
    return assign_nodes(placed, caps, span, levels)


def _summary(named: DataFrame, xs: list[str], types) -> list[Column]:
    """Of points: what nodes have, in a form that nodes can be merged by."""
    cols = [F.count(F.lit(1)).alias("npart"), *[F.count_if(F.col("ptype") == t).alias(f"npart_{t}") for t in types]]
    cols += [f(x).alias(f"{k}{x[1:]}") for x in xs for k, f in (("lo", F.min), ("hi", F.max))]
    if "mass" in named.columns:
        cols += [F.sum("mass").alias("mass"), *[F.sum(F.col("mass") * F.col(x)).alias(f"__m{x[1:]}") for x in xs]]
    return cols


def _merged(nodes: DataFrame) -> list[Column]:
    """The same of nodes: counts and moments add up, boxes grow."""
    how = {"lo": F.min, "hi": F.max, "npart": F.sum, "mass": F.sum, "__m": F.sum}
    return [f(c).alias(c) for c in nodes.columns for k, f in how.items() if re.fullmatch(rf"{k}(_?\d+)?", c)]


def level_histogram(nodes: DataFrame, weight: Column | None = None) -> DataFrame:
    """(lvl, weight): nodes, or points, per level."""
    return nodes.groupBy("lvl").agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("weight"))


def regularization_level(histogram: DataFrame, percentile: float = 90.0, max_volume_fac: float = 20.0) -> int | None:
    """The first level at which nodes are too large, from (lvl, weight); None if none is.

    Levels up to the first one that holds `percentile` percent of the weight have an average
    volume. From that level on, a node is too large if its volume is max_volume_fac times that.
    """
    rows = sorted((r["lvl"], r["weight"]) for r in histogram.collect())  # a row per level
    total, seen, ref = sum(w for _, w in rows), 0, None
    for lvl, w in rows:
        seen += w
        if seen >= total * percentile / 100:
            ref = lvl
            break
    if ref is None:
        return None
    below = [(lvl, w) for lvl, w in rows if lvl <= ref]
    mean = sum(2.0 ** (lvl - ref) * w for lvl, w in below) / sum(w for _, w in below)
    return next((lvl for lvl, _ in rows if lvl >= ref and 2.0 ** min(lvl - ref, 1000) >= max_volume_fac * mean), None)
