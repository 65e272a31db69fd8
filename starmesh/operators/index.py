"""A stored index: points in z-order, their leaves with boxes, and what keys mean. It is built once and
outlives the session; nearest neighbours, clusters, pair counts and streams take it instead of points
and then sort none of them again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmesh.functions.zkey import BitRange, IntRange, bit_range, zkey
from starmesh.plans.observed import note
from starmesh.plans.shared import shared_dir

from .points import dims
from .tiles import leaf_nodes, segments
from .tree import common_bits, key_length
from .zorder import search_leaves, search_sorted, with_position

LEAF = 64
#: Points that are merged into an index through a broadcast; more are sorted with all others.
MERGE_POINTS = 200_000
#: Queries that are searched for through a broadcast.
SEARCH_QUERIES = 400_000


@dataclass(frozen=True)
class PointIndex:
    """points: id, x0, ... and all other columns, with zkey, zindex and leaf. leaves: (node, n, bound,
    lo*, hi*) of each leaf, a run of leaf_size points. span: the bits that keys hold."""

    path: str
    points: DataFrame
    leaves: DataFrame
    n: int
    leaf_size: int
    span: BitRange | IntRange

    @property
    def xs(self) -> list[str]:
        return dims(self.points)

    @property
    def n_leaves(self) -> int:
        return -(-self.n // self.leaf_size)


def build_index(points: DataFrame, path: str | None = None, leaf_size: int = LEAF, span: BitRange | IntRange | None = None) -> PointIndex:
    """Sorts points once (one range shuffle) and stores them below path, by default a fresh folder
    that all executors reach. Ties in z-order go by id. span may be wider than the points need, for
    points to come."""
    xs = dims(points)
    span = span or bit_range(points, xs)
    placed = with_position(points.withColumn("zkey", zkey(xs, span)), ["zkey", "id"], "zindex")
    note("index.sorted", 1)
    return _written(placed, points.sparkSession, path, leaf_size, span)


def _written(placed: DataFrame, spark: SparkSession, path: str | None, leaf_size: int, span: BitRange | IntRange) -> PointIndex:
    path = path or shared_dir(spark, "index")
    placed.withColumn("leaf", F.floor(F.col("zindex") / leaf_size)).write.parquet(f"{path}/points")
    stored = spark.read.parquet(f"{path}/points")
    leaf_nodes(stored, dims(stored)).write.parquet(f"{path}/leaves")
    n = stored.count()
    # The manifest comes last: an index without one was not finished.
    row = (n, leaf_size, span.top, span.low, isinstance(span, IntRange))
    spark.createDataFrame([row], "n long, leaf_size int, top int, low int, whole boolean").coalesce(1).write.parquet(f"{path}/manifest")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PointIndex:
    m = spark.read.schema("n long, leaf_size int, top int, low int, whole boolean").parquet(f"{path}/manifest").first()
    if m is None:
        raise ValueError(f"no finished index in {path}")
    span = IntRange() if m["whole"] else BitRange(m["top"], m["low"])
    return PointIndex(path, spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/leaves"), m["n"], m["leaf_size"], span)


def _sort_keys(zkeys: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Fixed-length strings in the order of (zkey, id)."""
    tail = (ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes()
    both = [k + tail[8 * i : 8 * i + 8] for i, k in enumerate(zkeys)]
    return np.array(both, f"S{len(both[0])}") if both else np.empty(0, "S1")


def _covers(wide: BitRange | IntRange, narrow: BitRange | IntRange) -> bool:
    return isinstance(wide, IntRange) == isinstance(narrow, IntRange) and wide.top >= narrow.top and wide.low <= narrow.low


def merged(index: PointIndex, more: DataFrame, path: str | None = None) -> PointIndex:
    """A new index of the index's points and more, which has the same columns. Few points are broadcast
    and merged into each stored stretch in one pass, so that nothing that is stored is sorted or
    shuffled. Many points, or points with bits that the index's keys do not hold, are sorted together
    with all others."""
    spark, names = more.sparkSession, [c for c in index.points.columns if c not in ("zkey", "zindex", "leaf")]
    more = more.select(*names)
    span = bit_range(more, index.xs)
    few = more.limit(MERGE_POINTS + 1).count() <= MERGE_POINTS
    if not few or not _covers(index.span, span) or not index.n:
        wide = index.span if isinstance(span, IntRange) or not index.n else BitRange(max(span.top, index.span.top), min(span.low, index.span.low))
        return build_index(index.points.select(*names).unionByName(more), path, index.leaf_size, wide if index.n else None)
    plain = index.points.drop("leaf", "zindex")
    kept = plain.columns
    rows = more.withColumn("zkey", zkey(index.xs, index.span)).select(*kept).toArrow()  # at most MERGE_POINTS rows
    keys = _sort_keys(rows["zkey"].to_pylist(), rows["id"].to_numpy())
    order = np.argsort(keys, kind="stable")
    held = spark.sparkContext.broadcast((keys[order], rows.take(pa.array(order))))
    # A stretch takes the new points from its first row on, up to the first row of the next one.
    heads = _stretch_heads(index)
    at = np.array([h[0] for h in heads])
    bound = np.searchsorted(held.value[0], _sort_keys([h[1] for h in heads], np.array([h[2] for h in heads])))
    bound[0] = 0
    ends = np.append(bound[1:], len(keys))

    def run(batches):
        own, new = held.value
        for part in segments(batches):
            z0 = part["zindex"][0].as_py()
            z1 = z0 + part.num_rows
            # A task may read several stretches as one.
            first, last = np.searchsorted(at, z0), np.searchsorted(at, z1)
            if at[first] != z0:
                raise RuntimeError("the index was read in other stretches than before")
            lo, hi = int(bound[first]), int(ends[last - 1])
            old = part.select(kept)
            both = pa.concat_tables([old, new.slice(lo, hi - lo).cast(old.schema)])
            place = np.argsort(_sort_keys(both["zkey"].to_pylist(), both["id"].to_numpy()), kind="stable")
            out = both.take(pa.array(place)).append_column("zindex", pa.array(np.arange(z0 + lo, z0 + lo + both.num_rows)))
            yield from out.combine_chunks().to_batches()

    placed = index.points.drop("leaf").mapInArrow(run, plain.schema.add("zindex", "long"))
    return _written(placed, spark, path, index.leaf_size, index.span)


def _stretch_heads(index: PointIndex) -> list[tuple]:
    """(zindex, zkey, id, leaf) of the first row of each stored stretch, in order: of as many rows as
    there are ranges, zorder.MOST_RANGES at most."""
    rows = index.points.select("zindex", "zkey", "id", "leaf").mapInArrow(_heads, "zindex long, zkey binary, id long, leaf long").collect()
    return sorted(tuple(r) for r in rows)


def search(index: PointIndex, queries: DataFrame) -> DataFrame:
    """(id, position, leaf): for each query the number of the index's points before it in z-order, and
    the leaf that it falls into: of the points before and after it that with which it shares the
    smaller node, the one before on a tie. A query stands before points with an equal key.

    Up to SEARCH_QUERIES queries are broadcast, sorted, and merged with each stored stretch in one pass:
    the index is neither sorted nor shuffled. More, or such with bits that the index's keys do not
    hold, are sorted with the points. Without points the result has null leaves.
    """
    xs = index.xs
    queries = queries.select("id", *xs)
    if not index.n:
        return queries.select("id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("long").alias("leaf"))
    few = queries.limit(SEARCH_QUERIES + 1).count() <= SEARCH_QUERIES
    if not few or not _covers(index.span, bit_range(queries, xs)):
        points = index.points.select("id", *xs, "leaf")
        return search_sorted(points, queries).join(search_leaves(points, queries), "id", "left")
    rows = queries.withColumn("zkey", zkey(xs, index.span)).select("id", "zkey").toArrow()  # at most SEARCH_QUERIES rows
    width, dim, total = len(index.points.select("zkey").first()[0]), len(xs), key_length(len(xs), index.span)
    keys = _plain_keys(rows["zkey"].to_pylist(), width)
    order = np.argsort(keys, kind="stable")
    held = queries.sparkSession.sparkContext.broadcast((keys[order], rows["id"].to_numpy()[order]))
    heads = _stretch_heads(index)
    at, head_keys, head_leaves = np.array([h[0] for h in heads]), [h[1] for h in heads], [h[3] for h in heads]
    # A query belongs to the last stretch whose first key is less.
    bound = np.searchsorted(held.value[0], _plain_keys(head_keys, width), side="right")
    bound[0] = 0
    ends = np.append(bound[1:], len(keys))

    def run(batches):
        asked, ids = held.value
        for part in segments(batches):
            z0 = part["zindex"][0].as_py()
            first, last = np.searchsorted(at, z0), np.searchsorted(at, z0 + part.num_rows)
            if at[first] != z0:
                raise RuntimeError("the index was read in other stretches than before")
            q = slice(int(bound[first]), int(ends[last - 1]))
            mine = asked[q]
            raw, leaf = part["zkey"].to_pylist(), part["leaf"].to_numpy()
            if last < len(at):
                raw, leaf = [*raw, head_keys[last]], np.append(leaf, head_leaves[last])
            own = _plain_keys(raw, width)
            place = np.searchsorted(own, mine)
            bytes_of = lambda k: np.frombuffer(k.astype(f"S{width}").tobytes(), np.uint8).reshape(len(k), width)  # noqa: B023, E731
            there, asked_bytes = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width), bytes_of(mine)
            shared = []
            for side in (place - 1, place):
                bits = common_bits(there[np.clip(side, 0, len(raw) - 1)], asked_bytes, dim, total) if len(mine) else np.empty(0, np.int32)
                # Keys of different class share no node.
                bits = np.where(bits < 2 * dim, 0, bits)
                shared.append(np.where((side < 0) | (side >= len(raw)), -1, bits))
            chosen = np.where(shared[0] >= shared[1], place - 1, place)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array((z0 + place).astype(np.int64)), pa.array(leaf[chosen].astype(np.int64))], names=["id", "position", "leaf"])

    return index.points.select("zindex", "zkey", "leaf").mapInArrow(run, "id long, position long, leaf long")


def _plain_keys(zkeys: list[bytes], width: int) -> np.ndarray:
    """Keys of one length as strings, in whose order missing zeros at the end make no difference."""
    return np.frombuffer(b"".join(zkeys), f"S{width}") if zkeys else np.empty(0, f"S{width}")


def _heads(batches):
    for part in segments(batches):
        yield from part.slice(0, 1).to_batches()
