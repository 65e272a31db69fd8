"""Z-order: sorting, global positions, and searches in sorted points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmesh.functions.zkey import BitRange, IntRange, bit_range, key_level, zkey
from starmesh.plans.shared import stored

from .points import dims, union_types

#: Rows of a range partition, about, and how many ranges there are at most: of more rows ranges are larger.
RANGE_ROWS, MOST_RANGES = 100_000, 100_000
#: Bits in which monotonically_increasing_id counts the rows of a partition.
ROW_BITS = 33


def with_zkey(points: DataFrame, span: BitRange | IntRange | None = None) -> DataFrame:
    """Adds the exact z-order key of all dimensions."""
    xs = dims(points)
    return points.withColumn("zkey", zkey(xs, span or bit_range(points, xs)))


def zsort(points: DataFrame) -> DataFrame:
    """All columns, sorted by z-order, then id. Spark samples the ranges and sorts each."""
    return with_zkey(points).orderBy("zkey", "id")


def with_position(df: DataFrame, by: list[str], out: str, n_rows: int | None = None) -> DataFrame:
    """Adds the global row number, from 0, in the order of `by`.

    Rows are dealt to ranges, as many as the rows need, and sorted there: one shuffle. Each range
    numbers its rows as it writes them; the ranges' sizes, MOST_RANGES rows at most, are added up on
    the driver and come back as a small map. Equal rows of `by` keep together.
    """
    n = df.count() if n_rows is None else n_rows
    parts = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    dealt = df.repartitionByRange(parts, *by) if parts > 1 else df.coalesce(1)
    dealt = stored(dealt.sortWithinPartitions(*by).withColumn(out, F.monotonically_increasing_id()), "zorder-ranges")
    if parts == 1:
        return dealt
    part = F.shiftright(out, ROW_BITS)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per range
    starts, at = [], 0
    for r in sizes:
        starts.append((r["part"], at - (r["part"] << ROW_BITS)))
        at += r["n"]
    shifts = df.sparkSession.createDataFrame(starts, "__part long, __shift long")
    return dealt.join(F.broadcast(shifts), part == F.col("__part")).withColumn(out, F.col(out) + F.col("__shift")).drop("__part", "__shift")


def with_zindex(points: DataFrame, span: BitRange | IntRange | None = None, keep_key: bool = False) -> DataFrame:
    """Adds zindex, each point's place in z-order; ties go by id."""
    out = with_position(with_zkey(points, span), ["zkey", "id"], "zindex")
    return out if keep_key else out.drop("zkey")


def search_sorted(source: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, position): for each query the number of source points before it in z-order.

    Both sets are sorted as one; a query stands before source points with an equal key.
    """
    xs = dims(source)
    both = union_types(queries.select("id", *xs), source.select("id", *xs))
    placed = with_position(with_zkey(both), ["zkey", "ptype", "id"], "place")
    # Of the places before a query, those of queries are counted by its rank among queries.
    own = with_position(placed.where("ptype = 0").select("id", "place"), ["place"], "rank")
    return own.select("id", (F.col("place") - F.col("rank")).alias("position"))


def search_leaves(leaved: DataFrame, queries: DataFrame, leaf: str = "leaf") -> DataFrame:
    """(id, leaf): for each query the leaf that holds it, or that it would fall next to.

    leaved has points with the names of their leaves, contiguous in z-order. A query lies between
    two source points; of these the one that it shares the smaller node with counts, by the level
    of the first differing bit of their keys, and the left one on a tie. Without source points the
    result is empty.
    """
    xs = dims(leaved)
    both = union_types(queries.select("id", *xs), leaved.select("id", *xs, F.col(leaf).alias("__leaf")))
    span = bit_range(both, xs)
    placed = stored(with_position(with_zkey(both, span), ["zkey", "ptype", "id"], "place"), "zorder-places")
    # Queries of a run without source points between them have the same neighbours.
    sources = with_position(placed.where("ptype = 1").select("place", "zkey", F.col("__leaf").alias("leaf")), ["place"], "number")
    sources = stored(sources, "zorder-sources")
    own = with_position(placed.where("ptype = 0").select("id", "place", "zkey"), ["place"], "rank")
    own = own.select("id", F.col("zkey").alias("__key"), (F.col("place") - F.col("rank")).alias("__right"))
    side = lambda name: sources.select(F.col("number").alias(f"__{name}"), F.col("zkey").alias(f"__{name}_key"), F.col("leaf").alias(f"__{name}_leaf"))
    found = own.join(side("right"), "__right", "left").withColumn("__left", F.col("__right") - 1).join(side("left"), "__left", "left")
    level = lambda name: F.when(F.col(f"__{name}_key").isNull(), F.lit(2**31 - 1)).otherwise(key_level(F.col("__key"), F.col(f"__{name}_key"), len(xs), span))
    return found.select("id", F.when(level("left") <= level("right"), F.col("__left_leaf")).otherwise(F.col("__right_leaf")).alias("leaf")).where("leaf is not null")


def adjacent_levels(placed: DataFrame, key: str = "zkey", by: str = "zindex", dim: int | None = None, span: BitRange | IntRange | None = None, out: str = "lvl") -> DataFrame:
    """Adds the level of the smallest node that holds a row and the next one in z-order, null for
    the last. The next row comes by an equality join on positions, so no window sees all rows."""
    dim = dim or len(dims(placed))
    after = placed.select((F.col(by) - 1).alias("__by"), F.col(key).alias("__next"))
    joined = placed.join(after, F.col(by) == F.col("__by"), "left")
    return joined.withColumn(out, F.when(F.col("__next").isNotNull(), key_level(F.col(key), F.col("__next"), dim, span))).drop("__by", "__next")


def morton(xs: list[str], lows: list[float], highs: list[float]) -> Column:
    """A place of a point along a z-curve through a box, as BIGINT: what keeps near points together
    where the exact order of equal cells does not matter. Expressions only."""
    bits = 62 // len(xs)
    out = F.lit(0).cast("long")
    cells = []
    for x, lo, hi in zip(xs, lows, highs, strict=True):
        share = (F.col(x) - lo) / ((hi - lo) or 1.0) * float(1 << min(bits, 30))
        cells.append(F.least(F.greatest(F.floor(share), F.lit(0).cast("long")), F.lit((1 << min(bits, 30)) - 1).cast("long")))
    for b in range(min(bits, 30)):
        for i, c in enumerate(cells):
            bit = F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(xs) + len(xs) - 1 - i))
    return out
