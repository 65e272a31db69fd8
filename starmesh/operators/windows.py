"""Prefix sums, segment ranks and other ordered functions, for keys of any number of rows.

Rows get their global position by a range sort. Stretches of positions are summed up first, one
row each, and rows inside a stretch by a window: no task sees more than a stretch of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .zorder import with_position

#: Positions of a stretch.
STRETCH = 65_536


def _stretched(df: DataFrame, keys: list[str], order: list[str], amount: Column) -> DataFrame:
    rows = with_position(df.withColumn("__amount", amount), [*keys, *order], "__at")
    return rows.withColumn("__stretch", F.floor(F.col("__at") / STRETCH))


def _with_stretches(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what per, a table of (keys, __stretch, ...), says of their stretch; null keys are equal."""
    named = per.withColumnsRenamed({k: f"__of_{i}" for i, k in enumerate(keys)} | {"__stretch": "__of"})
    same = F.col("__stretch") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    return rows.join(named, same).drop("__of", *[f"__of_{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], amount: Column, out: str) -> DataFrame:
    """Exclusive running sum of amount in each key (or in all rows), in the order given; rows that are equal
    in it have any order among themselves."""
    rows = _stretched(df, keys, order, amount)
    sums = rows.groupBy(*keys, "__stretch").agg(F.sum("__amount").alias("__sum"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum("__amount").over(W.partitionBy(*keys, "__stretch").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = _with_stretches(rows.withColumn("__inside", inside), sums, keys)
    return rows.withColumn(out, F.col("__before") + F.col("__inside")).drop("__amount", "__at", "__stretch", "__inside", "__before")


def bucket_prefix_sum(df: DataFrame, key: str, order: list[str], amount: Column | None = None, out: str = "prefix") -> DataFrame:
    """Exclusive running sum within each key, of 1 by default."""
    return running_sum(df, [key], order, amount if amount is not None else F.lit(1).cast("long"), out).withColumn(out, F.col(out).cast("long"))


def segment_rank(df: DataFrame, segment: str, key: str, tie: str, out: str = "rank") -> DataFrame:
    """Rank from 1 within a segment, by key, then tie."""
    return running_sum(df, [segment], [key, tie], F.lit(1).cast("long"), out).withColumn(out, (F.col(out) + 1).cast("int"))


def smallest_from_here(df: DataFrame, group: str, order: str, value: str, out: str = "least") -> DataFrame:
    """The least value of this row and all after it in its group."""
    rows = _stretched(df, [group], [order], F.col(value))
    least = rows.groupBy(group, "__stretch").agg(F.min("__amount").alias("__least"))
    after = W.partitionBy(group).orderBy("__stretch").rowsBetween(1, W.unboundedFollowing)
    least = least.withColumn("__after", F.min("__least").over(after)).drop("__least")
    inside = F.min("__amount").over(W.partitionBy(group, "__stretch").orderBy("__at").rowsBetween(0, W.unboundedFollowing))
    rows = _with_stretches(rows.withColumn("__inside", inside), least, [group])
    # least passes over nulls.
    return rows.withColumn(out, F.least("__inside", "__after")).drop("__amount", "__at", "__stretch", "__inside", "__after")


def offsets(df: DataFrame, group: str, count: str, out: str = "offset") -> DataFrame:
    """Offset of each group if groups stand one after another. One row per group is expected."""
    return running_sum(df, [], [group], F.col(count), out).withColumn(out, F.col(out).cast("long"))
