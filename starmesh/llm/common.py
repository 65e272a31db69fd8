"""What the training-data operators share: white space, shared tables, bounded broadcasts, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starmesh.plans.shared import shared_dir, stored  # noqa: F401

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast once it has been counted (8 to 40 bytes a row).
BROADCAST_ROWS = 400_000
#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch, at most, where rows are long.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def semi(df: DataFrame, keys: DataFrame, column: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose column is among keys. keys is broadcast if it counts at most bound rows;
    beyond that both sides are shuffled."""
    if keys.limit(bound + 1).count() <= bound:
        keys = F.broadcast(keys)
    return df.join(keys, column, "left_semi")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def ranked(df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str, n_rows: int, rows_per_bucket: int = 4096) -> DataFrame:
    """Exclusive running sum of amount in each key, in an order dealt by a hash of `order`.

    A key may hold any share of the rows. So rows are hashed to buckets; sums of buckets are
    accumulated in each key (one row a bucket), and rows in each bucket of a key. No window
    sees more than a bucket of rows, or the list of buckets of a key.
    """
    n_buckets = max(1, -(-n_rows // rows_per_bucket))
    rows = df.withColumn("__b", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(n_buckets))).withColumn("__a", amount)
    sums = rows.groupBy(*keys, "__b").agg(F.sum("__a").alias("__s"))
    over = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c"), F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__before"))
    inner = W.partitionBy(*keys, "__b").orderBy(F.xxhash64(*order), *order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__a").over(inner), F.lit(0)))
    same = F.col("__b") == F.col("__c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(sums, same).withColumn(out, F.col("__before") + F.col("__in")).drop("__b", "__c", "__a", "__in", "__before", *[f"__k{i}" for i in range(len(keys))])


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are run in here send fewer rows to a Python worker at once."""
    old = spark.conf.get(BATCH_KEY)
    # 0 or less is no bound.
    spark.conf.set(BATCH_KEY, str(min(int(old), BATCH_ROWS) if int(old) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, old)


def give_back() -> None:
    """Returns this process's free memory to the system. Workers outlive their tasks, and several lie
    idle beside those that work; without this each holds the most that it ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with the worker's free memory given back at the end of each task."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_chunks(batch: pa.RecordBatch, column: int = 1, most: int = CHUNK_BYTES):
    """Slices of an Arrow batch of about `most` bytes of text each, one row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
