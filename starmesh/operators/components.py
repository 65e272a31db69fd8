"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from starmesh.plans.shared import shared_dir
from starmesh.plans.skew import by_degree

#: Edges of a partition that are contracted at once.
BLOCK = 2_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, least vertex of its component) with the components of the edges u - v."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not (label[label] == label).all():
            label = label[label]
    far = label != np.arange(len(names))
    return names[far], names[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= BLOCK:
            u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(u) > BLOCK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                held, n = [], 0
            else:
                held, n = [(u, v)], len(u)
    if held:
        u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", contract: bool = False, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex that has an edge to another; component is the least id
    that can be reached.

    Ids are BIGINT. Loops, repeated edges and nulls are ignored; direction does not matter. Both
    steps reduce by partial aggregates and bring the minimum back to the edges; to those of a hub it is
    broadcast (`by_degree`), so they are never gathered in one task. Each round is written to the shared folder. The number of rounds grows
    with the logarithm of the longest path, not with its length. With contract each partition's
    edges are first replaced by stars of the same components, in Arrow blocks, and once fewer than
    BLOCK edges are left, a single task ends the rounds; without it only DataFrame operations are used.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        path = shared_dir(spark, "components")
        df.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), seen.get

    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v")
    last = None
    if contract:
        now, last = kept(now.mapInArrow(_contract, "u long, v long"))
    for _ in range(max_rounds):
        if last is not None and not last["n"]:
            break
        if contract and last["n"] < BLOCK:
            now, last = kept(now.coalesce(1).mapInArrow(_contract, "u long, v long"))
            break
        n = last["n"] if last is not None else now.count()
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = by_degree(both.where("v > u"), least, "u", "degree", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = by_degree(large, least, "u", "degree", n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = least.select("u", F.col("m").alias("v"))
        now, found = kept(small.union(least))
        if found == last:
            break
        last = found
    else:
        raise RuntimeError(f"connected_components: no end after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))
