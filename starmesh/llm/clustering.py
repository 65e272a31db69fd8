"""Centroid clustering: plain Lloyd rounds on integer vectors, exact whatever the partitions.

Centroids, a fixed small number of them, are broadcast. A round is one pass over the stored vectors:
each Arrow batch is assigned in NumPy, each partition sums up the integer components of its vectors by
centroid, and a groupBy merges these sums. Integers make the result independent of all order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CLUSTERS, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
#: Components are held to this magnitude (65,536 before scaling), so that sums of squares fit in a long.
MOST = 1 << 26
#: Vectors assigned at once.
BLOCK = 20_000


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of vectors with exactly dim of them, none null,
    NaN or infinite. Components beyond MOST are held there."""
    x = F.col(vector_col)
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in order; fewer if there are no more. Rows
    that repeat an id go by their components. k rows come to the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1 if rows else 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of integer vectors; the lowest number of those at equal distance."""
    d2 = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    own = d2.argmin(1)
    return own, d2[np.arange(len(x)), own]


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for part in parts:
        for at in range(0, len(part), BLOCK):
            rows = part.iloc[at : at + BLOCK]
            yield rows, np.concatenate(rows["v"].to_numpy()).reshape(len(rows), -1).astype(np.int64)


def _summed(centroids):
    """A row per cluster that has vectors in the partition: how many, and the sums of their components."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centroids.value
        n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for _, x in _blocks(parts):
            own, _ = nearest(x, c)
            n += np.bincount(own, minlength=len(c))
            for i in np.unique(own):
                sums[i] += x[own == i].sum(0)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": pd.Series(list(sums[some]), dtype=object)})

    return run


def _assigned(centroids):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in _blocks(parts):
            own, d2 = nearest(x, centroids.value)
            yield pd.DataFrame({"vec_id": rows["vec_id"].astype("Int64"), "cluster": own.astype(np.int32), "distance": d2})

    return run


def lloyd(kept: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds: each becomes the floor of its vectors' mean, component by
    component; one without vectors stays. A round's result is len(centroids) rows."""
    sc, dim = kept.sparkSession.sparkContext, centroids.shape[1] if centroids.size else 0
    for _ in range(rounds if len(centroids) else 0):
        shared = sc.broadcast(centroids)
        sums = kept.select("v").mapInPandas(_summed(shared), "cluster int, n long, sums array<long>")
        merged = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).collect()
        shared.unpersist()
        centroids = centroids.copy()
        for r in merged:
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return centroids


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of all kept vectors, and the centroids. See `integer_vectors` for
    what is kept; repeated rows are vectors of their own; a null id stays null. With fewer than k
    vectors there are fewer centroids; without any the result is empty. Other columns are ignored."""
    kept = stored(integer_vectors(vectors, id_col, vector_col, dim, scale), "lloyd-vectors")
    centroids = lloyd(kept, first_centroids(kept, k, seed), rounds)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], schema), centroids
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    return stored(kept.mapInPandas(_assigned(shared), schema), "lloyd-assigned"), centroids


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (distances summed up over the cluster, and over all) and
    centroid_sha256, the hash of the centroid's components as decimal numbers, joined by commas."""
    per = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per cluster
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        none = F.lit(None).cast(kind)
        return reduce(lambda out, i: F.when(F.col("cluster") == i, F.lit(values[i]).cast(kind)).otherwise(out), range(len(values)), none)

    return assigned.withColumn("cluster_inertia", of_cluster([per.get(i, 0) for i in range(len(digest))], "long")).withColumn("inertia", F.lit(sum(per.values())).cast("long")).withColumn("centroid_sha256", of_cluster(digest, "string"))
