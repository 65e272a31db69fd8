"""A runner of pair algorithms: a rule that prunes and accepts pairs of nodes, a kernel for points, a merge.

The rule is asked from coarse to fine (`walk`). A pair of nodes that it accepts is done with: its
points are never looked at. What is left in the end are pairs of leaves; their points meet in tiles
of bounded size, where the kernel compares leaf by leaf and gives partial results, to be merged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmesh.plans.observed import Tally, note, tally
from starmesh.plans.shared import stored

from .index import PointIndex
from .points import dims
from .tiles import UNITS, Boxes, boxes_in, chunk_leaves, differences, few_in_chunks, in_chunks, leaf_nodes, matrix, plane_of, tile_leaves, with_leaves
from .walk import Rule, begin, frame_of, refined, start_plane, walked

#: Pairs of points that a kernel of this module compares at once.
BLOCK = 2_000_000


@dataclass
class Tiled:
    """Two sides in order, with leaf, id and x*: sources and queries, how many leaves they have, of how
    many points, and how many points the queries have. boxes names the columns that leaves have bounds
    of, if not the coordinates alone."""

    src: DataFrame
    asked: DataFrame
    n_leaves: tuple[int, int]
    size: tuple[int, int]
    n: int
    xs: list[str]
    boxsize: float | None
    name: str
    boxes: list[str] | None = None


def tiled(job: Tiled, rule: Rule, tile: Callable, schema: str, extra: list[str] | None = None, more: list[str] | None = None) -> tuple[DataFrame, int]:
    """What tile(queries, sources) makes of the points that the rule leaves, and the greatest number of
    chunks that a tile's sources come in: then each query has a result from each chunk."""
    xs = job.boxes or job.xs
    src_leaves, own_leaves = leaf_nodes(job.src, xs), leaf_nodes(job.asked, xs, "bound" if "bound" in job.asked.columns else None)
    p = start_plane(max(job.n_leaves))
    if p:
        src_leaves, own_leaves = stored(src_leaves, f"{job.name}-source-leaves"), stored(own_leaves, f"{job.name}-query-leaves")
    q, t, _, own, others = begin(own_leaves, src_leaves, rule, p, xs, job.boxsize)
    note(f"{job.name}.pairs.plane{p}", len(q))
    if p:
        pairs, p = walked(frame_of(job.src.sparkSession, q, t), len(q), (len(own), len(others)), own_leaves, src_leaves, rule, p, xs, job.boxsize, job.name)
        return in_tiles(job, pairs, p, tile, schema, extra, more)
    return in_tiles(job, (q, t), 0, tile, schema, extra, more)


def in_tiles(job: Tiled, pairs: DataFrame | tuple[np.ndarray, np.ndarray], p: int, tile: Callable, schema: str, extra: list[str] | None = None, more: list[str] | None = None) -> tuple[DataFrame, int]:
    """The points of pairs (q, t) of plane p, in tiles; few pairs may be arrays. extra and more name
    further columns of queries and of sources. tile gets both as Arrow tables, which are not copied on
    their way, and gives columns of the schema."""
    spark, xs = job.src.sparkSession, job.xs
    per_tile, at_once = tile_leaves(job.n, job.size[1], spark.sparkContext.defaultParallelism), chunk_leaves(job.size[0], len(xs))
    if isinstance(pairs, tuple):
        need, last = few_in_chunks(spark, pairs[0] // per_tile, pairs[1], at_once)
        many, n_tiles = max(last.values(), default=0), len(last)
        chunks = spark.createDataFrame(pa.table({"tile": np.array(list(last.keys()), np.int64), "chunks": np.array(list(last.values()), np.int64)}))
    else:
        each = lambda c, n: F.explode(F.sequence(F.col(c) * UNITS[p], F.least((F.col(c) + 1) * UNITS[p], F.lit(n)) - 1)) if p else F.col(c)
        need = pairs.select(each("q", job.n_leaves[1]).alias("q"), "t").select(F.floor(F.col("q") / per_tile).alias("tile"), "t").distinct().select("tile", each("t", job.n_leaves[0]).alias("leaf"))
        need = in_chunks(need, at_once)
        chunks = need.groupBy("tile").agg((F.max("chunk") + 1).alias("chunks"))
        many, n_tiles = chunks.agg(F.max("chunks"), F.count(F.lit(1))).first()
    note(f"{job.name}.tiles", n_tiles)
    note(f"{job.name}.chunks", many or 0)
    if not many:
        return spark.createDataFrame([], schema), 0
    halo = job.src.join(need, "leaf").select("tile", "chunk", "leaf", "id", *(more or []), *xs)
    own = job.asked.select(F.floor(F.col("leaf") / per_tile).alias("tile"), "leaf", "id", *(extra or []), *xs)
    if many == 1:
        own = own.withColumn("chunk", F.lit(0).cast("long"))
    else:
        own = own.join(chunks, "tile").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    # New column identities: both sides may come from one table.
    halo = halo.toDF(*halo.columns)
    kinds = spark.createDataFrame([], schema).toArrow().schema

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        found = tile(q, s)
        return pa.Table.from_pydict(found, schema=kinds) if found else kinds.empty_table()

    return own.groupBy("tile", "chunk").cogroup(halo.groupBy("tile", "chunk")).applyInArrow(run, schema), many


class PairRule(Rule):
    """A rule of one's own. kinds gives NONE, REFINE, or ACCEPT and more where nothing needs to be known
    of the points; `Boxes.limits` bounds distances so that nodes inside accepted ones are accepted."""

    ACCEPT = 2


#: A kernel gets (ids, positions) of a leaf of queries and of the sources it must meet, sorted by leaf,
#: and gives columns of a partial result.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _kernel_tile(rule: PairRule, kernel: Kernel, xs: list[str], boxsize: float | None, seen: Tally):
    def run(q: pa.Table, s: pa.Table) -> dict[str, np.ndarray]:
        out, tested = [], 0
        if len(q) and len(s):
            qid, sid, qleaf, sleaf = q["id"].to_numpy(), s["id"].to_numpy(), q["leaf"].to_numpy(), s["leaf"].to_numpy()
            to, by = np.lexsort((qid, qleaf)), np.lexsort((sid, sleaf))
            qid, qx, sid, sx = qid[to], matrix(q, xs, to), sid[by], matrix(s, xs, by)
            qb, sb = boxes_in(qleaf[to], qx, boxsize), boxes_in(sleaf[by], sx, boxsize)
            q_at, s_at = np.concatenate([[0], np.cumsum(qb.n)]), np.concatenate([[0], np.cumsum(sb.n)])
            for c in range(0, len(qb), 64):
                # What is accepted was so in the walk too, there or in a node above.
                wanted = rule.kinds(qb.part(slice(c, c + 64)), sb) == rule.REFINE
                for r, row in enumerate(wanted, c):
                    leaves = np.flatnonzero(row)
                    if len(leaves):
                        held = np.concatenate([np.arange(s_at[i], s_at[i + 1]) for i in leaves])
                        own = slice(q_at[r], q_at[r + 1])
                        tested += (own.stop - own.start) * len(held)
                        step = max(1, BLOCK // max(1, own.stop - own.start))
                        for at in range(0, len(held), step):
                            part = held[at : at + step]
                            out.append(kernel(qid[own], qx[own], sid[part], sx[part]))
        seen.add(len(q), len(s), tested)
        return {c: np.concatenate([x[c] for x in out]) for c in out[0]} if out else {}

    return run


def run_pairs(source: DataFrame | PointIndex, rule: PairRule, kernel: Kernel, schema: str, query: DataFrame | PointIndex | None = None, boxsize: float | None = None, leaf_size: int = 64, name: str = "pairs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(partials, accepted, queries): what the kernel makes of the points of pairs of leaves that are
    left, in `schema`; (plane, q, t, kind, n_q, n_t) of the pairs of nodes that the rule accepts, with
    their numbers of points; and the queries with their leaf. A node of plane p holds the leaves
    from q * UNITS[p] on. A caller merges both; each pair of points is in exactly one of them.
    """
    src, n_src, size_src = _side(source, leaf_size)
    asked, n_own, size_own = (src, n_src, size_src) if query is None else _side(query, leaf_size)
    xs, spark = dims(src), src.sparkSession
    nodes = "plane int, q long, t long, kind byte, n_q long, n_t long"
    none = spark.createDataFrame([], schema), spark.createDataFrame([], nodes), asked
    if not n_src or not n_own:
        return none
    job = Tiled(src, asked, (-(-n_src // size_src), -(-n_own // size_own)), (size_src, size_own), n_own, xs, boxsize, name)
    src_leaves, own_leaves = stored(leaf_nodes(src, xs), f"{name}-source-leaves"), stored(leaf_nodes(asked, xs), f"{name}-query-leaves")
    p = start_plane(max(job.n_leaves))
    q, t, kind, own, others = begin(own_leaves, src_leaves, rule, p, xs, boxsize)
    rows = pa.table({"q": q.astype(np.int64), "t": t.astype(np.int64), "kind": kind.astype(np.int8)})
    found, accepted = spark.createDataFrame(rows).select("q", "t", F.col("kind").cast("byte").alias("kind")), None
    while True:
        sizes = lambda leaves, c: plane_of(leaves, p, xs).select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
        done = found.where(F.col("kind") >= rule.ACCEPT).join(sizes(own_leaves, "q"), "q").join(sizes(src_leaves, "t"), "t").select(F.lit(p).alias("plane"), "q", "t", "kind", "n_q", "n_t")
        accepted = done if accepted is None else accepted.union(done)
        left = found.where(F.col("kind") == rule.REFINE).select("q", "t")
        note(f"{name}.pairs.plane{p}", left.count())
        if not p:
            break
        found = stored(refined(left, own_leaves, src_leaves, rule, p, xs, boxsize), f"{name}-pairs")
        p -= 1
    partials, _ = in_tiles(job, left, 0, _kernel_tile(rule, kernel, xs, boxsize, tally(name, spark)), schema)
    return stored(partials, f"{name}-partials"), accepted, asked


def _side(points: DataFrame | PointIndex, leaf_size: int) -> tuple[DataFrame, int, int]:
    if isinstance(points, PointIndex):
        return points.points, points.n, points.leaf_size
    leaved, n = with_leaves(points, leaf_size, exact=False)
    return leaved, n, leaf_size


class Bins(PairRule):
    """Pairs of which it must be known between which radii they are; beyond the last they are of no use."""

    def __init__(self, radii: list[float]):
        self.edges = np.array([r * r for r in radii])

    def kinds(self, receivers: Boxes, sources: Boxes) -> np.ndarray:
        near, far = receivers.limits(sources)
        lo, hi = np.searchsorted(self.edges, near), np.searchsorted(self.edges, far)
        return np.where(lo == len(self.edges), self.NONE, np.where(lo == hi, self.ACCEPT + lo, self.REFINE)).astype(np.int8)


def pair_counts(source: DataFrame | PointIndex, radii: list[float], query: DataFrame | PointIndex | None = None, boxsize: float | None = None, leaf_size: int = 64) -> DataFrame:
    """(bin, radius, pairs): how many pairs are at most radius apart, but more than the radius before;
    radii ascend, at most 120. Without query pairs of different points of one set count once each,
    equal points are at distance 0; with query every query meets every source."""
    if list(radii) != sorted(set(radii)) or not radii or radii[0] < 0 or len(radii) > 120:
        raise ValueError("radii must ascend")
    rule, edges = Bins(radii), np.array([r * r for r in radii])

    def kernel(qid, qx, sid, sx):
        at = np.searchsorted(edges, differences(qx, sx, boxsize))
        n = np.bincount(at.ravel(), minlength=len(edges) + 1)[: len(edges)]
        some = np.flatnonzero(n)
        return {"bin": some.astype(np.int32), "pairs": n[some]}

    partials, accepted, asked = run_pairs(source, rule, kernel, "bin int, pairs long", query, boxsize, leaf_size, "pair-counts")
    counted = partials.union(accepted.select((F.col("kind") - rule.ACCEPT).cast("int"), F.col("n_q") * F.col("n_t")))
    if query is None:
        counted = counted.union(asked.agg(F.lit(0).alias("bin"), (-F.count(F.lit(1))).alias("pairs")))
    counted = counted.groupBy("bin").agg(F.sum("pairs").alias("pairs"))
    each = asked.sparkSession.createDataFrame(list(enumerate(map(float, radii))), "bin int, radius double")
    n = F.coalesce("pairs", F.lit(0).cast("long"))
    return each.join(counted, "bin", "left").select("bin", "radius", (F.floor(n / 2) if query is None else n).alias("pairs"))


class Inside(PairRule):
    """Pairs at most a radius apart."""

    def __init__(self, radius: float):
        self.r2 = radius * radius

    def kinds(self, receivers: Boxes, sources: Boxes) -> np.ndarray:
        near, far = receivers.limits(sources)
        return np.where(near > self.r2, self.NONE, np.where(far <= self.r2, self.ACCEPT, self.REFINE)).astype(np.int8)


def density(source: DataFrame | PointIndex, radius: float, query: DataFrame | PointIndex | None = None, boxsize: float | None = None, leaf_size: int = 64) -> DataFrame:
    """(id, count): for each query how many sources are at most radius away; without query each point
    counts itself too. A node that is inside as a whole adds its number of points without a look at them."""
    r2 = radius * radius

    def kernel(qid, qx, sid, sx):
        return {"id": qid, "count": (differences(qx, sx, boxsize) <= r2).sum(1)}

    partials, accepted, asked = run_pairs(source, Inside(radius), kernel, "id long, count long", query, boxsize, leaf_size, "density")
    per = stored(accepted.groupBy("plane", "q").agg(F.sum("n_t").alias("count")), "density-nodes")
    planes = [r["plane"] for r in per.select("plane").distinct().collect()]  # a row per plane
    whole = partials.select("id", "count")
    for p in planes:
        some = per.where(F.col("plane") == p).select("q", "count")
        whole = whole.union(asked.select("id", F.floor(F.col("leaf") / UNITS[p]).alias("q")).join(some, "q").select("id", "count"))
    whole = whole.union(asked.select("id", F.lit(0).cast("long")))
    return whole.groupBy("id").agg(F.sum("count").alias("count"))
