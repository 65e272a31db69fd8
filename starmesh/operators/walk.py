"""Pairs of nodes, from coarse to fine.

The walk begins at the finest plane of at most START nodes, whose boxes, a bounded number, come to
the driver. A rule says which pairs of them may hold near points. Each pair that stays is replaced
by the pairs of its nodes' children, plane by plane, and the rule is asked again; from here on all
is in tables, and a task sees the children of one node and of those near it. The number of pairs
per node depends on the geometry, not on the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmesh.plans.observed import note
from starmesh.plans.shared import stored

from .tiles import UNITS, Boxes, boxes_of, pivots_of, plane_of

#: Nodes of the plane where the walk begins, at most.
START = 1024
#: Box pairs that are compared at once.
BLOCK = 1_000_000
#: Where more than this share of all pairs stays, of a plane with so many nodes at least, boxes do not
#: tell points apart, and the walk ends.
SELECTIVE, TELLING = 0.9, 200


class Rule:
    """What a walk looks for. kinds(receivers, sources) gives a matrix: NONE where a pair is of no
    use, REFINE where it must be looked into, and other values as the rule likes."""

    NONE, REFINE = 0, 1
    #: True if a pair stands for both orders; then only pairs q <= t are walked.
    symmetric = False

    def kinds(self, receivers: Boxes, sources: Boxes) -> np.ndarray:
        raise NotImplementedError

    def found(self, receivers: Boxes, sources: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, t, kind) of the pairs that are of use, by number, a block of receivers at a time."""
        out = []
        step = max(1, BLOCK // max(1, len(sources)))
        for at in range(0, len(receivers), step):
            own = receivers.part(slice(at, at + step))
            kind = self.kinds(own, sources)
            if self.symmetric:
                kind = np.where(own.node[:, None] <= sources.node[None, :], kind, self.NONE)
            i, j = np.nonzero(kind)
            out.append((own.node[i], sources.node[j], kind[i, j]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int8),)


class Within(Rule):
    """Pairs that may hold points at most `radius` apart."""

    def __init__(self, radius: float):
        self.r2 = radius * radius

    def kinds(self, receivers: Boxes, sources: Boxes) -> np.ndarray:
        return (receivers.gaps(sources)[0] <= self.r2).astype(np.int8)


def start_plane(n_leaves: int) -> int:
    return next(p for p, unit in enumerate(UNITS) if n_leaves / unit <= START)


def begin(receivers: DataFrame, sources: DataFrame, rule: Rule, p: int, xs: list[str], boxsize: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Boxes, Boxes]:
    """Pairs of plane p, which has at most START nodes, with their boxes."""
    q = boxes_of(plane_of(receivers, p, xs).toPandas(), xs, boxsize)  # at most START rows
    t = q if sources is receivers else boxes_of(plane_of(sources, p, xs).toPandas(), xs, boxsize)
    return *rule.found(q, t), q, t


def refined(pairs: DataFrame, receivers: DataFrame, sources: DataFrame, rule: Rule, p: int, xs: list[str], boxsize: float | None) -> DataFrame:
    """(q, t, kind) of plane p - 1 from the pairs (q, t) of plane p."""
    fan = UNITS[p] // UNITS[p - 1]
    box = F.struct("node", "n", F.array(*[f"lo{x}" for x in xs], *[f"hi{x}" for x in xs], F.col("bound")).alias("b"))

    def kids(nodes: DataFrame, name: str) -> DataFrame:
        return plane_of(nodes, p - 1, xs).groupBy(F.floor(F.col("node") / fan).alias(name)).agg(F.collect_list(box).alias(f"{name}_kids"))

    rows = pairs.select("q", "t").join(kids(sources, "t"), "t").groupBy("q").agg(F.flatten(F.collect_list("t_kids")).alias("t_kids"))
    rows = rows.join(kids(receivers, "q"), "q").select("q_kids", "t_kids")
    dim = len(xs)

    def unpacked(col: pa.Array, i: int) -> Boxes:
        kids = col[i].values
        b = kids.field("b").flatten().to_numpy().reshape(-1, 2 * dim + 1)
        return Boxes(kids.field("node").to_numpy(), kids.field("n").to_numpy(), b[:, :dim], b[:, dim:-1], boxsize, b[:, -1], pivots_of(xs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, t, kind = rule.found(unpacked(batch.column(0), i), unpacked(batch.column(1), i))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(t), pa.array(kind.astype(np.int8))], names=["q", "t", "kind"])

    return rows.mapInArrow(run, "q long, t long, kind byte")


def frame_of(spark, q: np.ndarray, t: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"q": q.astype(np.int64), "t": t.astype(np.int64)}))


def node_pairs(receivers: DataFrame, sources: DataFrame, n_leaves: int, rule: Rule, xs: list[str], boxsize: float | None, name: str) -> tuple[DataFrame, int]:
    """(q, t) of the finest plane that the walk reaches, and that plane: 0 unless boxes of a plane
    above do not tell points apart. receivers and sources are tables of leaves."""
    p = start_plane(n_leaves)
    q, t, _, own, others = begin(receivers, sources, rule, p, xs, boxsize)
    note(f"{name}.pairs.plane{p}", len(q))
    return walked(frame_of(receivers.sparkSession, q, t), len(q), (len(own), len(others)), receivers, sources, rule, p, xs, boxsize, name)


def walked(pairs: DataFrame, n_pairs: int, nodes: tuple[int, int], receivers: DataFrame, sources: DataFrame, rule: Rule, p: int, xs: list[str], boxsize: float | None, name: str) -> tuple[DataFrame, int]:
    """node_pairs from the pairs of plane p, which has so many nodes."""
    most, few = nodes[0] * nodes[1], nodes[1] < TELLING
    while p and (few or n_pairs <= SELECTIVE * most):
        fan = UNITS[p] // UNITS[p - 1]
        pairs = stored(refined(pairs, receivers, sources, rule, p, xs, boxsize).select("q", "t"), f"{name}-pairs")
        most, n_pairs, p, few = n_pairs * fan * fan, pairs.count(), p - 1, False
        note(f"{name}.pairs.plane{p}", n_pairs)
    return pairs, p


def candidate_pairs(points: DataFrame, rule: Rule, boxsize: float | None = None, leaf_size: int = 64) -> tuple[DataFrame, DataFrame]:
    """For a pair algorithm of one's own: points with their leaf, and the pairs (q, t) of leaves that
    the rule keeps. Join points with them on both sides and compare what is left."""
    from .points import dims
    from .tiles import leaf_nodes, with_leaves

    xs = dims(points)
    leaved, n = with_leaves(points, leaf_size, exact=False)
    leaves = stored(leaf_nodes(leaved, xs), "walk-leaves")
    pairs, p = node_pairs(leaves, leaves, -(-n // leaf_size), rule, xs, boxsize, "walk")
    if p:
        each = lambda c: F.explode(F.sequence(F.col(c) * UNITS[p], F.least((F.col(c) + 1) * UNITS[p], F.lit(-(-n // leaf_size))) - 1))
        pairs = pairs.select(each("q").alias("q"), "t").select("q", each("t").alias("t"))
    return leaved, pairs


def dense_pairs(spark, n_nodes: int, group: int = 32, only_upper: bool = False) -> DataFrame:
    """(q, t): all pairs of groups of `group` nodes each, with q <= t if only_upper. Meant for a
    plane of few nodes: more than START groups are refused."""
    n = -(-n_nodes // group)
    if n > START:
        raise ValueError(f"{n} groups of nodes are too many for all pairs; take larger groups or a coarser plane")
    to = F.sequence(F.col("id") if only_upper else F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return spark.range(n).select(F.col("id").alias("q"), F.explode(to).alias("t"))


def simplified(nodes: DataFrame, pairs: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """The nodes (column node) that occur in a pair (q, t), and those of `always` (column node)."""
    seen = pairs.select(F.col("q").alias("node")).union(pairs.select("t"))
    seen = seen if always is None else seen.union(always.select("node"))
    return nodes.join(seen.distinct(), "node", "left_semi")
