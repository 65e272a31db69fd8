"""k-nearest-neighbour joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from starmesh.plans.observed import Tally, tally
from starmesh.plans.shared import stored

from .index import PointIndex
from .points import dims, union_types
from .runner import Tiled, tiled
from .tiles import CHUNK_VALUES, MANY_DIMS, Boxes, boxes_in, by_pivots, differences, from_pivots, matrix, packed, row_distances, segments, with_leaves
from .walk import Rule

#: Pairs of points measured at once.
BLOCK = 2_000_000
#: Queries and sources of a box inside a tile.
QUERIES, SOURCES = 48, 32
#: Sources next to a box of queries, for each of the k, that its bound is taken from before it meets all others.
CLOSE = 16
SCHEMA = "qid long, rank int, id long, r2 double"


class Nearest(Rule):
    """Sources that may hold one of a receiver's k nearest: those not beyond the receiver's bound, nor,
    where that is not known, beyond the distance within which nodes of k points surely lie."""

    def __init__(self, k: int):
        self.k = k

    def reach(self, receivers: Boxes, sources: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest squared distances of the sources, and what each receiver needs at most."""
        near, far = receivers.gaps(sources)
        bound = receivers.bound * (1 + 1e-9)
        open_ = ~np.isfinite(bound)
        if open_.any():
            some = far[open_]
            order = np.argsort(some, axis=1)
            n = np.cumsum(sources.n[order], axis=1)
            at = np.minimum((n < self.k).sum(1), some.shape[1] - 1)
            rows = np.arange(len(some))
            bound[open_] = np.where(n[rows, at] >= self.k, some[rows, order[rows, at]], np.inf)
        return near, far, bound

    def kinds(self, receivers: Boxes, sources: Boxes) -> np.ndarray:
        near, _, bound = self.reach(receivers, sources)
        return (near <= bound[:, None]).astype(np.int8)


def _prepared(leaved: DataFrame, xs: list[str], k: int, boxsize: float | None, bounds: bool = True, pivots: np.ndarray | None = None) -> DataFrame:
    """The points with two columns more, from one pass over their stored order, without a shuffle.

    kept: of sources at one place only the first k by id can be among k nearest; equal points are
    next to each other. A run that goes on in another segment has k kept points there again.
    Segments are cut to a chunk's number of values, as a task may read many ranges.
    bound: for a query a squared distance within which k sources are: those of its leaf and of the
    leaves before and after it. Infinite where these are not k, and without bounds.
    """
    typed = "ptype" in leaved.columns
    rows = leaved.select("zindex", "leaf", "id", *(["ptype"] if typed else []), *xs)
    schema = StructType([*rows.schema.fields, StructField("kept", BooleanType()), StructField("bound", DoubleType()), *[StructField(f"pivot{i}", DoubleType()) for i in range(0 if pivots is None else len(pivots))]])

    most = max(1, CHUNK_VALUES // len(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments(batches, most):
            x = matrix(part, xs)
            leaf = part["leaf"].to_numpy()
            source = part["ptype"].to_numpy() == 0 if typed else np.ones(len(x), bool)
            asked = ~source if typed else source
            own = np.flatnonzero(source)
            kept = np.zeros(len(x), bool)
            if len(own):
                at = np.arange(len(own))
                new = np.concatenate([[True], (x[own[1:]] != x[own[:-1]]).any(1)])
                kept[own[at - np.maximum.accumulate(np.where(new, at, 0)) < k]] = True
            bound = np.full(len(x), np.inf)
            first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            last = np.append(first[1:], len(x))
            finite = np.isfinite(x).all(1)
            for i in range(len(first) if bounds else 0):
                q = np.arange(first[i], last[i])
                q = q[asked[q] & finite[q]]
                s = np.arange(first[max(i - 1, 0)], last[min(i + 1, len(last) - 1)])
                s = s[kept[s] & finite[s]]
                if len(q) and len(s) >= k:
                    bound[q] = kth_within(x[q], x[s], k, boxsize)
            out = part.append_column("kept", pa.array(kept)).append_column("bound", pa.array(bound))
            if pivots is not None:
                with np.errstate(invalid="ignore", over="ignore"):
                    d = from_pivots(x, pivots)
                for j in range(d.shape[1]):
                    # Nothing is known of infinite points.
                    out = out.append_column(f"pivot{j}", pa.array(np.where(finite, d[:, j], np.inf)))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and how far they may be off."""
    mid = a.mean(0)
    a, b = a - mid, b - mid
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    # In place: this matrix is the largest thing that a tile makes.
    out = a @ b.T
    out *= -2
    out += na[:, None]
    out += nb
    return out, 2e-15 * (a.shape[1] + 8) * (np.sqrt(na.max()) + np.sqrt(nb.max())) ** 2


def kth_within(q: np.ndarray, s: np.ndarray, k: int, boxsize: float | None) -> np.ndarray:
    """For each query a squared distance that k of the sources are not beyond."""
    if boxsize or q.shape[1] < 4:
        return np.partition(differences(q, s, boxsize), k - 1, axis=1)[:, k - 1]
    r2, error = _rough(q, s)
    return np.partition(r2, k - 1, axis=1)[:, k - 1] + error


def nearest(qx: np.ndarray, sid: np.ndarray, sx: np.ndarray, k: int, boxsize: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, source, r2): for each query the k nearest sources by (r2, id), in order; sid ascends."""
    m = min(k, len(sx))
    r2 = None
    if m == len(sx):
        i, j = (v.ravel() for v in np.indices((len(qx), len(sx))))
    elif boxsize or qx.shape[1] < 4 or not (np.isfinite(qx).all() and np.isfinite(sx).all()):
        r2 = differences(qx, sx, boxsize)
        # All that are not beyond the k-th distance, so that ties can go by id.
        i, j = np.divmod(np.flatnonzero(~(r2 > np.partition(r2, m - 1, axis=1)[:, m - 1 : m])), len(sx))
    else:
        # Many dimensions: by a matrix product, and exactly for those that its error leaves near the k-th.
        rough, error = _rough(qx, sx)
        i, j = np.nonzero(rough <= np.partition(rough, m - 1, axis=1)[:, m - 1 : m] + 2 * error)
    d = r2[i, j] if r2 is not None else row_distances(qx, sx, boxsize, (i, j))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < m
    return i[top], j[top], d[top]


def _tile(k: int, xs: list[str], boxsize: float | None, pivots: list[str], seen: Tally):
    """What `_found` finds of two frames, as a frame."""
    import pandas as pd

    found = _found(k, xs, boxsize, pivots, seen)
    return lambda q, s: pd.DataFrame(found(q, s) or {"qid": [], "rank": [], "id": [], "r2": []})


def _found(k: int, xs: list[str], boxsize: float | None, pivots: list[str], seen: Tally):
    """Of the queries and sources of a tile, the columns of SCHEMA; nothing is copied whole but the ids and x*, once."""
    rule = Nearest(k)

    def run(q: pa.Table, s: pa.Table) -> dict[str, np.ndarray]:
        if not len(q) or not len(s):
            return {}
        if pivots:
            sleaf, qleaf = s["leaf"].to_numpy(), q["leaf"].to_numpy()
        else:
            # Runs of the order of all points may lie astride; inside a tile points are put into boxes anew.
            sleaf, qleaf = packed(matrix(s, xs), SOURCES), packed(matrix(q, xs), QUERIES)
        by, to = np.argsort(sleaf, kind="stable"), np.argsort(qleaf, kind="stable")
        sid, sx, qid, qx = s["id"].to_numpy()[by], matrix(s, xs, by), q["id"].to_numpy()[to], matrix(q, xs, to)
        sb, qb = boxes_in(sleaf[by], sx, boxsize, [s[c].to_numpy()[by] for c in pivots]), boxes_in(qleaf[to], qx, boxsize, [q[c].to_numpy()[to] for c in pivots])
        tested = 0
        s_at, q_at = np.concatenate([[0], np.cumsum(sb.n)]), np.concatenate([[0], np.cumsum(qb.n)])
        qb.bound = np.maximum.reduceat(q["bound"].to_numpy()[to], q_at[:-1])
        out = []
        held_by = lambda leaves: np.repeat(s_at[leaves] - np.cumsum(sb.n[leaves]) + sb.n[leaves], sb.n[leaves]) + np.arange(int(sb.n[leaves].sum()))
        for c in range(0, len(qb), 64):
            some = qb.part(slice(c, c + 64))
            # What is in reach of none of these at once is not looked at for each of them.
            gap, _, bound = rule.reach(some.whole(), sb)
            around = np.flatnonzero(gap[0] <= bound[0])
            if not len(around):
                continue
            near, far, bound = rule.reach(some, sb.part(around))
            for r in range(c, c + len(some)):
                reached = np.flatnonzero(near[r - c] <= bound[r - c])
                if not len(reached):
                    continue
                leaves, gap = around[reached], near[r - c][reached]
                rows = slice(q_at[r], q_at[r + 1])
                if sb.n[leaves].sum() > 2 * CLOSE * k:
                    # The closest leaves first; what they leave out of reach is not compared.
                    by = leaves[np.argsort(far[r - c][reached], kind="stable")]
                    close = held_by(by[: int(np.searchsorted(np.cumsum(sb.n[by]), CLOSE * k)) + 1])
                    step = max(1, BLOCK // len(close))
                    most = np.max([kth_within(qx[rows][at : at + step], sx[close], k, boxsize).max() for at in range(0, rows.stop - rows.start, step)])
                    tested += (rows.stop - rows.start) * len(close)
                    leaves = leaves[~(gap > most * (1 + 1e-9))]
                held = held_by(leaves)
                tested += (rows.stop - rows.start) * len(held)
                held = held[np.argsort(sid[held], kind="stable")]
                step = max(1, BLOCK // len(held))
                for at in range(0, rows.stop - rows.start, step):
                    i, j, d = nearest(qx[rows][at : at + step], sid[held], sx[held], k, boxsize)
                    out.append((qid[rows][at : at + step][i], np.arange(len(i)) - np.searchsorted(i, i) + 1, sid[held[j]], d))
        seen.add(len(q), len(s), tested)
        cols = [np.concatenate(v) for v in zip(*out, strict=True)]
        return {"qid": cols[0], "rank": cols[1].astype(np.int32), "id": cols[2], "r2": cols[3]} if cols else {}

    return run


def knn_pairs(source: DataFrame | PointIndex, k: int, query: DataFrame | PointIndex | None = None, boxsize: float | None = None, leaf_size: int | None = None) -> DataFrame:
    """(qid, rank, id, rad): for each query its k nearest sources, by distance, then id.

    Without query the set is joined with itself, and each point is its own first neighbour unless
    a duplicate has a smaller id. With fewer than k sources all of them are neighbours. Any number
    of dimensions; boxsize makes the domain periodic. Of equal sources only the k least ids are
    sent anywhere, and no task gets more than a tile of queries and a chunk of sources. An index is
    taken as it is stored: with it only queries that are not an index themselves are sorted.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if isinstance(source, PointIndex):
        src, asked, n = _of_index(source, query, k, boxsize)
        size = (source.leaf_size, query.leaf_size if isinstance(query, PointIndex) else source.leaf_size)
    else:
        if isinstance(query, PointIndex):
            query = query.points
        size = (leaf_size or max(48, 2 * k),) * 2
        src, asked, n = _of_points(source, query, k, boxsize, size[0])
    schema = "qid long, rank int, id long, rad double"
    if not min(n):
        return asked.sparkSession.createDataFrame([], schema)
    xs = dims(src)
    pivots = [c for c in src.columns if c.startswith("pivot")]
    found, many = tiled(Tiled(src, asked, (-(-n[0] // size[0]), -(-n[1] // size[1])), size, n[1], xs, boxsize, "knn", [*xs, *pivots]), Nearest(k), _found(k, xs, boxsize, pivots, tally("knn", src.sparkSession)), SCHEMA, ["bound", *pivots], pivots)
    if many > 1:
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("r2", "id"))).where(F.col("rank") <= k)
    return found.select("qid", "rank", "id", F.sqrt("r2").alias("rad"))


def _of_points(source: DataFrame, query: DataFrame | None, k: int, boxsize: float | None, size: int) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Sources, queries, and the number of points of the order that they have together, twice."""
    xs = dims(source)
    both = union_types(source.select("id", *xs), query.select("id", *xs)) if query is not None else source.select("id", *xs)
    pivots = None
    if len(xs) > MANY_DIMS and not boxsize:
        leaved, n, pivots = by_pivots(both, size)
    else:
        leaved, n = with_leaves(both, size, exact=False)
    if not n:
        return leaved, leaved, (0, 0)
    ready = stored(_prepared(leaved, xs, k, boxsize, pivots=pivots), "knn-points")
    return ready.where("kept"), ready if query is None else ready.where("ptype = 1"), (n, n)


def _of_index(index: PointIndex, query: DataFrame | PointIndex | None, k: int, boxsize: float | None) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """The same with sources in the index's order and queries in their own. Queries of their own have
    no bound but what the walk finds."""
    xs = index.xs
    if not index.n:
        return index.points, index.points, (0, 0)
    ready = stored(_prepared(index.points, xs, k, boxsize, bounds=query is None), "knn-points")
    if query is None:
        return ready.where("kept"), ready, (index.n, index.n)
    if isinstance(query, PointIndex):
        asked, n = query.points.select("zindex", "leaf", "id", *xs), query.n
    else:
        asked, n = with_leaves(query.select("id", *xs), index.leaf_size, exact=False)
    return ready.where("kept"), asked.withColumn("bound", F.lit(float("inf"))), (index.n, n)


def knn(source: DataFrame | PointIndex, k: int, query: DataFrame | PointIndex | None = None, boxsize: float | None = None, result: Sequence[str] = ("rad", "id"), reducer: Callable[[DataFrame], DataFrame] | None = None, leaf_size: int | None = None, order: str | None = None) -> DataFrame:
    """The k-nearest-neighbour join with the columns asked for.

    result may name rad, id, drad (the difference vector from query to neighbour, as an array), part
    (the whole source row, as a struct), rank_index (zindex, the neighbour's place in z-order), and
    any column of source, which comes joined by the neighbour's id. reducer gets the neighbour
    table (qid, rank, ...) and returns what it makes of it, such as an aggregate per qid. order is
    None, "input" (by qid) or "z" (by the query's place in z-order, in column qindex).
    """
    from .zorder import with_zindex

    pairs = knn_pairs(source, k, query, boxsize, leaf_size)
    placed_by = source if isinstance(source, PointIndex) else None
    source, query = (s.points if isinstance(s, PointIndex) else s for s in (source, query))
    asked, xs = source if query is None else query, dims(source)
    named = [c for c in result if c not in ("rad", "id", "drad", "part", "rank_index")]
    joined = source.select("id", *dict.fromkeys(named)) if named else None
    if "part" in result:
        part = source.select("id", F.struct(*source.columns).alias("part"))
        joined = part if joined is None else joined.join(part, "id")
    if "drad" in result:
        there = source.select("id", F.array(*xs).alias("__there"))
        joined = there if joined is None else joined.join(there, "id")
    if "rank_index" in result:
        placed = (source if placed_by else with_zindex(source.select("id", *xs))).select("id", F.col("zindex").alias("rank_index"))
        joined = placed if joined is None else joined.join(placed, "id")
    if joined is not None:
        pairs = pairs.join(joined, "id")
    if "drad" in result:
        from starmesh.functions.geometry import wrap

        here = asked.select(F.col("id").alias("qid"), F.array(*xs).alias("__here"))
        pairs = pairs.join(here, "qid").withColumn("drad", F.zip_with("__here", "__there", lambda a, b: wrap(a - b, boxsize)))
    out = pairs.select("qid", "rank", *result)
    if reducer:
        return reducer(out)
    if order == "input":
        return out.orderBy("qid", "rank")
    if order == "z":
        placed = with_zindex(asked.select("id", *xs)).select(F.col("id").alias("qid"), F.col("zindex").alias("qindex"))
        return out.join(placed, "qid").orderBy("qindex", "rank")
    return out


def mean_radius(neighbours: DataFrame) -> DataFrame:
    """A reducer: the mean distance of the neighbours after the first."""
    return neighbours.groupBy("qid").agg(F.avg(F.when(F.col("rank") > 1, F.col("rad"))).alias("mean_rad"))
