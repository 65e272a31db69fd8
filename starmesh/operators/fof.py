"""Friends-of-friends clustering: labels, group order, and group catalogues.

Nodes whose box is no wider than the linking length are groups by themselves (here: sure nodes),
and two sure nodes that fit into it together are linked without a look at their points. Both is
done from the coarsest plane on, and pairs of sure nodes that are connected already are dropped
before they are refined. So dense regions and equal points cost a few nodes, not pairs of points.
What is left are pairs of leaves with points of which some are near and some are not; these are
compared tile by tile. A tile's groups become one star each; only points at tiles' edges go into
the connected components.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmesh.functions.geometry import into_box, wrap_centred
from starmesh.plans.observed import note
from starmesh.plans.shared import stored
from starmesh.plans.skew import by_degree

from .components import connected_components, contracted
from .index import PointIndex
from .points import dims
from .tiles import UNITS, Boxes, boxes_in, chunk_leaves, differences, few_in_chunks, in_chunks, leaf_nodes, plane_of, row_distances, tile_leaves, with_leaves
from .walk import Rule, begin, frame_of, refined, start_plane
from .windows import offsets
from .zorder import with_position

LEAF = 64
#: Pairs of points compared at once, and links held before they are contracted.
PAIRS, LINKS = 2_000_000, 1_000_000
#: With more points than this in a small cell, a few of each are tried first.
CROWD, FEW = 8, 4


class Linked(Rule):
    """Pairs of nodes that may hold linked points. A pair of sure nodes is told apart: LINK if all
    of its points are linked, BOTH if not. A sure node has no need to be looked into."""

    LINK, BOTH = 2, 3
    symmetric = True

    def __init__(self, rlink: float):
        self.r2 = rlink * rlink

    def kinds(self, receivers: Boxes, sources: Boxes) -> np.ndarray:
        near, far = receivers.gaps(sources)
        sure = (receivers.diameters() <= self.r2)[:, None] & (sources.diameters() <= self.r2)[None, :]
        kind = np.where(near > self.r2, self.NONE, np.where(sure, np.where(far <= self.r2, self.LINK, self.BOTH), self.REFINE))
        return np.where(sure & (receivers.node[:, None] == sources.node[None, :]), self.NONE, kind).astype(np.int8)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component after adding edges a - b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper


class _Links:
    """Links of points of one task, contracted now and then."""

    def __init__(self, x: np.ndarray, rlink: float, boxsize: float | None):
        self.x, self.r2, self.boxsize = x, rlink * rlink, boxsize
        self.label, self.held, self.n = np.arange(len(x)), [], 0

    def test(self, a: np.ndarray, b: np.ndarray) -> None:
        near = row_distances(self.x[a], self.x[b], self.boxsize) <= self.r2
        self.add(a[near], b[near])

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.n += len(a)
        if self.n > LINKS:
            self.contract()

    def contract(self) -> np.ndarray:
        if self.n:
            self.label = _joined(self.label, *(np.concatenate(v) for v in zip(*self.held, strict=True)))
        self.held, self.n = [], 0
        return self.label


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _cells(x: np.ndarray, side: float, boxsize: float | None) -> tuple[np.ndarray, int]:
    """Cells of at least `side` that points lie in, and how many a periodic box has to a side."""
    if boxsize:
        m = max(1, int(boxsize / side))
        return np.clip(np.floor(np.mod(x, boxsize) / boxsize * m).astype(np.int64), 0, m - 1), m
    return np.floor((x - x.min(0)) / side).astype(np.int64), 0


def _named(cells: np.ndarray) -> np.ndarray:
    """A number per cell. Cells that share one by chance only make more pairs to compare."""
    return (cells.astype(np.uint64) * _ODD[: cells.shape[1]]).sum(1, dtype=np.uint64)


def _near_cells(links: _Links, rows: np.ndarray, rlink: float, skip: bool) -> None:
    """Compares the points in rows with those of their own and adjacent cells. With skip, pairs of
    cells of one and the same group are passed over."""
    x, dim, boxsize = links.x[rows], links.x.shape[1], links.boxsize
    spread = float((x.max(0) - x.min(0)).max()) if len(x) else 0.0
    cells, m = _cells(x, (rlink * 1.001 + spread * 1e-12) or 1.0, boxsize)
    names = _named(cells)
    order = np.argsort(names, kind="stable")
    rows, cells, names = rows[order], cells[order], names[order]
    known, first, count = np.unique(names, return_index=True, return_counts=True)
    own = np.repeat(np.arange(len(known)), count)
    last = first + count
    least = lambda f: f.reduceat(links.label[rows], first)
    # With fewer than three cells to a side, the one before is the one after, or the cell itself.
    steps = [s for s in product(*[(-1, 0, 1) if not m or m > 2 else tuple(range(m))] * dim) if m and m <= 2 or s >= (0,) * dim]
    for step in steps:
        to = cells + np.array(step)
        to = np.mod(to, m) if m else to
        to = _named(to)
        at = np.minimum(np.searchsorted(known, to), len(known) - 1)
        hit = np.flatnonzero(known[at] == to)
        begin, end = first[at[hit]], last[at[hit]]
        begin = np.where(at[hit] == own[hit], np.maximum(begin, hit + 1), begin)
        if skip:
            links.contract()
            lo, hi = least(np.minimum), least(np.maximum)
            u, v = own[hit], at[hit]
            end = np.where((lo[u] == hi[u]) & (lo[v] == hi[v]) & (lo[u] == lo[v]), begin, end)
        size = np.maximum(end - begin, 0)
        # In blocks of points whose partners are about PAIRS together.
        cut = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1
        for part in np.split(np.arange(len(hit)), cut):
            n = size[part]
            total = int(n.sum())
            if total:
                a = np.repeat(hit[part], n)
                b = np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(total)
                links.test(rows[a], rows[b])


def _by_grid(links: _Links, rlink: float) -> None:
    """Links of points in up to three dimensions, by cells of the linking length."""
    dim = links.x.shape[1]
    rows = np.flatnonzero(np.isfinite(links.x).all(1))
    if not len(rows):
        return
    # Points of a cell as small as this are linked with its first one.
    side = rlink / int(np.ceil(np.sqrt(dim))) * (1 - 1e-9)
    if side:
        small = _named(_cells(links.x[rows], side, None)[0])
        order = np.argsort(small, kind="stable")
        inside, small = rows[order], small[order]
        first = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1]]))
        count = np.diff(np.append(first, len(small)))
        links.test(np.repeat(inside[first], count), inside)
        links.contract()
        if count.max() > CROWD:
            place = np.arange(len(small)) - np.repeat(first, count)
            _near_cells(links, np.sort(inside[place < FEW]), rlink, True)
            _near_cells(links, rows, rlink, True)
            return
    _near_cells(links, rows, rlink, False)


def _by_leaves(links: _Links, leaf: np.ndarray, rule: Linked) -> None:
    """Links of points in more dimensions, leaf by leaf."""
    b = boxes_in(leaf, links.x, links.boxsize)
    first = np.concatenate([[0], np.cumsum(b.n)])
    for at in range(0, len(b), 64):
        kind = rule.kinds(b.part(slice(at, at + 64)), b)
        for i, row in enumerate(kind, at):
            own = np.arange(first[i], first[i + 1])
            other = np.flatnonzero(row[i:]) + i
            if not len(other):
                continue
            one = links.contract()
            # Leaves of the same group as this one have nothing to add.
            if (one[own] == one[own[0]]).all():
                other = [j for j in other if not (one[first[j] : first[j + 1]] == one[own[0]]).all()]
            there = np.concatenate([np.arange(first[j], first[j + 1]) for j in other]) if len(other) else np.empty(0, int)
            step = max(1, PAIRS // len(own))
            for c in range(0, len(there), step):
                u, v = np.nonzero(differences(links.x[own], links.x[there[c : c + step]], links.boxsize) <= links.r2)
                links.add(own[u], there[c : c + step][v])


def _tile(rlink: float, xs: list[str], boxsize: float | None, per_tile: int):
    rule = Linked(rlink)

    def linked(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        tile, chunk = key
        p = p.sort_values("zindex")
        z, leaf = p["zindex"].to_numpy(), p["leaf"].to_numpy()
        links = _Links(p[xs].to_numpy(float), rlink, boxsize)
        b = boxes_in(leaf, links.x, boxsize)
        first = np.cumsum(b.n) - b.n
        sure = np.repeat(b.diameters() <= links.r2, b.n)
        links.add(np.flatnonzero(sure), np.repeat(first, b.n)[sure])
        if len(xs) <= 3:
            _by_grid(links, rlink)
        else:
            _by_leaves(links, leaf, rule)
        label = links.contract()
        far = label != np.arange(len(p))
        # Own points make the tile's stars; all others, and own ones of further chunks, are edges.
        star = (leaf[far] // per_tile == tile) & (chunk == 0)
        return pd.DataFrame({"star": star, "a": z[far], "b": z[label[far]]})

    return linked


def _sure(nodes: DataFrame, xs: list[str], rlink: float) -> DataFrame:
    """Nodes no wider than the linking length."""
    wide = reduce(lambda s, t: s + t, [(F.col(f"hi{x}") - F.col(f"lo{x}")) * (F.col(f"hi{x}") - F.col(f"lo{x}")) for x in xs])
    return nodes.where(wide <= rlink * rlink)


def _heads(nodes, p: int):
    """The z-index of the first point of nodes of plane p."""
    return nodes * (UNITS[p] * LEAF)


def refined_links(pairs: DataFrame, edges: DataFrame, leaves: DataFrame, n_leaves: int, rlink: float, p: int, xs: list[str], boxsize: float | None, known: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaves (q, t) whose points must be compared, from the pairs of plane p, and edges
    (a, b) of z-indices that follow from sure nodes: each stands for a node by its first point.
    known is the number of edges that there are already."""
    rule = Linked(rlink)
    while p:
        fan = UNITS[p] // UNITS[p - 1]
        last = (n_leaves - 1) // UNITS[p - 1]
        below = _sure(plane_of(leaves, p, xs), xs, rlink).select("node", F.explode(F.sequence(F.col("node") * fan, F.least(F.col("node") * fan + fan - 1, F.lit(last)))).alias("kid"))
        edges = edges.union(below.where(F.col("kid") % fan != 0).select(_heads(F.col("kid"), p - 1), _heads(F.col("node"), p)))
        found = stored(refined(pairs, leaves, leaves, rule, p, xs, boxsize), "fof-pairs")
        p -= 1
        of = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per kind
        known += of.get(rule.LINK, 0)
        edges = edges.union(found.where(F.col("kind") == rule.LINK).select(_heads(F.col("q"), p), _heads(F.col("t"), p)))
        pairs = found.where(F.col("kind") == rule.REFINE).select("q", "t")
        n_pairs = of.get(rule.REFINE, 0)
        if of.get(rule.BOTH):
            both = found.where(F.col("kind") == rule.BOTH).select("q", "t")
            if known:
                # Sure nodes that are connected already have nothing to add.
                group = stored(connected_components(edges, contract=True), "fof-groups")
                named = both.select("q", "t", _heads(F.col("q"), p).alias("a"), _heads(F.col("t"), p).alias("b")).join(group.toDF("a", "ga"), "a", "left").join(group.toDF("b", "gb"), "b", "left")
                both = stored(named.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("q", "t"), "fof-both")
            n_pairs += both.count()
            pairs = pairs.union(both)
        note(f"fof.pairs.plane{p}", n_pairs)
    return pairs, edges


def label_map(leaved: DataFrame, n: int, rlink: float, boxsize: float | None) -> DataFrame:
    """(zindex, component) of all points that are linked: the least z-index of their group."""
    spark, xs, rule = leaved.sparkSession, dims(leaved), Linked(rlink)
    n_leaves = -(-n // LEAF)
    p = start_plane(n_leaves)
    leaves = leaf_nodes(leaved, xs)
    leaves = stored(leaves, "fof-leaves") if p else leaves
    q, t, kind, own, _ = begin(leaves, leaves, rule, p, xs, boxsize)
    a, b = contracted(_heads(q[kind == rule.LINK], p), _heads(t[kind == rule.LINK], p))
    of = dict(zip(a.tolist(), b.tolist(), strict=True))
    group = lambda nodes: np.array([of.get(i, i) for i in _heads(nodes, p).tolist()], np.int64)
    keep = (kind == rule.REFINE) | ((kind == rule.BOTH) & (group(q) != group(t)))
    q, t = q[keep], t[keep]
    note(f"fof.pairs.plane{p}", len(q))
    edges = spark.createDataFrame(pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)}))
    per_tile = tile_leaves(n, LEAF, spark.sparkContext.defaultParallelism)
    if p:
        pairs, edges = refined_links(frame_of(spark, q, t), edges, leaves, n_leaves, rlink, p, xs, boxsize, len(a))
        need = stored(pairs.select(F.floor(F.col("q") / per_tile).alias("tile"), F.explode(F.array("q", "t")).alias("leaf")).distinct(), "fof-needs")
        inside = F.floor(F.col("leaf") / per_tile) == F.col("tile")
        around = in_chunks(need.where(~inside), chunk_leaves(LEAF, len(xs)))
        chunks = around.groupBy("tile").agg(F.max("chunk").alias("last"))
        within = need.where(inside).join(chunks, "tile", "left").select("tile", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long")))).alias("chunk"))
        need, looked_into = within.unionByName(around), need.where(inside).select(F.col("leaf").alias("node"))
        # Sure leaves that no tile looks into are stars of their first points.
        alone = _sure(leaves, xs, rlink).where("n > 1").join(looked_into, "node", "left_anti").select("node", "n")
    else:
        tile, leaf = np.concatenate([q, q]) // per_tile, np.concatenate([q, t]).astype(np.int64)
        inside = leaf // per_tile == tile
        around, chunks = few_in_chunks(spark, tile[~inside], leaf[~inside], chunk_leaves(LEAF, len(xs)))
        mine = sorted(set(zip(tile[inside].tolist(), leaf[inside].tolist(), strict=True)))
        mine = np.array([(i, j, c) for i, j in mine for c in range(chunks.get(i, 1))], np.int64).reshape(-1, 3)
        need = spark.createDataFrame(pa.table({c: mine[:, i] for i, c in enumerate(("tile", "leaf", "chunk"))})).unionByName(around)
        lone = (own.diameters() <= rule.r2) & (own.n > 1) & ~np.isin(own.node, leaf[inside])
        alone = spark.createDataFrame(pa.table({"node": own.node[lone], "n": own.n[lone]}))
    rows = leaved.join(need, "leaf").select("tile", "chunk", "leaf", "zindex", *xs)
    found = stored(rows.groupBy("tile", "chunk").applyInPandas(_tile(rlink, xs, boxsize, per_tile), "star boolean, a long, b long"), "fof-links")
    alone = alone.select(F.explode(F.sequence(F.col("node") * LEAF + 1, F.col("node") * LEAF + F.col("n") - 1)).alias("a"), (F.col("node") * LEAF).alias("b"))
    star = found.where("star").select("a", "b").union(alone)
    edges = edges.union(found.where("not star").select("a", "b"))
    centre = lambda c: star.toDF(c, f"{c}_centre")
    edges = edges.join(centre("a"), "a", "left").join(centre("b"), "b", "left").select(F.coalesce("a_centre", "a").alias("a"), F.coalesce("b_centre", "b").alias("b"))
    found = connected_components(edges, contract=True)
    whole = star.join(found.toDF("b", "component"), "b", "left").select(F.col("a").alias("zindex"), F.coalesce("component", "b").alias("component"))
    return whole.union(found)


def labels(points: DataFrame | PointIndex, rlink: float, boxsize: float | None = None, label: str = "z") -> DataFrame:
    """points with zindex and label. Points at most rlink apart are linked; groups are components.

    label "z" is the least zindex of the group; "input" is the id of that same point. A point
    without links is a group of its own. No task gets more than a tile and a chunk of points,
    however dense they are. An index is taken as it is stored, and nothing of it is sorted.
    """
    if isinstance(points, PointIndex):
        leaved, n = points.points.drop("zkey").withColumn("leaf", F.floor(F.col("zindex") / LEAF)), points.n
    else:
        leaved, n = with_leaves(points, LEAF)
    if not n:
        return leaved.drop("leaf").withColumn("label", F.col("zindex" if label == "z" else "id"))
    found = label_map(leaved, n, rlink, boxsize)
    named = leaved.drop("leaf").join(found, "zindex", "left").withColumn("label", F.coalesce("component", "zindex")).drop("component")
    if label == "z":
        return named
    named = stored(named, "fof-named")
    roots = named.where("zindex = label").select("label", F.col("id").alias("__root"))
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("__size"))
    return by_degree(named, roots.join(sizes, "label"), "label", "__size", n).withColumn("label", F.col("__root")).drop("__root", "__size")


def group_order(labelled: DataFrame) -> DataFrame:
    """Adds row: groups together, by the z-index of their roots, each beginning with its root."""
    return with_position(labelled, ["label", "zindex"], "row")


def catalogue(labelled: DataFrame, boxsize: float | None = None, npart_min: int = 20) -> DataFrame:
    """One row per group of at least npart_min points, by label (z-index of the root):
    label, count, offset, [mass,] com_pos*, com_inertia_radius, and com_vel*, v_rad, scale_factor
    where points have v*, v_rad, zplus1.

    offset is the group's first row in group order, small groups included. Means are taken
    relative to the root, which makes them right across a periodic boundary; weights are masses,
    or 1 without. A group may hold any share of the points: what points need to know of a large one
    is broadcast to them.
    """
    xs = dims(labelled)
    vs = [f"v{i}" for i in range(len(xs)) if f"v{i}" in labelled.columns]
    has = lambda c: c in labelled.columns
    m = F.col("mass") if has("mass") else F.lit(1.0)
    sizes = stored(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count")), "fof-group-sizes")
    groups = offsets(sizes, "label", "count").where(F.col("count") >= npart_min)
    roots = labelled.where("zindex = label").select(F.col("label").alias("__l"), *[F.col(c).alias(f"__0{c}") for c in xs + vs])
    groups = stored(groups.join(roots, groups.label == F.col("__l")).drop("__l"), "fof-groups")
    n = sizes.agg(F.sum("count")).first()[0] or 0
    rows = by_degree(labelled, groups, "label", "count", n)
    dx = [wrap_centred(F.col(x) - F.col(f"__0{x}"), boxsize) for x in xs]
    sums: list[Column] = [F.sum(m).alias("__m"), *[F.sum(m * d).alias(f"__s{x}") for d, x in zip(dx, xs, strict=True)], *[F.sum(m * (F.col(v) - F.col(f"__0{v}"))).alias(f"__s{v}") for v in vs]]
    if has("v_rad"):
        sums.append(F.sum(m * F.col("v_rad")).alias("__vrad"))
    if has("zplus1"):
        sums.append(F.sum(m / F.col("zplus1")).alias("__scale"))
    whole = rows.groupBy("label").agg(*sums).join(groups, "label")
    com = [into_box(F.col(f"__0{x}") + F.col(f"__s{x}") / F.col("__m"), boxsize).alias(f"com_pos{i}") for i, x in enumerate(xs)]
    whole = stored(whole.select("label", "count", "offset", "__m", *com, *[(F.col(f"__0{v}") + F.col(f"__s{v}") / F.col("__m")).alias(f"com_vel{i}") for i, v in enumerate(vs)], *([(F.col("__vrad") / F.col("__m")).alias("v_rad")] if has("v_rad") else []), *([(F.col("__scale") / F.col("__m")).alias("scale_factor")] if has("zplus1") else [])), "fof-means")
    centres = whole.select("label", "count", *[F.col(f"com_pos{i}").alias(f"__c{i}") for i in range(len(xs))])
    off = [wrap_centred(F.col(x) - F.col(f"__c{i}"), boxsize) for i, x in enumerate(xs)]
    spread = by_degree(labelled, centres, "label", "count", n).groupBy("label").agg((F.sum(m * reduce(lambda s, t: s + t, [d * d for d in off])) / F.sum(m)).alias("__r2"))
    out = whole.join(spread, "label").withColumn("com_inertia_radius", F.sqrt("__r2")).drop("__r2")
    return out.withColumnRenamed("__m", "mass") if has("mass") else out.drop("__m")


def labels_and_catalogue(points: DataFrame | PointIndex, rlink: float, boxsize: float | None = None, npart_min: int = 20) -> tuple[DataFrame, DataFrame]:
    """Points in group order (column row), and the catalogue."""
    named = stored(labels(points, rlink, boxsize), "fof-labelled")
    return group_order(named), catalogue(named, boxsize, npart_min)


def is_superset(sup: DataFrame, sub: DataFrame, column: str = "label", mask: Column | None = None) -> bool:
    """True if every group of sub lies in one group of sup. Both have id and a label. With mask, a
    condition on the columns of sub, only its points that fulfil it are looked at."""
    sub = sub if mask is None else sub.where(mask)
    a, b = sup.select("id", F.col(column).alias("__a")), sub.select("id", F.col(column).alias("__b"))
    return a.join(b, "id").groupBy("__b").agg(F.min("__a").alias("lo"), F.max("__a").alias("hi")).where("lo != hi").isEmpty()


def sort_catalogue(found: DataFrame, by: str = "count", descending: bool = True) -> DataFrame:
    return found.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "offset")


def group_sizes(labelled: DataFrame) -> DataFrame:
    """(count, groups): how many groups have each size."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count")).groupBy("count").agg(F.count(F.lit(1)).alias("groups"))
