import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starmesh import queries
from starmesh.functions.zkey import BitRange, bit_range, keys
from starmesh.operators import fof, neighbors, tiles, tree, walk, windows, zorder
from starmesh.operators.components import connected_components
from starmesh.operators.points import of_type, point_set, same_rows, union_types
from starmesh.operators.tiles import differences, packed
from starmesh.plans.observed import Tally, statistics, summary

NAN, INF = float("nan"), float("inf")


def points(spark, x, n=None, **more):
    x = np.asarray(x, float)
    df = pd.DataFrame({"id": np.arange(len(x)), **{f"x{i}": x[:, i] for i in range(x.shape[1])}, **more})
    out = spark.createDataFrame(df)
    return out.repartition(n) if n else out


def brute_knn(x, q, k, box=None):
    out = []
    for i in range(len(q)):
        r = None
        for a in range(x.shape[1]):
            d = q[i, a] - x[:, a]
            if box:
                d = np.where(d < -box / 2, d + box, np.where(d >= box / 2, d - box, d))
            r = d * d if r is None else r + d * d
        o = np.lexsort((np.arange(len(x)), r))[:k]
        out += [(i, j + 1, int(o[j]), float(np.sqrt(r[o[j]]))) for j in range(len(o))]
    return sorted(out)


def got_knn(df):
    return sorted(map(tuple, df.select("qid", "rank", "id", "rad").collect()))


def components_of(x, r, box=None):
    n = len(x)
    lab = list(range(n))

    def find(i):
        while lab[i] != i:
            lab[i] = lab[lab[i]]
            i = lab[i]
        return i

    for i in range(n):
        d = x[i] - x[i:]
        if box:
            d = np.where(d < -box / 2, d + box, np.where(d >= box / 2, d - box, d))
        for j in np.flatnonzero((d * d).sum(1) <= r * r):
            a, b = find(i), find(i + int(j))
            lab[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def test_zsort_with_infinities_and_nan():
    rows = np.array([(0.1, 0.1, 0.5), (NAN, NAN, NAN), (0.5, 0.1, 0.1), (INF, 0.2, INF), (-0.7, INF, 0), (-INF, -INF, -INF), (0.3, 0.3, 0.3)])
    k = keys(rows, BitRange(0, -60))
    assert sorted(range(7), key=lambda i: k[i]) == [5, 4, 6, 0, 2, 3, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3, allow_subnormal=False), st.floats(-1e3, 1e3, allow_subnormal=False)), min_size=2, max_size=12))
def test_keys_follow_the_comparator(rows):
    x = np.array(rows, float) + 0.0
    size = np.abs(x[x != 0])
    if not len(size) or size.min() < 1e-6:
        return
    span = BitRange(int(np.frexp(size.max())[1]) - 1, int(np.frexp(size.min())[1]) - 53)
    k = keys(x, span)

    def level(a, b):
        if (a < 0) != (b < 0):
            return 10**6
        u, v = (int(abs(t) * 2.0**-span.low) for t in (a, b))
        return (u ^ v).bit_length()

    for i in range(len(x)):
        for j in range(len(x)):
            levels = [level(a, b) for a, b in zip(x[i], x[j], strict=True)]
            at = int(np.argmax(levels))
            assert (k[i] < k[j]) == (max(levels) > 0 and x[i][at] < x[j][at])


@pytest.mark.parametrize(("dim", "box", "k"), [(1, None, 3), (2, 1.0, 5), (3, None, 8), (5, None, 13), (3, 170.0, 4)])
def test_knn_against_brute_force(spark, dim, box, k):
    rng = np.random.default_rng(dim)
    x = rng.uniform(0, box or 1.0, (700, dim))
    x[100:150] = x[:50]
    assert got_knn(neighbors.knn_pairs(points(spark, x), k, boxsize=box, leaf_size=32)) == brute_knn(x, x, k, box)


def test_knn_query_set_few_sources_and_empty(spark):
    rng = np.random.default_rng(1)
    x, q = rng.uniform(-1, 1, (300, 2)), rng.uniform(-0.5, 0.5, (200, 2))
    assert got_knn(neighbors.knn_pairs(points(spark, x), 4, query=points(spark, q))) == brute_knn(x, q, 4)
    assert got_knn(neighbors.knn_pairs(points(spark, x[:3]), 5)) == brute_knn(x[:3], x[:3], 5)
    none = points(spark, x).where("id < 0")
    assert neighbors.knn_pairs(none, 3).count() == 0
    assert neighbors.knn_pairs(points(spark, x), 3, query=none).count() == 0
    with pytest.raises(ValueError, match="k must"):
        neighbors.knn_pairs(none, 0)


def test_knn_does_not_depend_on_partitions_and_shift(spark):
    x = np.random.default_rng(2).integers(0, 64, (400, 2)) / 64
    one = got_knn(neighbors.knn_pairs(points(spark, x, 1), 5))
    assert got_knn(neighbors.knn_pairs(points(spark, x, 7), 5)) == one
    assert got_knn(neighbors.knn_pairs(points(spark, x + 2.0, 3), 5)) == one


def test_knn_result_columns_and_reducer(spark):
    x = np.random.default_rng(3).uniform(0, 1, (60, 2))
    p = points(spark, x, kind=[i % 3 for i in range(60)])
    out = neighbors.knn(p, 3, result=("id", "kind")).toPandas()
    assert list(out.columns) == ["qid", "rank", "id", "kind"] and (out["kind"] == out["id"] % 3).all()
    mean = neighbors.knn(p, 3, result=("rad",), reducer=neighbors.mean_radius)
    assert mean.count() == 60 and mean.where("mean_rad <= 0").count() == 0


@pytest.mark.parametrize(("dim", "box", "r"), [(2, 1.0, 0.02), (3, None, 0.06), (1, None, 0.001)])
def test_fof_labels(spark, dim, box, r):
    x = np.random.default_rng(dim).uniform(0, 1, (1200, dim))
    f = fof.labels(points(spark, x), r, box).toPandas().sort_values("id")
    want = components_of(x, r, box)
    roots = f.groupby(want)["zindex"].min()
    assert (f["label"].to_numpy() == roots.loc[want].to_numpy()).all()
    by_input = fof.labels(points(spark, x, 5), r, box, label="input").toPandas().sort_values("id")
    root_id = f.set_index("zindex")["id"]
    assert (by_input["label"].to_numpy() == root_id.loc[f["label"]].to_numpy()).all()


def test_fof_catalogue_across_the_boundary(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.01, (40, 2)) for c in ((0.0, 0.5), (0.4, 0.4), (0.9, 0.05))]) % 1.0
    mass = rng.uniform(1, 2, len(x))
    v = rng.normal(size=(len(x), 2))
    pts, cat = fof.labels_and_catalogue(points(spark, x, mass=mass, v0=v[:, 0], v1=v[:, 1], zplus1=np.full(len(x), 4.0)), 0.02, 1.0, npart_min=20)
    a, c = pts.toPandas().sort_values("row"), fof.sort_catalogue(cat).toPandas()
    assert (a["row"].to_numpy() == np.arange(len(x))).all()
    assert len(c)
    for _, g in c.iterrows():
        own = a.iloc[int(g["offset"]) : int(g["offset"] + g["count"])]
        assert (own["label"] == g["label"]).all() and own["zindex"].iloc[0] == g["label"]
        ids, m = own["id"].to_numpy(), own["mass"].to_numpy()
        root = own[["x0", "x1"]].to_numpy()[0]
        d = (own[["x0", "x1"]].to_numpy() - root + 0.5) % 1 - 0.5
        com = (root + (m[:, None] * d).sum(0) / m.sum()) % 1
        off = (own[["x0", "x1"]].to_numpy() - com + 0.5) % 1 - 0.5
        assert np.allclose([g["mass"], g["com_pos0"], g["com_pos1"]], [m.sum(), *com])
        assert np.isclose(g["com_inertia_radius"], np.sqrt((m * (off**2).sum(1)).sum() / m.sum()))
        assert np.isclose(g["com_vel1"], (m * v[ids, 1]).sum() / m.sum()) and np.isclose(g["scale_factor"], 0.25)


def test_fof_superset_and_sizes(spark):
    p = points(spark, np.random.default_rng(5).uniform(0, 1, (400, 2)))
    wide, narrow = fof.labels(p, 0.06), fof.labels(p, 0.03)
    assert fof.is_superset(wide, narrow) and not fof.is_superset(narrow, wide)
    assert sum(r["count"] * r["groups"] for r in fof.group_sizes(wide).collect()) == 400


@pytest.mark.parametrize("n", [16, 256, 2000])
def test_components_of_a_random_graph(spark, n):
    rng = np.random.default_rng(n)
    a = np.arange(n)
    b = np.maximum(a - rng.integers(0, n // 2, n), 0)
    b[rng.random(n) < 0.3] = a[rng.random(n) < 0.3][0]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))).collect()}
    lab = list(range(n))

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i, j in zip(a, b, strict=True):
        x, y = find(int(i)), find(int(j))
        lab[max(x, y)] = min(x, y)
    assert all(got.get(i, i) == find(i) for i in range(n))


def test_components_graph_is_of_all_orders(spark, tmp_path):
    # Order keys 1 to 40, of which 35 and five others are multiples of 7.
    orders = [(100 * (k % 9) + k, k) for k in range(1, 41)] + [(500, 3), (503, 4)]
    spark.createDataFrame(orders, "o_custkey int, o_orderkey int").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["id"]: r["component"] for r in queries.components_graph(spark, str(tmp_path)).collect()}
    lab = {}

    def find(i):
        while lab.setdefault(i, i) != i:
            i = lab[i]
        return i

    edges = [(c, c + k % 5) for c, k in orders if k % 5]
    for i, j in edges:
        x, y = find(i), find(j)
        lab[max(x, y)] = min(x, y)
    assert got == {i: find(i) for e in edges for i in e} and got[507] == 500


def test_components_of_a_long_chain_and_nothing(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.where("a < 0")).count() == 0


def leaf_by_rule(bits, cap, ptype=None, least=0):
    n = len(bits[0])
    out = []
    for b in bits:
        for k in range(least, n + 1):
            same = [i for i, c in enumerate(bits) if c[:k] == b[:k]]
            most = len(same) if ptype is None else max(sum(ptype[i] == t for i in same) for t in set(ptype))
            if most <= cap or k == n:
                out.append(b[:k])
                break
    return out


def named_leaves(leaved, span, dim, leaf="leaf", depth="depth"):
    from starmesh.functions.zkey import key_bits

    return leaved.withColumn("zbits", key_bits(F.col("zkey"), dim, span)).toPandas().sort_values("zindex")


@pytest.mark.parametrize("range_rows", [10**6, 70, 23])
def test_leaves_planes_and_geometry(spark, monkeypatch, range_rows):
    monkeypatch.setattr(zorder, "RANGE_ROWS", range_rows)
    x = np.random.default_rng(6).normal(size=(300, 2))
    x[50:80] = x[50]
    p = points(spark, x, mass=np.ones(300))
    span = bit_range(p, ["x0", "x1"])
    got = named_leaves(tree.assign_leaves(p, 12, span), span, 2)
    assert [b[:n] for b, n in zip(got["zbits"], got["depth"], strict=True)] == leaf_by_rule(got["zbits"].tolist(), 12)
    assert (got["leaf"] == got.groupby([b[:n] for b, n in zip(got["zbits"], got["depth"], strict=True)])["zindex"].transform("min")).all()
    nodes = tree.build_nodes(p, 12, 3.0, 6).toPandas()
    assert (nodes.groupby("plane")["npart"].sum() == 300).all() and nodes["plane"].max() >= 1
    assert (nodes.groupby("plane")["mass"].sum() == 300).all()
    deep = nodes[nodes["node"].str.len() > 4]
    for i in (0, 1):
        assert (deep[f"lo{i}"] >= deep[f"cent{i}"] - deep[f"ext{i}"] / 2).all() and (deep[f"hi{i}"] <= deep[f"cent{i}"] + deep[f"ext{i}"] / 2).all()
    name = dict(zip(zip(nodes["plane"], nodes["first"], strict=True), nodes["node"], strict=True))
    for _, r in nodes[nodes["plane"] < nodes["plane"].max()].iterrows():
        assert r["node"].startswith(name[r["plane"] + 1, r["parent"]])
    assert (nodes[nodes["plane"] == 1].set_index("first")["npart"] == nodes[nodes["plane"] == 0].groupby("parent")["npart"].sum()).all()


def test_regularized_tree(spark):
    rows = [(5, 10), (6, 50), (7, 35), (9, 3), (12, 2)]
    hist = spark.createDataFrame(rows, "lvl int, weight long")
    # Up to level 7 there are 95 of 100; their mean volume is (10 / 4 + 50 / 2 + 35) / 95 of one at level 7.
    mean = (10 / 4 + 50 / 2 + 35) / 95
    assert tree.regularization_level(hist, 90.0, 1 / mean) == 7
    assert tree.regularization_level(hist, 90.0, 4 / mean) == 9
    assert tree.regularization_level(hist, 90.0, 20.0) == 12
    assert tree.regularization_level(hist, 90.0, 200.0) is None and tree.regularization_level(hist.where("false")) is None
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0.3, 0.002, (400, 2)), rng.uniform(0, 1, (12, 2))])
    p = points(spark, x)
    plain, regular = (tree.build_nodes(p, 16, 4.0, 8, regularize=r).toPandas() for r in (None, (90.0, 20.0)))
    leaves = plain[plain["plane"] == 0]
    limit = tree.regularization_level(spark.createDataFrame(leaves.groupby("lvl")["npart"].sum().reset_index(name="weight")))
    assert leaves["lvl"].max() >= limit and regular[regular["plane"] == 0]["lvl"].max() < limit
    assert (regular.groupby("plane")["npart"].sum() == len(x)).all()


def test_three_types_and_nan_rows(spark, monkeypatch):
    monkeypatch.setattr(zorder, "RANGE_ROWS", 60)
    rng = np.random.default_rng(7)
    a, b, c = (points(spark, rng.uniform(0, 1, (n, 2))) for n in (60, 90, 40))
    both = union_types(a, b, c)
    span = bit_range(both, ["x0", "x1"])
    got = named_leaves(tree.assign_leaves(both, 10, span), span, 2)
    want = leaf_by_rule(got["zbits"].tolist(), 10, got["ptype"].tolist())
    assert [z[:n] for z, n in zip(got["zbits"], got["depth"], strict=True)] == want
    nodes = tree.build_nodes(both, 10).where("plane = 0").toPandas()
    assert [int(nodes[f"npart_{t}"].sum()) for t in range(3)] == [60, 90, 40]
    assert same_rows(of_type(both, 1), b)
    raw = spark.createDataFrame([(1, 0.5, -0.0), (2, NAN, 1.0), (3, None, 1.0), (None, 1.0, 1.0)], "id long, a double, b double")
    assert [tuple(r) for r in point_set(raw, "id", ["a", "b"]).collect()] == [(1, 0.5, 0.0)]


def test_integer_positions_are_exact(spark):
    big = 2**53
    values = [-(2**63), -big - 1, -big, -1, 0, 1, big, big + 1, 2**63 - 1]
    raw = spark.createDataFrame([(i, v) for i, v in enumerate(reversed(values))], "id long, v long")
    got = zorder.with_zindex(point_set(raw, "id", ["v"], integer=True)).orderBy("zindex").collect()
    assert [r["x0"] for r in got] == values


def test_levels_of_adjacent_points_and_search_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(zorder, "RANGE_ROWS", 50)
    rng = np.random.default_rng(13)
    x, q = rng.uniform(0.1, 0.4, (150, 2)), rng.uniform(0.0, 0.5, (80, 2))
    q[:5] = x[:5]
    p = points(spark, x)
    span = bit_range(p, ["x0", "x1"])
    placed = tree.placed_points(p, span)
    rows = named_leaves(zorder.adjacent_levels(placed, span=span), span, 2)
    bits = rows["zbits"].tolist()
    shared = [next((i for i, (a, b) in enumerate(zip(u, v, strict=True)) if a != b), len(u)) for u, v in zip(bits, bits[1:], strict=False)]
    assert rows["lvl"].iloc[:-1].astype(int).tolist() == [len(bits[0]) - n for n in shared] and np.isnan(rows["lvl"].iloc[-1])
    leaved = tree.assign_leaves(p, 8, span).select("id", "x0", "x1", "leaf")
    got = {r["id"]: r["leaf"] for r in zorder.search_leaves(leaved, points(spark, q)).collect()}
    leaf = dict(zip(*(leaved.toPandas().sort_values("id")[c].tolist() for c in ("id", "leaf")), strict=True))
    one = BitRange(1, -60)
    ks, kq = keys(x, one), keys(q, one)
    order = sorted(range(len(x)), key=lambda i: (ks[i], i))
    far = lambda u, v: (int.from_bytes(u, "big") ^ int.from_bytes(v, "big")).bit_length()
    for i in range(len(q)):
        at = sum(k < kq[i] for k in ks)
        left, right = (order[at - 1] if at else None), (order[at] if at < len(x) else None)
        want = left if right is None or (left is not None and far(ks[left], kq[i]) <= far(ks[right], kq[i])) else right
        assert got[i] == leaf[want]
    assert zorder.search_leaves(leaved.where("false"), points(spark, q)).count() == 0


def test_search_sorted(spark):
    rng = np.random.default_rng(8)
    s, q = rng.uniform(0.1, 0.4, (130, 3)), rng.uniform(0.1, 0.4, (90, 3))
    q[:5] = s[:5]
    got = {r["id"]: r["position"] for r in zorder.search_sorted(points(spark, s), points(spark, q)).collect()}
    k = keys(np.concatenate([s, q]), BitRange(0, -60))
    ks = sorted(k[:130])
    assert all(got[i] == sum(z < k[130 + i] for z in ks) for i in range(90))


def test_candidate_pairs_of_leaves(spark, monkeypatch):
    x = np.random.default_rng(9).uniform(0, 1, (900, 2))
    near = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(((x[i] - x) ** 2).sum(1) <= 0.03**2)}
    for start in (1024, 4):
        monkeypatch.setattr(walk, "START", start)
        leaved, pairs = walk.candidate_pairs(points(spark, x), walk.Within(0.03), leaf_size=16)
        leaf = {r["id"]: r["leaf"] for r in leaved.collect()}
        kept = {tuple(r) for r in pairs.collect()}
        assert {(leaf[i], leaf[j]) for i, j in near} <= kept and len(kept) < 0.4 * 57**2


def test_dense_pairs_and_simplified_nodes(spark):
    assert {tuple(r) for r in walk.dense_pairs(spark, 70, 32).collect()} == {(q, t) for q in range(3) for t in range(3)}
    upper = walk.dense_pairs(spark, 70, 32, only_upper=True)
    assert {tuple(r) for r in upper.collect()} == {(q, t) for q in range(3) for t in range(q, 3)}
    with pytest.raises(ValueError, match="too many"):
        walk.dense_pairs(spark, 10**6, 32)
    nodes = spark.range(9).withColumnRenamed("id", "node")
    assert {r["node"] for r in walk.simplified(nodes, upper.where("q = 0 and t = 2"), nodes.where("node = 7")).collect()} == {0, 2, 7}


def test_walk_from_a_coarse_plane(spark, monkeypatch):
    monkeypatch.setattr(walk, "START", 3)
    monkeypatch.setattr(tiles, "TILE_POINTS", 300)
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.uniform(0, 1, (2500, 3)), np.full((700, 3), 0.5), rng.normal(0.2, 0.004, (900, 3))])
    assert got_knn(neighbors.knn_pairs(points(spark, x, 5), 3, boxsize=1.0, leaf_size=8)) == brute_knn(x, x, 3, 1.0)
    monkeypatch.setattr(fof, "LEAF", 8)
    with statistics() as counted:
        f = fof.labels(points(spark, x), 0.03, 1.0).toPandas().sort_values("id")
    want = components_of(x, 0.03, 1.0)
    assert (f["label"].to_numpy() == f.groupby(want)["zindex"].min().loc[want].to_numpy()).all()
    assert {"fof.pairs.plane0", "fof.pairs.plane1"} <= set(counted) and "fof.pairs.plane0: 1 times" in summary(counted)


def test_equal_points_do_not_meet(spark):
    n = 20_000
    x = np.full((n, 2), 0.25)
    with statistics() as counted:
        f = fof.labels(points(spark, x), 0.1)
        assert f.where("label != 0").count() == 0 and f.count() == n
        got = got_knn(neighbors.knn_pairs(points(spark, x), 3))
    assert len(got) == 3 * n and {(r, i, d) for _, r, i, d in got} == {(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)}
    assert counted["fof.pairs.plane0"] == [0]


@pytest.mark.parametrize("dim", [2, 3, 4])
def test_dense_clumps_in_chunks(spark, monkeypatch, dim):
    monkeypatch.setattr(tiles, "TILE_POINTS", 128)
    monkeypatch.setattr(tiles, "CHUNK_VALUES", 128 * dim)
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.normal(c, s, (400, dim)) for c, s in ((0.3, 0.01), (0.5, 0.05), (0.52, 0.001))] + [rng.uniform(0, 1, (300, dim))])
    f = fof.labels(points(spark, x), 0.05).toPandas().sort_values("id")
    want = components_of(x, 0.05)
    assert (f["label"].to_numpy() == f.groupby(want)["zindex"].min().loc[want].to_numpy()).all()
    assert got_knn(neighbors.knn_pairs(points(spark, x), 5)) == brute_knn(x, x, 5)
    assert fof.is_superset(fof.labels(points(spark, x), 0.1), fof.labels(points(spark, x), 0.05), mask=F.col("id") < 700)


def test_zero_linking_length_and_infinite_points(spark):
    x = np.array([[0.0, 1.0], [0.0, 1.0], [1.0, 0.0], [INF, 0.0], [0.0, 1.0], [-INF, 2.0]])
    f = fof.labels(points(spark, x), 0.0).toPandas().sort_values("id")
    assert f["label"].nunique() == 4 and len(set(f["label"].to_numpy()[[0, 1, 4]])) == 1


def test_knn_in_many_dimensions_with_ties(spark):
    rng = np.random.default_rng(31)
    x = rng.integers(0, 2, (300, 20)).astype(float)
    x[:20] += 1e6
    assert got_knn(neighbors.knn_pairs(points(spark, x), 6, leaf_size=16)) == brute_knn(x, x, 6)


def test_knn_results(spark):
    x, q = np.random.default_rng(32).uniform(0, 1, (80, 2)), np.random.default_rng(33).uniform(0, 1, (30, 2))
    out = neighbors.knn(points(spark, x, mass=np.arange(80.0)), 2, query=points(spark, q), boxsize=1.0, result=("id", "rad", "drad", "part", "rank_index", "mass"), order="input").toPandas()
    assert out["qid"].is_monotonic_increasing and len(out) == 60
    d = np.array(out["drad"].tolist())
    assert np.allclose((d**2).sum(1), out["rad"] ** 2) and np.allclose(d, (q[out["qid"]] - x[out["id"]] + 0.5) % 1 - 0.5)
    assert [p["mass"] for p in out["part"]] == out["mass"].tolist() == out["id"].tolist()
    place = zorder.with_zindex(points(spark, x)).toPandas().set_index("id")["zindex"]
    assert (out["rank_index"].to_numpy() == place.loc[out["id"]].to_numpy()).all()
    by_z = neighbors.knn(points(spark, x), 1, result=("id",), order="z").toPandas()
    assert by_z["qindex"].tolist() == list(range(80)) and (by_z["id"] == by_z["qid"]).all()


def test_windows(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (1, 3, 9.0)], "k int, o int, v double")
    got = {(r["k"], r["o"]): r["prefix"] for r in windows.bucket_prefix_sum(df, "k", ["o"]).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): 0}
    assert {(r["k"], r["o"]): r["least"] for r in windows.smallest_from_here(df, "k", "o", "v").collect()}[(1, 1)] == 3.0
    assert [r["rank"] for r in windows.segment_rank(df, "k", "v", "o").where("k = 1").orderBy("o").collect()] == [2, 1, 3]
    assert [r["offset"] for r in windows.offsets(df.groupBy("k").count(), "k", "count").orderBy("k").collect()] == [0, 3]


def test_windows_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(windows, "STRETCH", 16)
    monkeypatch.setattr(zorder, "RANGE_ROWS", 40)
    rng = np.random.default_rng(40)
    df = pd.DataFrame({"k": [None if i % 50 == 0 else int(i % 10 > 6) for i in range(300)], "o": rng.permutation(300), "v": rng.uniform(0, 1, 300)})
    s = spark.createDataFrame([(None if r.k != r.k else int(r.k), int(r.o), float(r.v)) for r in df.itertuples()], "k int, o int, v double")
    got = windows.bucket_prefix_sum(s, "k", ["o"]).toPandas()
    least = windows.smallest_from_here(s, "k", "o", "v").toPandas()
    for frame in (got, least):
        assert len(frame) == 300 and list(frame.columns[:3]) == ["k", "o", "v"]
    for key, own in got.groupby("k", dropna=False):
        assert own.sort_values("o")["prefix"].tolist() == list(range(len(own)))
    for key, own in least.groupby("k", dropna=False):
        own = own.sort_values("o")
        assert np.allclose(own["least"], own["v"][::-1].cummin()[::-1])
    total = windows.running_sum(s, [], ["o"], F.col("v"), "sum").toPandas().sort_values("o")
    assert np.allclose(total["sum"], total["v"].cumsum() - total["v"])


def test_boxes_inside_a_tile():
    rng = np.random.default_rng(3)
    for n, dim, size in ((1, 3, 32), (31, 1, 32), (1000, 3, 32), (5000, 2, 48), (4000, 6, 32)):
        box = packed(rng.random((n, dim)), size)
        count = np.unique(box, return_counts=True)[1]
        assert len(box) == n and count.max() <= size
    # Equal points, and points nowhere, are dealt like all others.
    odd = np.vstack([np.zeros((100, 2)), np.full((5, 2), np.nan), np.full((5, 2), np.inf)])
    assert np.unique(packed(odd, 16), return_counts=True)[1].max() <= 16


@pytest.mark.parametrize("boxsize", [None, 1.0])
@pytest.mark.parametrize("dim", [1, 3, 5])
def test_a_tile_finds_what_all_pairs_give(boxsize, dim):
    """Many boxes of a tile, half of the points in one dense spot, with ties, copies and points nowhere."""
    rng = np.random.default_rng(dim)
    x = np.vstack([rng.random((1500, dim)), 0.5 + 0.001 * rng.random((1500, dim)), np.round(rng.random((300, dim)), 1)])
    x = np.vstack([x, x[:50]])
    if not boxsize:
        x[7], x[11, 0] = np.inf, np.nan
    frame = pd.DataFrame({"leaf": np.arange(len(x)) // 64, "id": rng.permutation(len(x)), **{f"x{i}": x[:, i] for i in range(dim)}, "bound": np.inf})
    k, xs = 6, [f"x{i}" for i in range(dim)]
    got = neighbors._tile(k, xs, boxsize, [], Tally())(frame, frame.drop(columns="bound")).sort_values(["qid", "rank"])
    frame = frame.sort_values("id")
    with np.errstate(invalid="ignore"):
        r2 = differences(frame[xs].to_numpy(), frame[xs].to_numpy(), boxsize)
    finite = np.isfinite(frame[xs].to_numpy()).all(1)
    for q in np.flatnonzero(finite):
        best = np.lexsort((np.arange(len(x)), r2[q]))[:k]
        rows = got["id"].to_numpy()[got["qid"].searchsorted(q) :][:k]
        assert (rows == best).all()
