import numpy as np
import pytest
from pyspark.sql import functions as F
from test_points import INF, brute_knn, components_of, got_knn, points

from starmesh.functions.zkey import BitRange
from starmesh.operators import components, fof, index, neighbors, runner, tiles, tree, walk, zorder
from starmesh.operators.components import connected_components
from starmesh.plans import skew
from starmesh.plans.observed import statistics, summary


@pytest.fixture
def no_sort(monkeypatch):
    """Nothing may be put in z-order any more."""

    def fail(*a, **k):
        raise AssertionError("points were sorted")

    def start():
        for module in (zorder, tiles, index, fof, tree):
            monkeypatch.setattr(module, "with_position", fail)

    return start


def cloud(seed, dim=3, n=1500):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(0, 1, (n, dim)), np.full((40, dim), 0.5), rng.normal(0.2, 0.004, (300, dim))]) % 1.0


def test_second_calls_on_an_index_sort_nothing(spark, monkeypatch, no_sort):
    monkeypatch.setattr(walk, "START", 8)
    x = cloud(1)
    path = index.build_index(points(spark, x, 5, mass=np.ones(len(x))), leaf_size=16).path
    own = fof.labels(points(spark, x), 0.03, 1.0).toPandas().sort_values("id")
    no_sort()
    found = index.open_index(spark, path)
    assert found.n == len(x) and found.leaves.count() == found.n_leaves
    assert got_knn(neighbors.knn_pairs(found, 5, boxsize=1.0)) == brute_knn(x, x, 5, 1.0)
    got = fof.labels(found, 0.03, 1.0).toPandas().sort_values("id")
    for c in ("zindex", "label", "mass"):
        assert (got[c].to_numpy() == (own[c] if c in own else np.ones(len(x)))).all()
    again = neighbors.knn(found, 2, result=("id", "mass", "rank_index"))
    assert {r["mass"] for r in again.collect()} == {1.0}
    with pytest.raises(Exception, match="manifest"):
        index.open_index(spark, path + "/nothing")


@pytest.mark.parametrize("start", [8, walk.START])
def test_queries_on_an_index(spark, monkeypatch, start):
    monkeypatch.setattr(walk, "START", start)
    x, q = cloud(2), np.concatenate([cloud(3, n=300), np.full((500, 3), 0.5), [[9.0, 9.0, 9.0]]])
    found = index.build_index(points(spark, x), leaf_size=16)
    want = brute_knn(x, q, 4)
    assert got_knn(neighbors.knn_pairs(found, 4, query=points(spark, q, 3))) == want
    assert got_knn(neighbors.knn_pairs(found, 4, query=index.build_index(points(spark, q), leaf_size=32))) == want
    assert got_knn(neighbors.knn_pairs(points(spark, x), 4, query=index.build_index(points(spark, q)))) == want


def test_index_of_nothing_few_and_infinite_points(spark):
    x = np.array([[0.0, 1.0], [INF, 0.0], [0.0, 1.0]])
    none = index.build_index(points(spark, x).where("id < 0"))
    assert neighbors.knn_pairs(none, 3).count() == 0 and fof.labels(none, 1.0).count() == 0
    assert neighbors.knn_pairs(none, 3, query=points(spark, x)).count() == 0
    some = index.build_index(points(spark, x))
    assert neighbors.knn_pairs(some, 3, query=points(spark, x).where("id < 0")).count() == 0
    got = neighbors.knn_pairs(some, 5).where("qid != 1 and id != 1").toPandas()
    assert sorted(zip(got["qid"], got["id"], strict=True)) == [(0, 0), (0, 2), (2, 0), (2, 2)]


@pytest.mark.parametrize(("few", "shift"), [(10_000, 0.0), (5, 0.0), (10_000, 3.0)])
def test_merged_is_a_fresh_build(spark, monkeypatch, few, shift):
    monkeypatch.setattr(zorder, "RANGE_ROWS", 100)
    monkeypatch.setattr(index, "MERGE_POINTS", few)
    x = cloud(4, 2, 600) * 0.9 + 0.001
    x[-60:] += shift
    p = points(spark, x)
    # Keys must not tell more than the points that are there.
    first = index.build_index(p.where(F.col("id") < len(x) - 60), leaf_size=16, span=BitRange(-1, -70))
    with statistics() as seen:
        both = index.merged(first, p.where(F.col("id") >= len(x) - 60))
    assert len(seen.get("index.sorted", [])) == int(few == 5 or shift > 0)
    fresh = index.build_index(p, leaf_size=16)
    same = lambda i: sorted(map(tuple, i.points.select("id", "zindex", "leaf", "x0").collect()))
    assert same(both) == same(fresh) and both.n == len(x)
    assert sorted(map(tuple, both.leaves.collect())) == sorted(map(tuple, fresh.leaves.collect()))
    assert got_knn(neighbors.knn_pairs(both, 3)) == brute_knn(x, x, 3)


def distances(a, b, box):
    d = a[:, None] - b[None]
    d = np.where(d < -box / 2, d + box, np.where(d >= box / 2, d - box, d)) if box else d
    return sum(d[:, :, i] * d[:, :, i] for i in range(d.shape[2]))


@pytest.mark.parametrize(("dim", "box", "start"), [(1, None, 4), (2, 1.0, 3), (3, None, 1024), (3, 1.0, 4)])
def test_pair_counts_and_density(spark, monkeypatch, dim, box, start):
    monkeypatch.setattr(walk, "START", start)
    monkeypatch.setattr(tiles, "TILE_POINTS", 200)
    monkeypatch.setattr(tiles, "CHUNK_VALUES", 200 * dim)
    x, q = cloud(5, dim, 900), cloud(6, dim, 200)
    radii = [0.0, 0.01, 0.05, 0.3, 0.45]
    edges = np.array(radii) ** 2
    with statistics() as seen:
        got = runner.pair_counts(index.build_index(points(spark, x)), radii, boxsize=box).orderBy("bin").collect()
    at = np.searchsorted(edges, distances(x, x, box)[np.triu_indices(len(x), 1)])
    assert [r["pairs"] for r in got] == np.bincount(at, minlength=6)[:5].tolist() and [r["radius"] for r in got] == radii
    if start < 9:
        assert "pair-counts.pairs.plane1" in seen
    got = runner.pair_counts(points(spark, x), radii, query=points(spark, q), boxsize=box, leaf_size=16).orderBy("bin").collect()
    assert [r["pairs"] for r in got] == np.bincount(np.searchsorted(edges, distances(q, x, box)).ravel(), minlength=6)[:5].tolist()
    got = runner.density(points(spark, x), 0.3, boxsize=box, leaf_size=16).orderBy("id").collect()
    assert [r["count"] for r in got] == (distances(x, x, box) <= 0.09).sum(1).tolist()
    got = runner.density(points(spark, x), 0.05, query=points(spark, q), boxsize=box, leaf_size=16).orderBy("id").collect()
    assert [r["count"] for r in got] == (distances(q, x, box) <= 0.0025).sum(1).tolist()


def test_counts_of_nothing_and_a_rule_of_ones_own(spark):
    p = points(spark, cloud(7, 2, 100))
    assert [r["pairs"] for r in runner.pair_counts(p.where("id < 0"), [1.0, 2.0]).orderBy("bin").collect()] == [0, 0]
    assert runner.density(p.where("id < 0"), 1.0).count() == 0
    assert {r["count"] for r in runner.density(p.where("id < 0"), 1.0, query=p).collect()} == {0}
    for bad in ([], [2.0, 1.0], [-1.0]):
        with pytest.raises(ValueError):
            runner.pair_counts(p, bad)

    class Left(runner.PairRule):
        """Sources whose first coordinate is smaller."""

        def kinds(self, receivers, sources):
            less, more = sources.hi[None, :, 0] < receivers.lo[:, None, 0], sources.lo[None, :, 0] >= receivers.hi[:, None, 0]
            return np.where(more, self.NONE, np.where(less, self.ACCEPT, self.REFINE)).astype(np.int8)

    kernel = lambda qid, qx, sid, sx: {"n": np.array([(sx[None, :, 0] < qx[:, None, 0]).sum()])}
    partials, accepted, _ = runner.run_pairs(p, Left(), kernel, "n long", leaf_size=8)
    n = (partials.agg(F.sum("n")).first()[0] or 0) + (accepted.agg(F.sum(F.col("n_q") * F.col("n_t"))).first()[0] or 0)
    x0 = cloud(7, 2, 100)[:, 0]
    assert n == (x0[None] < x0[:, None]).sum() and not accepted.isEmpty()


def test_ends_of_many_ranges_come_to_the_driver_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(zorder, "RANGE_ROWS", 10)
    monkeypatch.setattr(tree, "BLOCKS", 4)
    x = np.random.default_rng(8).normal(size=(900, 2))
    x[100:200] = x[100]
    p = points(spark, x, mass=np.arange(900.0))
    with statistics() as seen:
        many = tree.build_nodes(p, 12, 3.0, 6).toPandas()
    assert max(seen["tree.driver_rows"]) <= 4 and len(many)
    monkeypatch.setattr(zorder, "RANGE_ROWS", 10**6)
    one = tree.build_nodes(p, 12, 3.0, 6).toPandas()
    key = ["plane", "first"]
    many, one = (d.sort_values(key).reset_index(drop=True) for d in (many, one))
    assert list(many.columns) == list(one.columns) and (many["node"] == one["node"]).all()
    numbers = one.select_dtypes("number").columns
    assert np.allclose(many[numbers], one[numbers], equal_nan=True)


def test_number_of_planes_goes_by_points():
    # Leaves are taken to be half full, and one more.
    assert tree.planes(0, 32, 6.0, 1024) == [32] and tree.planes(16 * 1023, 32, 6.0, 1024) == [32]
    assert len(tree.planes(16 * 1024 * 6, 32, 6.0, 1024)) == 2 and len(tree.planes(16 * 6100, 32, 6.0, 1024)) == 1
    assert tree.planes(10**7, 32, 6.0, 1024) == [32, 192, 1152, 6912]
    assert tree.planes(5, 1, 6.0, 1024) == [1]


def test_planes_are_made_of_the_plane_below(spark, monkeypatch):
    grouped = []
    real = tree._summary
    monkeypatch.setattr(tree, "_summary", lambda *a: grouped.append(1) or real(*a))
    x = np.random.default_rng(9).uniform(0, 1, (700, 3))
    mass = np.random.default_rng(9).uniform(0, 1, 700)
    nodes = tree.build_nodes(points(spark, x, mass=mass), 8, 3.0, 4).toPandas()
    assert len(grouped) == 1 and nodes["plane"].max() >= 2
    for _, of in nodes.groupby("plane"):
        assert of["npart"].sum() == 700 and np.isclose(of["mass"].sum(), mass.sum())
        assert np.allclose([(of["mass"] * of[f"mass_cent{i}"]).sum() for i in range(3)], (mass[:, None] * x).sum(0))
        assert np.allclose([of["lo0"].min(), of["hi2"].max()], [x[:, 0].min(), x[:, 2].max()])


def spread_of(df):
    """Rows of the partitions of a plan, and how they were dealt."""
    sizes = sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    return sizes[-1], sizes[len(sizes) // 2]


def test_a_hub_is_no_join_key(spark, monkeypatch):
    """A star of a million edges: the edges stay where they are, whatever AQE would do."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        star = spark.range(0, 1_000_000, 1, 200).selectExpr("id div 1000000 + 5 as u", "id + 10 as v")
        least = star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        joined = skew.by_degree(star, least, "u", "degree", 1_000_000)
        most, median = spread_of(joined)
        assert most <= 3 * median and joined.count() == 1_000_000
        plain = star.join(least.hint("merge"), "u")
        assert spread_of(plain)[0] == 1_000_000
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        few = spark.range(0, 40_000, 1, 20).selectExpr("if(id % 7 = 0, 3L, 5L) as a", "id + 10 as b")
        seen = []
        real = components.by_degree
        monkeypatch.setattr(components, "by_degree", lambda *a: seen.append(1) or real(*a))
        monkeypatch.setattr(skew, "LEAST", 100)
        got = connected_components(few.union(spark.createDataFrame([(3, 11)], "a long, b long")))
        assert got.where("component != 3").count() == 0 and got.count() == 40_002 and seen
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_catalogue_of_a_giant_group(spark, monkeypatch):
    """Half of all points are one group: its points are no join key, and the result is that of one pass."""
    monkeypatch.setattr(skew, "LEAST", 50)
    monkeypatch.setattr(skew, "HEAVY", 10)
    rng = np.random.default_rng(10)
    x = np.concatenate([(rng.normal(0, 0.05, (600, 3))) % 1.0, rng.uniform(0.3, 0.7, (600, 3))])
    mass = rng.uniform(1, 2, len(x))
    pts, cat = fof.labels_and_catalogue(points(spark, x, mass=mass), 0.05, 1.0, npart_min=2)
    want = components_of(x, 0.05, 1.0)
    sizes = np.unique(want, return_counts=True)[1]
    got = fof.sort_catalogue(cat).toPandas()
    assert got["count"].max() > 0.4 * len(x) and got["count"].tolist() == sorted((sizes[sizes >= 2]).tolist(), reverse=True)
    a = pts.toPandas().sort_values("row")
    for _, g in got.iterrows():
        own = a.iloc[int(g["offset"]) : int(g["offset"] + g["count"])]
        y, m = own[["x0", "x1", "x2"]].to_numpy(), own["mass"].to_numpy()
        com = (y[0] + (m[:, None] * ((y - y[0] + 0.5) % 1 - 0.5)).sum(0) / m.sum()) % 1
        off = (y - com + 0.5) % 1 - 0.5
        assert (own["label"] == g["label"]).all() and np.allclose(g[["com_pos0", "com_pos1", "com_pos2"]].to_numpy(float), com)
        assert np.isclose(g["com_inertia_radius"], np.sqrt((m * (off**2).sum(1)).sum() / m.sum()))
    named = fof.labels(points(spark, x), 0.05, 1.0, label="input").toPandas().sort_values("id")
    assert (named.groupby(want)["label"].nunique() == 1).all() and named["label"].nunique() == len(sizes)


def test_many_dimensions_compare_less_than_all_pairs(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 24))
    x = np.concatenate([c + rng.normal(0, 0.02, (80, 24)) for c in centres] + [np.tile(centres[0], (30, 1)), rng.normal(size=(20, 24))])
    with statistics() as seen:
        assert got_knn(neighbors.knn_pairs(points(spark, x, 5), 5, leaf_size=16)) == brute_knn(x, x, 5)
    assert sum(seen["knn.compared"]) < 0.2 * len(x) ** 2
    q = np.concatenate([x[::50] + 0.01, rng.normal(size=(10, 24)) * 5, x[:3]])
    assert got_knn(neighbors.knn_pairs(points(spark, x), 3, query=points(spark, q))) == brute_knn(x, q, 3)
    assert got_knn(neighbors.knn_pairs(points(spark, x[:1].repeat(50, 0)), 2)) == brute_knn(x[:1].repeat(50, 0), x[:1].repeat(50, 0), 2)
    odd = x[:60].copy()
    odd[3, 2], odd[4, 0] = INF, -INF
    got = neighbors.knn_pairs(points(spark, odd), 4).where("qid not in (3, 4)").toPandas()
    finite = np.delete(odd, [3, 4], 0)
    names = np.delete(np.arange(60), [3, 4])
    assert sorted(zip(got["qid"], got["rank"], got["id"], strict=True)) == [(names[a], b, names[c]) for a, b, c, _ in brute_knn(finite, finite, 4)]


def test_tasks_tell_what_they_compare(spark, monkeypatch):
    x = np.concatenate([cloud(12, 2, 400), np.random.default_rng(1).normal(0.7, 1e-4, (1500, 2))])
    assert not neighbors.knn_pairs(points(spark, x), 3).isEmpty()
    monkeypatch.setattr(tiles, "TILE_POINTS", 64)
    with statistics() as seen:
        n = neighbors.knn_pairs(points(spark, x), 3, leaf_size=64).count()
        counts = runner.density(points(spark, x), 1e-3, leaf_size=32).agg(F.sum("count")).first()[0]
    assert n == 3 * len(x) and seen["knn.tiles_run"] == seen["knn.tiles"] and seen["knn.most_queries"] == [64]
    assert seen["knn.compared"][0] >= n and seen["density.compared"][0] >= 1 and counts > len(x)
    assert seen["knn.median_compared"][0] <= seen["knn.most_compared"][0]
    kept = {"a.tiles_run": [10], "a.median_compared": [64], "a.most_compared": [1024], "a.most_sources": [9000], "a.most_queries": [100], "a.compared": [10**7]}
    told = summary(kept)
    assert "compares 16 times the pairs of the median" in told and "larger tiles" in told and "smaller leaves" in told
    assert len(summary({"a": [1, 2]}).splitlines()) == 1


@pytest.mark.parametrize(("few", "rows"), [(10_000, 50), (10_000, 10**6), (5, 50)])
def test_search_in_an_index(spark, monkeypatch, no_sort, few, rows):
    monkeypatch.setattr(zorder, "RANGE_ROWS", rows)
    monkeypatch.setattr(index, "SEARCH_QUERIES", few)
    rng = np.random.default_rng(13)
    x, q = rng.integers(-40, 40, (700, 2)) / 4, np.concatenate([rng.integers(-44, 44, (300, 2)) / 4, np.zeros((5, 2))])
    found = index.build_index(points(spark, x), leaf_size=16, span=BitRange(4, -60))
    asked = points(spark, q, 3)
    want = zorder.search_sorted(points(spark, x), asked).join(zorder.search_leaves(found.points, asked), "id").toPandas().sort_values("id")
    if few > 5:
        no_sort()
    got = index.search(found, asked).toPandas().sort_values("id")
    assert (got[["id", "position", "leaf"]].to_numpy() == want[["id", "position", "leaf"]].to_numpy()).all() and len(got) == len(q)


def test_search_without_points_and_trees_of_an_index(spark, no_sort):
    x = np.random.default_rng(14).normal(size=(300, 2))
    p = points(spark, x, mass=np.ones(300))
    none, found = index.build_index(p.where("id < 0")), index.build_index(p)
    assert {tuple(r) for r in index.search(none, p.limit(3)).select("position", "leaf").collect()} == {(0, None)}
    assert index.search(found, p.where("id < 0")).count() == 0
    want = tree.build_nodes(p, 12, 3.0, 6).toPandas().sort_values(["plane", "first"])
    no_sort()
    got = tree.build_nodes(found, 12, 3.0, 6).toPandas().sort_values(["plane", "first"])
    assert (got["node"].to_numpy() == want["node"].to_numpy()).all() and (got["npart"].to_numpy() == want["npart"].to_numpy()).all()
