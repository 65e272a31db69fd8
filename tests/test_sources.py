import numpy as np
import pytest

from starmesh.operators import neighbors
from starmesh.sources import arrays, generate, io
from starmesh.streaming.stream_knn import stream_knn


def test_generators_repeat_and_have_their_shape(spark):
    a, b = generate.uniform_points(spark, 500, 3, seed=4), generate.uniform_points(spark, 500, 3, seed=4)
    assert a.exceptAll(b).isEmpty() and a.count() == 500
    assert abs(a.selectExpr("sum(mass)").first()[0] - 1) < 1e-9
    assert generate.gaussian_points(spark, 2000, 2).selectExpr("abs(avg(x0)) < 0.2").first()[0]
    c = generate.clustered_points(spark, 300, clumps=5, boxsize=10.0)
    assert c.where("x0 < 0 or x0 >= 10").isEmpty()
    r = generate.hernquist_points(spark, 4000).selectExpr("avg(cast(sqrt(x0*x0+x1*x1+x2*x2) <= 1 as int))").first()[0]
    assert abs(r - 0.25) < 0.03  # a quarter of the mass lies within the scale radius


def test_round_trip_of_sets(spark, tmp_path):
    p = generate.uniform_points(spark, 50, 2)
    io.write_sets(str(tmp_path), points=p, nothing=None, attributes={"boxsize": 1.0, "name": "a", "none": None})
    assert io.read_set(spark, str(tmp_path), "points", ["id", "x0"]).exceptAll(p).isEmpty()
    assert io.read_scalars(spark, str(tmp_path)) == {"boxsize": 1.0, "name": "a"}
    assert "v0" in io.read_set(spark, str(tmp_path), "points", optional={"v0": 0.0}).columns
    with pytest.raises(KeyError, match="ptype"):
        io.read_set(spark, str(tmp_path), "points", ["ptype"])


def test_stream_of_queries(spark, tmp_path):
    source, queries = generate.uniform_points(spark, 200, 2, seed=1), generate.uniform_points(spark, 40, 2, seed=9)
    queries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    stream_knn(stream, source, 3, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.exceptAll(neighbors.knn_pairs(source, 3, query=queries)).isEmpty() and got.count() == 120


def test_nested_sets(spark, tmp_path):
    from starmesh.sources.io import ATTRIBUTES, read_scalars, read_set, write_sets

    path = f"file://{tmp_path}/store"
    rows = spark.range(4).selectExpr("id", "id * 0.5D as x0")
    write_sets(path, run={"box": 2.0, "none": None, "points": rows, "tree": {"level": 3, "nodes": rows.limit(2)}})
    assert read_set(spark, f"{path}/run", "points", ["id", "x0"]).count() == 4
    assert read_scalars(spark, f"{path}/run") == {"box": 2.0} and read_scalars(spark, f"{path}/run/tree", ATTRIBUTES) == {"level": 3}
    assert read_set(spark, f"{path}/run/tree", "nodes").count() == 2


@pytest.mark.parametrize("stretch", [64 << 20, 100])
def test_array_files_by_stretches(spark, tmp_path, monkeypatch, stretch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows = spark.range(0, 500, 1, 6).selectExpr("id", "id * 0.5D as x0", "cast(id as float) as x1", "cast(id % 7 as int) as kind")
    path = f"file://{tmp_path}/arrays"
    with monkeypatch.context() as m:
        # Rows never come to the driver, but for the one with their number.
        for name in ("toPandas", "toArrow", "toLocalIterator"):
            m.setattr(DataFrame, name, None)
        assert arrays.write_arrays(rows, path) == 500
        again = arrays.read_arrays(spark, path, stretch)
        assert again.schema.simpleString() == rows.schema.simpleString()
        assert again.exceptAll(rows).isEmpty() and again.count() == 500
    assert again.rdd.getNumPartitions() == (6 if stretch > 100 else 6 * 21)
    x = np.random.default_rng(3).normal(size=(90, 2)).astype(">f4")
    np.save(tmp_path / "plain.npy", x)
    got = generate.points_of_file(spark, str(tmp_path / "plain.npy"), total_mass=9.0).orderBy("id").toPandas()
    assert (got[["x0", "x1"]].to_numpy() == x).all() and got["id"].tolist() == list(range(90)) and (got["mass"] == 0.1).all()
    np.save(tmp_path / "line.npy", np.arange(5))
    assert [r["x0"] for r in arrays.read_arrays(spark, str(tmp_path / "line.npy")).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.ones((3, 2))))
    for bad in (lambda: arrays.read_arrays(spark, str(tmp_path / "turned.npy")), lambda: arrays.write_arrays(spark.sql("select 'a' as a"), path + "2"), lambda: arrays.write_arrays(spark.sql("select cast(null as int) as a"), path + "3")):
        with pytest.raises(Exception, match="rows of numbers|arrays of numbers|nulls"):
            bad()


@pytest.mark.parametrize("beta", [0.0, 0.5, -1.0])
def test_velocities_of_a_sphere(spark, beta):
    p = generate.hernquist_points(spark, 60_000, scale=2.0, total_mass=3.0, seed=5, anisotropy=beta)
    assert p.limit(1000).exceptAll(generate.hernquist_points(spark, 60_000, scale=2.0, total_mass=3.0, seed=5, anisotropy=beta)).isEmpty()
    rows = p.toPandas()
    x, v = rows[["x0", "x1", "x2"]].to_numpy(), rows[["v0", "v1", "v2"]].to_numpy()
    r = np.sqrt((x * x).sum(1))
    radial = (x * v).sum(1) / r
    across = ((v * v).sum(1) - radial**2) / 2
    assert ((v * v).sum(1) <= 2 * 3.0 / (r + 2.0) * (1 + 1e-9)).all()
    s = r / 2.0
    unit = 3.0 / 2.0
    if beta == 0.0:
        want = unit / 12 * (12 * s * (1 + s) ** 3 * np.log1p(1 / s) - s / (1 + s) * (25 + 52 * s + 42 * s**2 + 12 * s**3))
    elif beta == 0.5:
        want = unit / (4 * (1 + s))
    else:
        # The equation of hydrostatic balance, summed up outwards.
        grid = np.geomspace(1e-4, 1e5, 200_000)
        f = grid ** (2 * beta - 1) / (1 + grid) ** 5
        tail = np.concatenate([np.cumsum(((f[1:] + f[:-1]) / 2 * np.diff(grid))[::-1])[::-1], [0.0]])
        want = unit * np.interp(s, grid, tail * grid ** (1 - 2 * beta) * (1 + grid) ** 3)
    some = (s > 0.02) & (s < 20)
    for lo, hi in ((0.02, 0.5), (0.5, 2), (2, 20)):
        own = some & (s >= lo) & (s < hi)
        assert abs((radial**2 / want)[own].mean() - 1) < 0.04
        assert abs(across[own].mean() / (radial**2)[own].mean() - (1 - beta)) < 0.04 * (1 - beta) + 0.01
    assert abs((radial**2 / want)[some].mean() - 1) < 0.02


def test_anisotropy_is_bounded(spark):
    with pytest.raises(ValueError, match="anisotropy"):
        generate.hernquist_points(spark, 10, anisotropy=0.6)


def test_rows_that_break_a_condition_are_told(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from starmesh.operators.points import ensured

    assert ensured(spark.range(5), F.col("id") < 5, "outside the box").count() == 5
    with pytest.raises(PySparkException, match="outside the box"):
        ensured(spark.range(6), F.col("id") < 5, "outside the box").collect()


def test_box_distances_bound_those_of_points(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from starmesh.functions.geometry import greatest_squared_distance, least_squared_distance, squared_distance

    rng = np.random.default_rng(3)
    cols = ("ca", "cb", "ha", "hb")
    rows = [tuple(map(float, [*rng.uniform(0, 1, 4), *rng.uniform(0, 0.2, 4), *rng.uniform(-1, 1, 4)])) for _ in range(200)]
    names = [f"{c}{i}" for c in cols[:2] for i in (0, 1)] + [f"{c}{i}" for c in cols[2:] for i in (0, 1)] + ["u0", "u1", "w0", "w1"]
    df = spark.createDataFrame(rows, names)
    two = lambda c: [F.col(f"{c}0"), F.col(f"{c}1")]
    at = lambda c, h, u: [F.col(f"{c}{i}") + F.col(f"{h}{i}") * F.col(f"{u}{i}") for i in (0, 1)]
    for box in (None, 1.0):
        low, high = (f(two("ca"), two("ha"), two("cb"), two("hb"), box) for f in (least_squared_distance, greatest_squared_distance))
        d = squared_distance(at("ca", "ha", "u"), at("cb", "hb", "w"), box)
        assert df.where(~((low <= d + 1e-12) & (d <= high + 1e-12))).count() == 0
