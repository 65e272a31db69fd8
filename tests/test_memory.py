"""What the steps of knn hold at once, against the size of what they are given."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from test_points import brute_knn, got_knn, points

from starmesh.operators import neighbors, tiles
from starmesh.operators.tiles import differences
from starmesh.plans.observed import Tally, statistics


def most_held(run):
    """(what run gives, MB that it held at most)"""
    run()  # what is imported and compiled once does not count
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_tile_of_many_dimensions_is_copied_once():
    rng = np.random.default_rng(1)
    n, dim, p = 12_000, 64, 24
    x = rng.normal(size=(n, dim))
    pivots = x[:p]
    far = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in pivots], 1)
    leaf = np.arange(n) // 48
    side = pd.DataFrame({"leaf": leaf, "id": rng.permutation(n), **{f"pivot{i}": far[:, i] for i in range(p)}, **{f"x{i}": x[:, i] for i in range(dim)}})
    asked = side.iloc[:480].assign(bound=np.inf)
    xs, names = [f"x{i}" for i in range(dim)], [f"pivot{i}" for i in range(p)]
    got, mb = most_held(lambda: neighbors._tile(5, xs, None, names, Tally())(asked, side))
    assert len(got) == 5 * len(asked)
    # The coordinates in order, those next to a box of queries twice, and their distances twice.
    assert mb < 3.2 * x.nbytes / 1e6 + 2 * 48 * n * 8 / 1e6
    by = np.argsort(side["id"].to_numpy())
    r2 = differences(asked[xs].to_numpy()[:20], x[by], None)
    best = np.argsort(r2, axis=1, kind="stable")[:, :5]
    for q, want in zip(asked["id"].to_numpy()[:20], best, strict=True):
        assert got[got["qid"] == q].sort_values("rank")["id"].tolist() == want.tolist()


def test_ties_in_many_dimensions_are_not_gathered():
    """All sources are as far from each query; of them the least ids stay."""
    s = np.random.default_rng(2).choice([-1.0, 1.0], (6000, 64))
    (i, j, d), mb = most_held(lambda: neighbors.nearest(np.zeros((48, 64)), np.arange(len(s)), s, 5, None))
    assert (j.reshape(48, 5) == np.arange(5)).all() and (d == 64).all()
    assert mb < 60  # coordinates of both sides of all pairs: 295


@pytest.mark.parametrize("dim", [2, 12])
def test_points_are_prepared_in_bounded_pieces(spark, monkeypatch, dim):
    """Ranges that one task reads in their order are cut, whatever the size of files; also equal points."""
    n = 3000
    batches = [pa.RecordBatch.from_pydict({"zindex": np.arange(i, i + 500)}) for i in (*range(0, n, 500), 9000)]
    sizes = [len(p) for p in tiles.segments(iter(batches), 700)]
    assert sizes == [700, 700, 700, 700, 200, 500] and [len(p) for p in tiles.segments(iter(batches))] == [n, 500]
    assert [len(p) for p in tiles.segments(iter(batches), 100)] == [100] * 35
    assert [p["zindex"][0].as_py() for p in tiles.segments(iter(batches), 700)] == [0, 700, 1400, 2100, 2800, 9000]
    rng = np.random.default_rng(dim)
    x = np.vstack([rng.normal(size=(400, dim)), np.tile(rng.normal(size=(1, dim)), (150, 1))])
    monkeypatch.setattr(neighbors, "CHUNK_VALUES", 60 * (dim + 5))
    with statistics() as seen:
        assert got_knn(neighbors.knn_pairs(points(spark, x, 3), 4, leaf_size=16)) == brute_knn(x, x, 4)
    assert seen["knn.tiles_run"]
