"""Generated point sets. Values come from Spark's seeded generators, one stream per partition; the
number of partitions is fixed by the number of points, so a seed gives the same points again."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import read_arrays


def _range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(4096, n // 250_000 + 1)))


def uniform_points(spark: SparkSession, n: int, dim: int = 3, total_mass: float = 1.0, lo: float = 0.0, hi: float = 1.0, seed: int = 0) -> DataFrame:
    return _range(spark, n).select("id", *[(F.rand(seed + i) * (hi - lo) + lo).alias(f"x{i}") for i in range(dim)], F.lit(total_mass / max(1, n)).alias("mass"))


def gaussian_points(spark: SparkSession, n: int, dim: int = 3, scale: float = 1.0, total_mass: float = 1.0, seed: int = 0) -> DataFrame:
    return _range(spark, n).select("id", *[(F.randn(seed + i) * scale).alias(f"x{i}") for i in range(dim)], F.lit(total_mass / max(1, n)).alias("mass"))


def clustered_points(spark: SparkSession, n: int, clumps: int = 40, dim: int = 2, boxsize: float = 100.0, spread: float = 0.01, seed: int = 0) -> DataFrame:
    """Gaussian clumps about centres that a hash of the clump's number places in the box."""
    clump = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(clumps))
    rows = _range(spark, n).withColumn("clump", clump)
    unit = lambda i: F.pmod(F.xxhash64("clump", F.lit(seed + 1 + i)), F.lit(1 << 30)) / float(1 << 30)
    return rows.select("id", *[F.pmod(unit(i) * boxsize + F.randn(seed + 100 + i) * spread * boxsize, F.lit(boxsize)).alias(f"x{i}") for i in range(dim)], F.lit(1.0).alias("mass"))


def points_of_file(spark: SparkSession, path: str, total_mass: float = 1.0) -> DataFrame:
    """A point set from array files of positions, such as a sample of a simulation; all of equal mass."""
    points = read_arrays(spark, path)
    xs = [c for c in points.columns if c != "id"]
    return points.select("id", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)], F.lit(total_mass / max(1, points.count())).alias("mass"))


def hernquist_points(spark: SparkSession, n: int, scale: float = 1.0, total_mass: float = 1.0, seed: int = 0, anisotropy: float | None = None) -> DataFrame:
    """Positions of a Hernquist sphere, by the inverse of its cumulative mass m = (r / (r + a))^2. With an
    anisotropy (1 - tangential / radial variance in a dimension, at most 1/2; 0 is isotropic) also
    velocities v0, v1, v2 that keep the sphere as it is, for a constant of gravity of 1."""
    root = F.sqrt(F.rand(seed) * (1 - 1e-9))
    r, cos, phi = scale * root / (1 - root), 2 * F.rand(seed + 1) - 1, 2 * math.pi * F.rand(seed + 2)
    rows = _range(spark, n).select("id", r.alias("r"), cos.alias("c"), phi.alias("phi"))
    s = F.sqrt(1 - F.col("c") * F.col("c"))
    at = rows.select("id", (F.col("r") * s * F.cos("phi")).alias("x0"), (F.col("r") * s * F.sin("phi")).alias("x1"), (F.col("r") * F.col("c")).alias("x2"), F.lit(total_mass / max(1, n)).alias("mass"))
    return at if anisotropy is None else _with_velocities(at, scale, total_mass, anisotropy, seed)


#: Draws of a speed by rejection, before the few that are left are drawn from their tabled distribution.
DRAWS = 64


def _gauss_series(a: float, b: float, c: float, z: np.ndarray, terms: int = 4000) -> np.ndarray:
    """The hypergeometric function 2F1(a, b; c; z) for z from 0 to 1 and c > a + b."""
    out, term = np.ones_like(z), np.ones_like(z)
    for k in range(terms):
        term = term * ((a + k) * (b + k) / ((c + k) * (k + 1))) * z
        out += term
    return out


def energy_density(beta: float, nodes: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(e, log g): the distribution function of a Hernquist sphere is L ** (-2 beta) g(e), with the
    binding energy e in units of the central potential; up to a factor. The density times
    r ** (2 beta) is a power series in the potential, and Abel's equation, solved term by term, makes
    g(e) = e ** (5/2 - beta) 2F1(5 - 2 beta, 1 - 2 beta; 7/2 - beta; e), here by Euler's transformation."""
    e = 1 - np.geomspace(1, 1e-9, nodes)
    e[0] = 1e-12
    series = _gauss_series(beta - 1.5, beta + 2.5, 3.5 - beta, e)
    return e, (2.5 - beta) * np.log(e) + (3 * beta - 2.5) * np.log1p(-e) + np.log(series)


def _uniform(ids: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """A number from 0 to 1 for each id, whatever rows are beside it."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + draw * 7919 + 1) & 0xFFFFFFFF) * np.uint64(0xD1B54A32D192ED03)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def speeds(ids: np.ndarray, psi: np.ndarray, beta: float, seed: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Speeds in units of the escape speed at potential psi (of the central one): density
    x ** (2 - 2 beta) g(psi (1 - x * x)). g grows, so g(psi) bounds it: most draws are by rejection."""
    e, log_g = table
    g = lambda own, x: np.interp(own * (1 - x * x), e, log_g)
    out, left = np.zeros(len(ids)), np.arange(len(ids))
    for draw in range(DRAWS):
        x = _uniform(ids[left], seed, 2 * draw) ** (1 / (3 - 2 * beta))
        fits = np.log(np.maximum(_uniform(ids[left], seed, 2 * draw + 1), 1e-300)) <= g(psi[left], x) - g(psi[left], 0.0)
        out[left[fits]] = x[fits]
        left = left[~fits]
        if not len(left):
            return out
    # Deep in the centre few speeds fit; there the distribution is summed up on a grid that is fine near 0.
    x = np.geomspace(1e-6, 1, 1000)
    for block in np.array_split(left, max(1, len(left) // 1000)):
        density = (3 - 2 * beta) * np.log(x)[None] + g(psi[block][:, None], x[None])
        sums = np.cumsum(np.exp(density - density.max(1, keepdims=True)), axis=1)
        u = _uniform(ids[block], seed, 2 * DRAWS)[:, None] * sums[:, -1:]
        out[block] = x[(sums < u).sum(1)]
    return out


def _with_velocities(points: DataFrame, scale: float, total_mass: float, beta: float, seed: int) -> DataFrame:
    if beta > 0.5:
        raise ValueError("the anisotropy of this sphere is at most 1/2")
    table, names = energy_density(beta), ("v0", "v1", "v2")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, x = part["id"].to_numpy(), part[["x0", "x1", "x2"]].to_numpy(float)
            r = np.sqrt((x * x).sum(1))
            psi = 1 / (1 + r / scale)
            v = speeds(ids, psi, beta, seed, table) * np.sqrt(2 * psi * total_mass / scale)
            # The angle from the radius has density sin ** (1 - 2 beta).
            angle, left = np.zeros(len(ids)), np.arange(len(ids))
            for draw in range(1000, 1400, 2):
                t = np.pi * _uniform(ids[left], seed, draw)
                fits = _uniform(ids[left], seed, draw + 1) <= np.sin(t) ** (1 - 2 * beta)
                angle[left[fits]] = t[fits]
                left = left[~fits]
            angle[left] = np.pi / 2
            radial = x / np.maximum(r, 1e-300)[:, None]
            # Two directions across the radius, from the axis that it is farthest from.
            axis = np.zeros_like(x)
            axis[np.arange(len(x)), abs(radial).argmin(1)] = 1
            one = np.cross(radial, axis)
            one /= np.sqrt((one * one).sum(1))[:, None]
            two, turn = np.cross(radial, one), 2 * np.pi * _uniform(ids, seed, 2000)
            across = np.cos(turn)[:, None] * one + np.sin(turn)[:, None] * two
            speed = v[:, None] * (np.cos(angle)[:, None] * radial + np.sin(angle)[:, None] * across)
            yield part.assign(**{c: speed[:, i] for i, c in enumerate(names)})

    return points.mapInPandas(run, StructType([*points.schema.fields, *[StructField(c, DoubleType()) for c in names]]))
