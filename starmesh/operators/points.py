"""Point sets: a DataFrame with id, x0, x1, ... and any other columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dims(points: DataFrame) -> list[str]:
    """The position columns in order."""
    found = sorted((c for c in points.columns if re.fullmatch(r"x\d+", c)), key=lambda c: int(c[1:]))
    if not found or found != [f"x{i}" for i in range(len(found))]:
        raise ValueError("a point set needs columns x0, x1, ...")
    return found


def point_set(df: DataFrame, id_col: str, position: str | list[str], keep: list[str] | None = None, dim: int | None = None, integer: bool = False) -> DataFrame:
    """A point set from an id and either an array column (its first dim entries) or a list of columns.

    Values are cast to DOUBLE, -0.0 becomes 0.0, and rows without an id, or with a null or NaN
    coordinate, are left out. With integer values stay BIGINT, for z-orders and searches in them
    that are exact in all 64 bits.
    """
    if isinstance(position, str):
        if dim is None:
            raise ValueError("dim is needed for an array column")
        xs = [F.col(position)[i] for i in range(dim)]
    else:
        xs = [F.col(c) for c in position]
    xs = [x.cast("long") if integer else x.cast("double") + F.lit(0.0) for x in xs]
    out = df.select(F.col(id_col).cast("long").alias("id"), *[x.alias(f"x{i}") for i, x in enumerate(xs)], *(keep or []))
    sure = F.col("id").isNotNull()
    for i in range(len(xs)):
        sure = sure & F.col(f"x{i}").isNotNull()
        if not integer:
            sure = sure & ~F.isnan(f"x{i}")
    return out.where(sure)


def ensured(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which fails with the message when a row is read that does not fulfil the condition."""
    return df.where(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def union_types(*sets: DataFrame) -> DataFrame:
    """Point sets under one another, with ptype the number of the set; missing columns are null."""
    out = None
    for i, s in enumerate(sets):
        s = s.withColumn("ptype", F.lit(i).cast("byte"))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def of_type(points: DataFrame, ptype: int) -> DataFrame:
    return points.where(F.col("ptype") == ptype).drop("ptype")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows; nulls and NaN are equal to themselves."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
