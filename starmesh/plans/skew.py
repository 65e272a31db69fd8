"""Joins on keys of which some have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with many rows, at most; each of them has more than its share of all rows, so there are no more.
HEAVY = 50_000
#: Keys with fewer rows than this are never heavy.
LEAST = 10_000


def by_degree(rows: DataFrame, per: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """The inner join of rows with per, which has a row for each of some keys, with the number of rows
    that have this key in column size. Of n_rows in all at most HEAVY keys can have more than
    n_rows / HEAVY: these are broadcast, and their rows stay where they are. The others are joined by
    a shuffle, in which no key is larger than that."""
    most = max(LEAST, -(-n_rows // HEAVY))
    if n_rows <= most:
        return rows.join(per, key)
    heavy, light = per.where(F.col(size) > most), per.where(F.col(size) <= most)
    stay = rows.join(F.broadcast(heavy), key)
    move = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return stay.unionByName(move)
