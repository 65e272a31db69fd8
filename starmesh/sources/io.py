"""Point sets and catalogues in Parquet: one folder per data set, one file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Name of the one-row table of a store's scalars.
ATTRIBUTES = "attributes"


def write_sets(path: str, mode: str = "error", compression: str = "zstd", **sets: DataFrame | dict | None) -> None:
    """Writes each DataFrame to path/name; None is skipped. A dict of scalars becomes a table of one
    row; a dict that holds DataFrames or further dicts is a group: a folder of sets, in which its
    scalars make one table, named ATTRIBUTES."""
    for name, data in sets.items():
        if data is None:
            continue
        place = f"{path.rstrip('/')}/{name}"
        if isinstance(data, dict):
            inner = {k: v for k, v in data.items() if isinstance(v, (DataFrame, dict))}
            known = {k: v for k, v in data.items() if v is not None and k not in inner}
            if inner:
                write_sets(place, mode, compression, **inner, **({ATTRIBUTES: known} if known else {}))
                continue
            data = SparkSession.active().createDataFrame([tuple(known.values())], list(known))
        data.write.mode(mode).option("compression", compression).parquet(place)


def read_set(spark: SparkSession, path: str, name: str, required: list[str] | StructType = (), optional: dict | None = None) -> DataFrame:
    """Reads path/name. A missing required column raises KeyError; a missing optional one gets its default."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{path.rstrip('/')}/{name}")
    names = required.names if isinstance(required, StructType) else list(required)
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"{name} has no {', '.join(missing)}")
    for c, default in (optional or {}).items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default))
    return df


def read_scalars(spark: SparkSession, path: str, name: str = ATTRIBUTES) -> dict:
    return read_set(spark, path, name).first().asDict()
