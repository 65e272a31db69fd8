"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folder of this process's tables below the shared one.
_RUN = uuid.uuid4().hex
#: Paths that open scopes delete.
_scopes: list[list[str]] = []


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a warehouse that is no folder of one machine. A
    temporary folder is used only by a local master, where all tasks are on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"file://{tempfile.gettempdir()}"
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")):
            raise ValueError("no folder that all executors reach: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/starmesh/{_RUN}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors reach."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. This cuts the lineage, and a lost
    executor loses none of it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end: for results that are written there."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path)


def clean(spark: SparkSession) -> bool:
    """Deletes the tables that this process has stored. Results that were not yet written need them."""
    return _delete(spark, shared_base(spark))


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
