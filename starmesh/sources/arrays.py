"""Array files (.npy) as tables, read and written in parallel.

A file is read by stretches of its rows: each task seeks to its own. A table is written as a folder of
files, one for each partition, as arrays of records. No row comes to the driver either way; it reads
the files' headers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a stretch, and of an Arrow batch.
STRETCH, BATCH = 64 << 20, 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The array files of a folder, in order, or the one that path names."""
    system, place = _opened(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(place))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".npy"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, offset of the first row)."""
    system, place = _opened(path)
    with system.open_input_file(place) as file:
        start = io.BytesIO(file.read(1 << 16))
    version = np.lib.format.read_magic(start)
    shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if kind.hasobject or not shape or len(shape) > 2 or (kind.names and len(shape) > 1) or (columns_first and len(shape) > 1):
        raise ValueError(f"{path} holds no rows of numbers: shape {shape}, type {kind}, {'columns first' if columns_first else 'rows first'}")
    return shape, kind, start.tell()


def _columns(shape: tuple[int, ...], kind: np.dtype) -> list[tuple[str, np.dtype]]:
    if kind.names:
        return [(n, kind[n]) for n in kind.names]
    return [(f"x{i}", kind) for i in range(shape[1] if len(shape) == 2 else 1)]


class _Stretch(InputPartition):
    def __init__(self, path: str, first: int, n: int, before: int):
        self.path, self.first, self.n, self.before = path, first, n, before


class _Reader(DataSourceReader):
    def __init__(self, path: str, stretch: int):
        self.path, self.stretch = path, stretch

    def partitions(self) -> list[_Stretch]:
        out, before = [], 0
        for file in _files(self.path):
            shape, kind, _ = _header(file)
            step = max(1, self.stretch // max(1, kind.itemsize * (shape[1] if len(shape) == 2 else 1)))
            out += [_Stretch(file, at, min(step, shape[0] - at), before) for at in range(0, shape[0], step)]
            before += shape[0]
        return out

    def read(self, part: _Stretch) -> Iterator[pa.RecordBatch]:
        shape, kind, offset = _header(part.path)
        columns, width = _columns(shape, kind), shape[1] if len(shape) == 2 else 1
        size = kind.itemsize * width
        system, place = _opened(part.path)
        with system.open_input_file(place) as file:
            file.seek(offset + part.first * size)
            at, step = 0, max(1, BATCH // size)
            while at < part.n:
                rows = min(step, part.n - at)
                held = np.frombuffer(file.read(rows * size), kind)
                held = held if kind.names else held.reshape(rows, width)
                first = part.before + part.first + at
                values = [held[n] if kind.names else held[:, i] for i, (n, _) in enumerate(columns)]
                arrays = [pa.array(np.ascontiguousarray(v.astype(v.dtype.newbyteorder("=")))) for v in values]
                names = [n for n, _ in columns]
                if "id" not in names:
                    arrays, names = [pa.array(np.arange(first, first + rows)), *arrays], ["id", *names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                at += rows


class NpySource(DataSource):
    """spark.read.format("npy").load(path): a folder of array files or one of them. Records give columns of
    their names, rows of numbers x0, x1, ...; without a column id that is the place in the files."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _path(self) -> str:
        return self.options["path"]

    def schema(self) -> StructType:
        files = _files(self._path())
        if not files:
            raise ValueError(f"no array files in {self._path()}")
        shape, kind, _ = _header(files[0])
        fields = [pa.field(n, pa.from_numpy_dtype(k.newbyteorder("="))) for n, k in _columns(shape, kind)]
        if "id" not in [f.name for f in fields]:
            fields.insert(0, pa.field("id", pa.int64()))
        return from_arrow_schema(pa.schema(fields))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._path(), int(self.options.get("stretch", STRETCH)))


def read_arrays(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("stretch", stretch).load(path)


def write_arrays(df: DataFrame, path: str) -> int:
    """Writes the columns, numbers without nulls, as arrays of records: a file part-N.npy for each
    partition, at its end, so that a task that is run again replaces its own. Returns the number of rows."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)
        held = pa.Table.from_batches(parts) if parts else None
        n = held.num_rows if held is not None else 0
        if n:
            for c in names:
                if held[c].null_count:
                    raise ValueError(f"column {c} has nulls")
            values = {c: held[c].to_numpy() for c in names}
            rows = np.empty(n, [(c, v.dtype) for c, v in values.items()])
            for c, v in values.items():
                rows[c] = v
            system, place = _opened(f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.npy")
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                head = io.BytesIO()
                np.lib.format.write_array_header_2_0(head, {"descr": np.lib.format.dtype_to_descr(rows.dtype), "fortran_order": False, "shape": rows.shape})
                out.write(head.getvalue())
                out.write(memoryview(rows).cast("B"))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    if bad := [f.name for f in df.schema.fields if f.dataType.typeName() not in ("double", "float", "long", "integer", "short", "byte")]:
        raise ValueError(f"no arrays of numbers: {', '.join(bad)}")
    return df.mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
