"""A Spark data source for ``.npy`` arrays: ``spark.read.format("npy")``, and the same as a stream of arriving files.

A file is cut into blocks of cells in its own order; a task reads its block's bytes alone, by their place behind the header. The options ``pattern`` and
``first``, ``last`` (of the first dimension, d0) leave out files and blocks before any task starts. They are options and not pushed filters, because
Spark keeps what one query has pushed to a Python source for the next query on the same DataFrame, which would lose rows.
"""

from __future__ import annotations

import fnmatch
import math
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CELLS = 1 << 20


@dataclass
class Block(InputPartition):
    """Cells ``first`` to ``last`` of a file, whose data begin at byte ``start``."""

    path: str
    shape: tuple
    dtype: str
    fortran: bool
    start: int
    first: int
    last: int

    def rows(self) -> tuple[int, int]:
        """The first dimension's least and greatest value; all of it where the order is not row-major."""
        if self.fortran or not self.shape:
            return 0, max(0, (self.shape or (1,))[0] - 1)
        row = max(1, math.prod(self.shape[1:]))
        return self.first // row, max(self.first, self.last - 1) // row

    def read(self) -> pa.RecordBatch:
        fs, name = _place(self.path)
        kind = np.dtype(self.dtype)
        with fs.open_input_file(name) as f:
            f.seek(self.start + self.first * kind.itemsize)
            data = f.read((self.last - self.first) * kind.itemsize)
        value = np.frombuffer(data, kind).astype(np.float64)
        at = np.unravel_index(np.arange(self.first, self.last), self.shape, order="F" if self.fortran else "C") if self.shape else ()
        columns = [pa.array([self.path] * len(value), pa.string()), *[pa.array(x.astype(np.int32)) for x in at], pa.array(value)]
        return pa.record_batch(columns, ["path", *[f"d{k}" for k in range(len(at))], "value"])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _listed(path: str, pattern: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of the arrays at or below a path."""
    fs, name = _place(path)
    info = fs.get_file_info(name)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(name, recursive=True))
    head = path[: len(path) - len(name)] if path.endswith(name) else ("file://" if isinstance(fs, pafs.LocalFileSystem) else "")
    return sorted((f.mtime_ns or 0, head + f.path) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


def _blocks(path: str, size: int) -> list[Block]:
    fs, name = _place(path)
    with fs.open_input_file(name) as f:
        try:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, kind = read(f)
        except ValueError as e:
            raise ValueError(f"not an array file: {path}") from e
        start = f.tell()
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"not an array of numbers: {path}")
    n = math.prod(shape)
    return [Block(path, shape, kind.str, fortran, start, a, min(a + size, n)) for a in range(0, n, size)]


def _planned(paths: list[str], size: int, n_dims: int) -> list[Block]:
    with ThreadPoolExecutor(16) as pool:
        blocks = [b for part in pool.map(lambda p: _blocks(p, size), paths) for b in part]
    odd = next((b.path for b in blocks if len(b.shape) != n_dims), None)
    if odd:
        raise ValueError(f"array of other dimensions than {n_dims}: {odd}")
    return blocks


class NpyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options, self.n_dims = options, len(schema.fields) - 2

    def partitions(self) -> list[Block]:
        """Blocks that hold a row of the asked range."""
        paths = [p for _, p in _listed(self.options["path"], self.options.get("pattern", "*.npy"))]
        lo, hi = int(self.options.get("first", 0)), int(self.options.get("last", 1 << 62))
        blocks = _planned(paths, int(self.options.get("cells", CELLS)), self.n_dims)
        return [b for b in blocks if b.rows()[0] <= hi and b.rows()[1] >= lo]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        cells = partition.read()
        if "d0" in cells.schema.names and ("first" in self.options or "last" in self.options):
            d0 = cells.column("d0").to_numpy()
            cells = cells.filter(pa.array((d0 >= int(self.options.get("first", 0))) & (d0 <= int(self.options.get("last", 1 << 62)))))
        yield cells


class NpyStreamReader(DataSourceStreamReader):
    """Files in the order of their time of change and name; an offset names the last one that was read."""

    def __init__(self, schema: StructType, options: dict):
        self.options, self.n_dims = options, len(schema.fields) - 2

    def _files(self) -> list[tuple[int, str]]:
        return _listed(self.options["path"], self.options.get("pattern", "*.npy"))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Block]:
        lo, hi = ((o["time"], o["path"]) for o in (start, end))
        return _planned([f[1] for f in self._files() if lo < f <= hi], int(self.options.get("cells", CELLS)), self.n_dims)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        yield partition.read()


class NpySource(DataSource):
    """Options: ``path`` (a file or folder), ``pattern`` of names, ``cells`` a block, ``first`` and ``last`` of d0 (both included).

    Columns: path, d0, d1, .. as the first array has dimensions, value.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        files = _listed(self.options["path"], self.options.get("pattern", "*.npy"))
        if not files:
            raise ValueError(f"no arrays at {self.options['path']}; give a schema")
        fs, name = _place(files[0][1])
        with fs.open_input_file(name) as f:
            version = np.lib.format.read_magic(f)
            shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
        return ", ".join(["path string", *[f"d{k} int" for k in range(len(shape))], "value double"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return NpyStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(NpySource)
