"""User functions over chunks: batch scoring and table functions."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.udtf import SkipRestOfInputTableException


def score(inputs: DataFrame, model_fn: Callable[[pd.DataFrame], pd.DataFrame], by: list[str], schema: str) -> DataFrame:
    """``model_fn`` gets all input rows of a chunk and returns rows (by, t, row, col, prediction); the largest over time is kept."""
    steps = inputs.groupBy(*by).applyInPandas(model_fn, schema)
    return steps.groupBy(*by, "row", "col").agg(F.max("prediction").alias("depth"))


def table_function(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, limit: int | None = None):
    """A table function over Arrow batches of a table's rows: ``fn`` gives any number of batches of ``schema`` for each batch.

    Register it (``spark.udtf.register``) and call it in SQL as ``name(TABLE(t) PARTITION BY ..)``, or call it on ``df.asTable()``. With
    ``limit`` a partition's input is skipped once that many rows have come out.
    """

    @arrow_udtf(returnType=schema)
    class Function:
        def __init__(self):
            self.n = 0

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for out in fn(rows):
                out = out if limit is None else out.slice(0, limit - self.n)
                self.n += out.num_rows
                yield out
                if limit is not None and self.n >= limit:
                    raise SkipRestOfInputTableException("enough rows")

    return Function


def npy_cells(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(path, at, value) of the cells of .npy blobs (path, content), for ``table_function``; ``at`` is the place in row-major order."""
    for path, content in zip(rows.column("path").to_pylist(), rows.column("content").to_pylist()):
        cells = np.load(io.BytesIO(content), allow_pickle=False).ravel().astype(np.float64)
        for a in range(0, len(cells), 1 << 16):
            part = cells[a : a + (1 << 16)]
            yield pa.record_batch([pa.array([path] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), pa.array(part)], ["path", "at", "value"])


NPY_CELLS = "path string, at long, value double"


def explode_blob(blobs: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a table function of all blobs; with ``by`` the input is partitioned, and ``limit`` counts for each partition of it."""
    table = blobs.asTable()
    return table_function(fn, schema, limit)(table.partitionBy(*by) if by else table)


def persistence_step(window: pd.DataFrame, t: int) -> pd.DataFrame:
    """The simplest step function: the last map again."""
    return window[window["t"] == window["t"].max()][["row", "col", "v"]].reset_index(drop=True)
