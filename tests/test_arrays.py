"""Array files as a data source, table functions, ordered parts and cells along a curve."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geofeat.operators import scoring
from geofeat.sources import arrays, readers, writers


@pytest.fixture
def folder(spark, tmp_path):
    arrays.register(spark)
    a = np.arange(60 * 7, dtype="<f4").reshape(60, 7)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(a[:9] * 2).astype(">i8"))
    np.save(tmp_path / "empty.npy", np.zeros((0, 7)))
    return tmp_path, {"a": a, "b": a[:9] * 2}


def test_arrays_by_blocks(spark, folder):
    path, want = folder
    df = spark.read.format("npy").option("path", str(path)).option("cells", 50).load()
    assert df.columns == ["path", "d0", "d1", "value"] and df.rdd.getNumPartitions() == 9 + 2
    got = {(r["path"].rsplit("/", 1)[-1][0], r["d0"], r["d1"], r["value"]) for r in df.collect()}
    assert got == {(n, i, j, float(x[i, j])) for n, x in want.items() for i in range(len(x)) for j in range(7)}


def test_ranges_leave_out_blocks(spark, folder):
    path, want = folder
    part = spark.read.format("npy").option("path", f"{path}").option("pattern", "a*").option("cells", 70).option("first", 20).option("last", 29).load()
    assert part.rdd.getNumPartitions() == 1  # one of six blocks
    assert sorted((r["d0"], r["d1"], r["value"]) for r in part.collect()) == [(i, j, float(want["a"][i, j])) for i in range(20, 30) for j in range(7)]
    assert part.filter("d0 = 25").count() == 7 and part.filter("d0 = 20 or d1 = 2").count() == 16


def test_what_is_no_array_is_an_error(spark, tmp_path):
    arrays.register(spark)
    (tmp_path / "x.npy").write_bytes(b"not an array")
    with pytest.raises(Exception, match="magic|array"):
        spark.read.format("npy").option("path", str(tmp_path)).load().count()
    with pytest.raises(Exception, match="no arrays"):
        spark.read.format("npy").option("path", str(tmp_path)).option("pattern", "*.none").load()


def test_arrays_arrive(spark, tmp_path):
    arrays.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("npy").schema("path string, d0 int, value double").option("path", str(tmp_path / "in")).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r["value"] for r in spark.read.schema("path string, d0 int, value double").parquet(str(tmp_path / "out")).collect())

    np.save(tmp_path / "in" / "0.npy", np.array([1.0, 2.0]))
    assert run() == [1, 2]
    np.save(tmp_path / "in" / "1.npy", np.array([3.0]))
    assert run() == [1, 2, 3]  # each file once


def blob(values):
    out = io.BytesIO()
    np.save(out, np.array(values, np.float64))
    return out.getvalue()


def test_table_functions(spark):
    blobs = spark.createDataFrame([(f"p{k}", blob(range(k))) for k in range(5)], "path string, content binary")
    blobs.createOrReplaceTempView("blobs")
    spark.udtf.register("npy_cells", scoring.table_function(scoring.npy_cells, scoring.NPY_CELLS))
    want = [(f"p{k}", i, float(i)) for k in range(5) for i in range(k)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM npy_cells(TABLE(blobs)) ORDER BY path, at").collect()] == want
    got = spark.sql("SELECT * FROM npy_cells(TABLE(blobs) PARTITION BY path) ORDER BY path, at").collect()
    assert [tuple(r) for r in got] == want
    two = scoring.explode_blob(blobs, scoring.npy_cells, scoring.NPY_CELLS, ["path"], limit=2).collect()
    assert sorted(map(tuple, two)) == [w for w in want if w[1] < 2]
    assert scoring.explode_blob(blobs.limit(0), scoring.npy_cells, scoring.NPY_CELLS).count() == 0


def test_parts_of_a_grid_are_in_order(spark, tmp_path):
    z = {(r, c): float((r * 31 + c * 7) % 100) for r in range(200) for c in range(9)}
    cells = spark.createDataFrame([("a", r, c, v) for (r, c), v in z.items()], "area string, row int, col int, z double")
    head = spark.createDataFrame([("a", 9, 200, 0.0, 0.0, 1.0)], "area string, col_count int, row_count int, x_ll double, y_ll double, cell_size double")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    writers.write_ascii_grid(cells, head, f"file://{tmp_path}/g")
    spark.conf.set("spark.sql.adaptive.enabled", old)
    parts = sorted((tmp_path / "g" / "area=a").glob("part*"))
    assert len(parts) > 1
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "ncols 9" and [list(map(float, x.split())) for x in lines[6:]] == [[z[r, c] for c in range(9)] for r in range(200)]
    listed = spark.read.parquet(f"{tmp_path}/g/_parts").orderBy("part").collect()
    assert [r["file"] for r in listed] == [p.name for p in parts] and sum(r["lines"] for r in listed) == 206
    _, back = readers.read_ascii_grid(spark, f"{tmp_path}/g/area=*", folders=True)
    assert {(r["row"], r["col"]): r["z"] for r in back.collect()} == z


def test_curve_ranges_cover_a_window():
    key = lambda r, c: sum(((r >> k & 1) << 2 * k + 1) | ((c >> k & 1) << 2 * k) for k in range(16))
    rng = random.Random(3)
    for _ in range(60):
        r0, c0 = rng.randrange(60), rng.randrange(60)
        r1, c1 = r0 + rng.randint(0, 20), c0 + rng.randint(0, 20)
        spans = writers.curve_ranges(r0, c0, r1, c1, most=rng.choice([1, 8, 64]))
        inside = {key(r, c) for r in range(r0, r1) for c in range(c0, c1)}
        assert all(any(lo <= k <= hi for lo, hi in spans) for k in inside)
        assert spans == sorted(spans) and len(spans) <= 64


def test_a_window_opens_few_files(spark, tmp_path):
    cells = spark.range(128 * 128).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("area"), (F.col("id") / 128).cast("int").alias("row"), (F.col("id") % 128).cast("int").alias("col"), F.col("id").cast("double").alias("z"))
    writers.write_cells_by_curve(cells, str(tmp_path / "c"), 64)
    part = writers.read_window(spark, str(tmp_path / "c"), "b", 32, 64, 48, 80)
    assert part.columns == ["area", "row", "col", "z"]
    assert {(r["row"], r["col"], r["z"]) for r in part.collect()} == {(r, c, float(r * 128 + c)) for r in range(32, 48) for c in range(64, 80)}
    assert len(part.inputFiles()) <= 4  # of 64: a window of a 128th of the cells
    assert writers.read_window(spark, str(tmp_path / "c"), "none", 0, 0, 9, 9).count() == 0


def test_snapshots_to_cells(spark):
    met = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]), (2, None, None)], "t int, a array<array<double>>, b array<array<double>>")
    got = readers.met_cells(met, ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 1.0, 5.0), (1, 0, 1, 2.0, 6.0), (1, 1, 0, 3.0, 7.0), (1, 1, 1, 4.0, 8.0)]


def test_batches_of_functions_are_arrow(spark):
    def double(rows):
        assert isinstance(rows, pa.RecordBatch)
        yield pa.record_batch([pa.array(rows.column("x").to_numpy() * 2)], ["y"])

    got = scoring.explode_blob(spark.range(5).withColumnRenamed("id", "x"), double, "y long")
    assert sorted(r["y"] for r in got.collect()) == [0, 2, 4, 6, 8]
