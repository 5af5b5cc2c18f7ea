"""Sources, sinks, catalogue, windows and streams on small literal inputs."""

import hashlib
import io
import json
import os
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.functions import scalar
from geofeat.operators import catalog, examples, metrics, windows
from geofeat.sources import readers, writers
from geofeat.streaming import arrivals

GRID = "NCOLS 3\nnrows 2\nxllcorner 10\nyllcorner 20.5\ncellsize 2\nNODATA_value -1\n1 2 -1\n4 5 6\n"


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text(GRID)
    headers, cells = readers.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    h = headers.head()
    assert (h["col_count"], h["row_count"], h["x_ll"], h["y_ll"], h["cell_size"], h["nodata_value"]) == (3, 2, 10, 20.5, 2, -1)
    assert sorted((r["row"], r["col"], r["z"]) for r in cells.collect() if r["z"] is not None) == [(0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 5), (1, 2, 6)]
    named = cells.withColumn("area", F.lit("a"))
    lines = writers.ascii_rows(named, headers.withColumn("area", F.lit("a")), -1.0).orderBy("n").collect()
    assert [r["line"] for r in lines] == ["ncols 3", "nrows 2", "xllcorner 10", "yllcorner 20.5", "cellsize 2", "NODATA_value -1", "1 2 -1", "4 5 6"]


def test_text_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("2\n7 3 0 1 1 0 0 1\n3 5 6 6 5 5 6\n9 9 9\n")
    got = [(r["mask"], r["xs"], r["ys"]) for r in readers.read_polygons(spark, str(tmp_path / "p.txt")).orderBy("ord").collect()]
    assert got == [(7, [0, 1, 1], [0, 0, 1]), (1, [5, 6, 6], [5, 5, 6])]
    (tmp_path / "r.txt").write_text("header\n* x\n0 0.0\n1800 0.0000042\n3600 2e-3\n")
    assert [r["amount"] for r in readers.read_rainfall(spark, str(tmp_path / "r.txt")).orderBy("t").collect()] == [0.0, 0.0000042, 0.002]
    (tmp_path / "k.txt").write_text("# note\nA = b\n\nc=d e\n")
    assert readers.read_kv(spark, str(tmp_path / "k.txt")).head()["settings"] == {"a": "b", "c": "d e"}
    (tmp_path / "bad.txt").write_text("nothing\n")
    with pytest.raises(Exception, match="delimiter"):
        readers.read_kv(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "d.txt").write_text("x y d z\n0 1 .5 9\n 2  3 .25\n")
    assert [tuple(r)[1:] for r in readers.read_depth_points(spark, str(tmp_path / "d.txt")).orderBy("ord").collect()] == [(0, 0, 1, 0.5), (1, 2, 3, 0.25)]
    (tmp_path / "h.json").write_text(json.dumps({"study_area": "a", "col_count": 2, "crs": None}))
    assert readers.read_headers(spark, str(tmp_path / "h.json")).head()["col_count"] == 2


def test_blobs(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(2, 3))
    (tmp_path / "b.npy").write_bytes(b"junk")
    got = readers.read_npy_cells(spark, str(tmp_path / "*.npy"), strict=False).collect()
    assert {tuple(r["idx"]): r["value"] for r in got} == {(r, c): 3 * r + c for r in range(2) for c in range(3)}
    with pytest.raises(Exception, match="."):
        readers.read_npy_cells(spark, str(tmp_path / "b.npy")).collect()
    with tarfile.open(tmp_path / "c.tar", "w") as tar:
        for name in ("elevation.asc", "odd.bin"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    got = {r["member"]: (r["layer"], bytes(r["content"])) for r in readers.read_bundle(spark, str(tmp_path / "c.tar")).collect()}
    assert got == {"elevation.asc": ("elevation", b"abc"), "odd.bin": (None, b"abc")}


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(k, "a", 1.5) for k in range(4)], "x_index int, study_area string, v double").selectExpr("*", "0 y_index", "0 row", "0 col")
    writers.write_cells(p, f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").filter("x_index = 2").count() == 1
    writers.guarded_write(p, f"{tmp_path}/guard")
    with pytest.raises(Exception, match="exists"):
        writers.guarded_write(p, f"{tmp_path}/guard")
    writers.guarded_write(p, f"{tmp_path}/guard", overwrite=True)
    d = spark.createDataFrame([("c1", 0, 1, 2.0), ("c1", 0, 0, 1.0), ("c0", 0, 0, 5.0)], "chunk string, row int, col int, depth double")
    assert [json.loads(r["line"]) for r in writers.prediction_lines(d).collect()] == [{"instance": {"values": [1], "key": "c0"}, "prediction": [[5.0]]}, {"instance": {"values": [1], "key": "c1"}, "prediction": [[1.0, 2.0]]}]


def test_polygons_of_a_large_area_are_several_files(spark, tmp_path):
    rows = [("a", k, k + 1, [float(k), k + 1.0, k + 1.0], [0.0, 0.0, 2.0]) for k in range(7)] + [("b", 3, 9, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])]
    p = spark.createDataFrame(rows, "area string, ord int, mask int, xs array<double>, ys array<double>")
    for file_polygons, files in ((3, 3), (100, 1)):
        path = f"{tmp_path}/polygons{file_polygons}"
        writers.write_polygons(p, path, ["area"], file_polygons=file_polygons)
        back = readers.read_polygons(spark, f"{path}/*/*").orderBy("path", "ord").collect()
        assert [(r["mask"], r["xs"], r["ys"]) for r in back] == [(m, xs, ys) for _, _, m, xs, ys in rows]
        assert len({r["path"] for r in back if "area=a" in r["path"]}) == files


def test_catalog(spark, tmp_path):
    t = spark.createDataFrame([("a", "init", None, "bad"), ("b", "init", "p", None)], "name string, state string, path string, error string")
    new = spark.createDataFrame([("a", "x"), ("c", "y")], "name string, path string")
    assert {tuple(r) for r in catalog.merge_fields(t, new, ["name"], ("error",)).collect()} == {("a", "init", "x", None), ("b", "init", "p", None), ("c", None, "y", None)}
    assert {tuple(r) for r in catalog.upsert(t, new, ["name"], replace=False).collect()} == {("a", "init", None, "bad"), ("b", "init", "p", None), ("c", None, "y", None)}
    c = catalog.Catalog(spark, str(tmp_path))
    c.write("areas", t)
    c.write("areas", catalog.set_state(c.table("areas"), t.select("name"), "rescaling-done"))
    assert {r["state"] for r in c.table("areas").collect()} == {"rescaling-done"}
    with pytest.raises(ValueError, match="areas"):
        c.assert_exists("areas", spark.createDataFrame([("zz",)], "name string"))
    with pytest.raises(ValueError):
        catalog.set_state(t, t.select("name"), "odd")
    with pytest.raises(Exception, match="no such row: zz"):
        catalog.set_state(t, spark.createDataFrame([("zz",)], "name string"), "init").collect()


def test_label_chunks(spark):
    areas = spark.createDataFrame([("s", 2, 5)], "name string, chunk_x_count int, chunk_y_count int")
    configs = spark.createDataFrame([("c",)], "name string")
    rows = spark.createDataFrame([("s", "c", 0, 1, "p1"), ("s", "c", 1, 4, "p2")], "study_area string, configuration string, x_index int, y_index int, path string")
    table = rows.limit(0).withColumn("dataset", F.lit("train"))
    first = catalog.register_label_chunks(table, rows.filter("x_index = 0"), areas, configs)
    both = {(r["x_index"], r["y_index"]): r["dataset"] for r in catalog.register_label_chunks(first, rows, areas, configs).collect()}
    whole = examples.area_split(areas.selectExpr("name study_area", "'c' config", "chunk_x_count", "chunk_y_count")).collect()
    assert both == {(r["x_index"], r["y_index"]): r["dataset"] for r in whole if (r["x_index"], r["y_index"]) in both} and len(both) == 2
    for change, message in (("study_area", "unknown study_area"), ("configuration", "unknown configuration")):
        with pytest.raises(Exception, match=message):
            catalog.register_label_chunks(table, rows.withColumn(change, F.lit("zz")), areas, configs).collect()
    with pytest.raises(Exception, match="unknown study_area: zz"):
        catalog.insert_simulation(rows.select("path", "study_area", "configuration"), rows.select("path", F.lit("zz").alias("study_area"), "configuration"), areas, configs).collect()


def test_shard_and_order(spark):
    d = spark.createDataFrame([(f"s{k % 5}", k) for k in range(20)], "sim string, k int").repartition(4)
    parts = [{r["k"] for r in examples.shard(d, 3, k).collect()} for k in range(3)]
    assert parts == [{k for k in range(20) if k % 5 % 3 == n} for n in range(3)]
    stems = spark.createDataFrame([("b",), ("c",), ("a",), ("d",)], "stem string").repartition(3)
    assert [r["stem"] for r in examples.stable_order(stems, stems.filter("stem <> 'c'")).collect()] == ["a", "b", "d"]


def test_depth_steps_replace(spark, tmp_path):
    """One point on a grid: its step is written whole, and a replay or a later file of the step leaves one version."""
    h = spark.createDataFrame([("a", 4, 4, 0.0, 0.0, 1.0)], "area string, col_count int, row_count int, x_ll double, y_ll double, cell_size double")
    for t, x, depth in ((3, 1.0, 0.5), (3, 1.0, 0.5), (7, 2.0, 0.25), (3, 2.0, 0.75)):
        p = spark.createDataFrame([("a", t, 0, x, 2.0, depth)], "area string, t int, ord int, x double, y double, depth double")
        arrivals.write_steps(arrivals.ingest_depth_stream(p, h, 2), str(tmp_path / "d"))
    got = spark.read.parquet(str(tmp_path / "d"))
    assert got.count() == 32
    assert {(r["t"], r["x_index"], r["col"], r["depth"]) for r in got.filter("depth > 0").collect()} == {(3, 1, 0, 0.75), (7, 1, 0, 0.25)}


def test_collapse_frees_state(spark, tmp_path):
    """Chunks long past the watermark leave the state; those that are whole were emitted before."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        rows = [{"sim": "s", "x_index": k, "y_index": 0, "t": t, "at": f"2024-01-0{k + 1} 0{t}:00:00"} for t in range(2)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))  # read in this order
    stream = spark.readStream.schema("sim string, x_index int, y_index int, t int, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = arrivals.collapse_stream(stream, 2, time="at")
    with arrivals.map_state(spark):
        q = out.writeStream.format("memory").queryName("freed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["x_index"] for r in spark.table("freed").collect()) == [0, 1, 2, 3]
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 8  # a count, a due time and a timer each of at most two chunks


def test_pairing_errors_and_splits(spark):
    f = spark.createDataFrame([(0, 0), (0, 2)], "x_index int, y_index int")
    lab = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "x_index int, y_index int, v double")
    with pytest.raises(ValueError, match=r"\(0, 1\)"):
        examples.pair_features_labels(f, lab)
    chunks = spark.createDataFrame([(a, c, x, y, 3, 7) for a in ("s", "t") for c in ("c1", "c2") for x in range(3) for y in range(7)], "study_area string, config string, x_index int, y_index int, chunk_x_count int, chunk_y_count int")
    for mode in ("hash", "compat"):
        got = examples.dataset_split(chunks, mode).collect()
        for c in ("c1", "c2"):
            of = [r["dataset"] for r in got if r["config"] == c and r["study_area"] == "t"]
            assert (of.count("train"), of.count("val"), of.count("test")) == (12, 4, 5)
    # Chunks that are not there yet don't move the others.
    few = {tuple(r) for r in examples.dataset_split(chunks.filter("y_index < 2"), "compat").collect()}
    assert few == {tuple(r) for r in got if r["y_index"] < 2}
    for a, c in (("s", "c1"), ("t", "c2")):
        order = [(x, y) for x in range(3) for y in range(7)]
        random.Random(hashlib.sha1(f"{a}{c}".encode()).hexdigest()).shuffle(order)
        assert {(r["x_index"], r["y_index"]) for r in got if (r["study_area"], r["config"], r["dataset"]) == (a, c, "train")} == set(order[:12])
    with pytest.raises(Exception, match="chunk_x_count"):
        examples.dataset_split(chunks.withColumn("chunk_x_count", F.lit(None).cast("int")), "compat").collect()
    again = {tuple(r) for r in examples.dataset_split(chunks.repartition(5)).collect()}
    assert again == {tuple(r) for r in examples.dataset_split(chunks).collect()}


def test_windows(spark):
    s = spark.createDataFrame([("a", t, float(t + 1)) for t in range(8)], "cell string, t int, v double")
    days = {}
    for r in windows.divide_into_days(s, ["cell"]).orderBy("day", "k").collect():
        days.setdefault(r["day"], []).append(r["v"])
    assert days == {0: [1, 1, 2, 3, 4, 5], 1: [4, 5, 6, 7, 8, 8]}
    assert [(r["before"], r["now"], r["after"]) for r in windows.io_sequences(s, ["cell"]).orderBy("t").collect()][:2] == [(1, 1, 2), (1, 2, 3)]
    rain = s.select(F.lit("c").alias("config"), "t", F.col("v").alias("amount"))
    assert [r["amount"] for r in windows.rain_windows(rain, 5).filter("t = 3").orderBy("k").collect()] == [0, 0, 1, 2, 3]
    with pytest.raises(Exception, match="too many"):
        windows.check_rainfall_length(rain, 5).collect()


def test_metrics(spark):
    lab = spark.createDataFrame([("e", t, float(t), t + 0.1 * e) for t in range(4) for e in [0]], "example string, t int, label double, prediction double")
    assert metrics.spatial_nse(lab, [], "example").head()[0] == pytest.approx(1)
    one = lab.withColumn("prediction", F.col("label") + F.col("t") * 0.1)
    assert metrics.spatial_nse(one, [], "example").head()[0] == pytest.approx(0.972, abs=1e-3)
    plus = lab.filter("t > 0").withColumn("prediction", F.col("label") + 1)
    assert metrics.nrmse(plus.unionByName(plus.withColumn("label", F.lit(4.0)).withColumn("prediction", F.lit(5.0))), []).head()[0] == pytest.approx(1 / 3)
    same = spark.createDataFrame([("i", r, c, float(r * c % 5) / 5) for r in range(12) for c in range(12)], "image string, row int, col int, label double").withColumn("prediction", F.col("label"))
    assert metrics.ssim(same).head()["ssim"] == pytest.approx(1)
    assert metrics.psnr(same, []).head()[0] == float("inf")


def test_hash_day_equals_hashlib(spark):
    import hashlib

    got = spark.range(1).select(scalar.hash_day(F.lit("sim"), F.lit("2000-05-24"))).head()[0]
    assert got == int(hashlib.sha256(b"sim2000-05-24").hexdigest(), 16) % 10**8 / 10**8


def test_collapse_stream_equals_batch(spark, tmp_path):
    files = [[(0, 0), (0, 1), (1, 0)], [(0, 1), (0, 2), (1, 2)], [(0, 2)]]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"sim": "s", "x_index": x, "y_index": 0, "t": t}) for x, t in rows))
    stream = spark.readStream.schema("sim string, x_index int, y_index int, t int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = arrivals.collapse_stream(stream, 3)
    with arrivals.map_state(spark):
        q = out.writeStream.format("memory").queryName("collapsed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table("collapsed").collect()]
    batch = spark.read.schema("sim string, x_index int, y_index int, t int").json(str(tmp_path / "in")).withColumn("v", F.lit(1.0))
    want = [(r["sim"], r["x_index"], r["y_index"], r["steps"]) for r in examples.collapse_timesteps(batch, ["sim", "x_index", "y_index"], 3).collect()]
    assert got == want == [("s", 0, 0, 3)]


def test_arrivals_and_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "R1_C1_T0.rsl").write_text("x y d\n0 1 2\n")
    (tmp_path / "in" / "other.txt").write_text("text")
    seen = []
    q = arrivals.each_batch(arrivals.arrivals(spark, str(tmp_path / "in")), lambda df, k: seen.extend(r["route"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["depth", "other"]
