"""Mechanisms for large inputs: split scans, grids by blocks, mergeable metrics, state of single entries."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.operators import examples, grid, metrics
from geofeat.plans import queries
from geofeat.sources import readers
from geofeat.streaming import arrivals


@pytest.fixture
def small_splits(spark):
    """Files are cut every 2 kB."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "2048")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    files = {f"{k}.txt": ["".join(rng.choice("ab 1") for _ in range(rng.randint(0, 90))) for _ in range(n)] for k, n in enumerate((700, 1, 0, 333))}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    got = readers.numbered_lines(spark, str(tmp_path))
    assert readers._split(spark, str(tmp_path), None).select("path", "block").distinct().count() > 20
    assert sorted((r["path"].rsplit("/", 1)[-1], r["n"], r["line"]) for r in got.collect()) == sorted((f, k, x) for f, lines in files.items() for k, x in enumerate(lines))
    kept = readers.numbered_lines(spark, str(tmp_path), F.col("line").startswith("a"))
    assert sorted((r["path"].rsplit("/", 1)[-1], r["n"], r["line"]) for r in kept.collect()) == sorted((f, k, x) for f, lines in files.items() for k, x in enumerate(y for y in lines if y.startswith("a")))


def test_a_grid_of_many_splits(spark, tmp_path, small_splits):
    rng = np.random.default_rng(3)
    z = rng.integers(-5, 5, (60, 41)).astype(float)
    z[z == -5] = -9999
    head = "NCOLS 41\r\nnrows 60\r\n\r\nxllcorner 2.5\r\nyllcorner -1\r\ncellsize 2\r\n"
    (tmp_path / "a.asc").write_bytes((head + "\r\n".join(" ".join(f"{v:g}" for v in row) for row in z) + "\r\n\r\n").encode())
    headers, cells = readers.read_ascii_grid(spark, str(tmp_path / "a.asc"))
    assert headers.drop("path").head().asDict() == {"col_count": 41, "row_count": 60, "x_ll": 2.5, "y_ll": -1.0, "cell_size": 2.0, "nodata_value": -9999.0}
    assert cells.rdd.getNumPartitions() > 1
    assert {(r["row"], r["col"], r["z"]) for r in cells.collect()} == {(i, j, None if z[i, j] == -9999 else z[i, j]) for i in range(60) for j in range(41)}


def test_polygons_and_points_of_many_splits(spark, tmp_path, small_splits):
    lines = [f"{k % 7} 3 {k} {k + 1} {k + 2} 0 1 0" for k in range(300)]
    (tmp_path / "p.txt").write_text("299\n" + "\n".join(lines) + "\n")
    got = readers.read_polygons(spark, str(tmp_path / "p.txt")).collect()
    assert sorted((r["ord"], r["mask"], r["xs"]) for r in got) == [(k, k % 7, [k, k + 1, k + 2]) for k in range(299)]
    (tmp_path / "d.txt").write_text("x y depth\n" + "".join(f"{k} {-k} 0.5\n" for k in range(900)))
    assert sorted((r["ord"], r["x"], r["y"]) for r in readers.read_depth_points(spark, str(tmp_path / "d.txt")).collect()) == [(k, k, -k) for k in range(900)]
    (tmp_path / "r.txt").write_text("skip\n" + "".join(f"{k * 300} {k / 10}\n# no\n" for k in range(400)))
    assert sorted((r["t"], r["amount"]) for r in readers.read_rainfall(spark, str(tmp_path / "r.txt")).collect()) == [(k, k / 10) for k in range(400)]


def test_files_cut_otherwise_are_an_error(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(2000)))
    lines = readers.numbered_lines(spark, str(tmp_path))
    assert lines.count() == 2000
    # One range's number is off by one: never silently wrong.
    cut = readers._split
    try:
        readers._split = lambda *a: cut(*a).withColumn("at", F.when(F.col("line") == "line 0", 1 << 60).otherwise(F.col("at")))
        with pytest.raises(Exception, match="cut otherwise"):
            readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        readers._split = cut


HEADER = "area string, col_count int, row_count int, x_ll double, y_ll double, cell_size double"


def test_partitions_of_a_grid_follow_its_cells(spark):
    big = spark.createDataFrame([("a", 2000, 2100, 0.0, 0.0, 1.0), ("b", 3, 2, 0.0, 0.0, 1.0), ("none", 0, 5, 0.0, 0.0, 1.0)], HEADER)
    made = grid.dense_grid(big)
    assert made.rdd.getNumPartitions() >= 2000 * 2100 // grid.BLOCK // 256
    got = made.groupBy("area").agg(F.count("*").alias("n"), F.countDistinct("row", "col").alias("d"), F.max("row").alias("r"), F.max("col").alias("c")).collect()
    assert {tuple(r) for r in got} == {("a", 4_200_000, 4_200_000, 2099, 1999), ("b", 6, 6, 1, 2)}


def test_only_missing_cells_are_made(spark):
    rng = random.Random(4)
    there = {(rng.randrange(90), rng.randrange(70)): float(k) for k in range(800)}
    rows = [("a", r, c, None if v % 7 == 0 else v) for (r, c), v in there.items()] + [("a", 90, 0, 1.0), ("a", -1, 0, 1.0), ("x", 0, 0, 1.0)]
    cells = spark.createDataFrame(rows, "area string, row int, col int, z double")
    head = spark.createDataFrame([("a", 70, 90, 0.0, 0.0, 1.0), ("empty", 4, 3, 0.0, 0.0, 1.0)], HEADER)
    want = {("a", r, c, 0.5 if there.get((r, c), 0) % 7 == 0 else there[r, c]) for r in range(90) for c in range(70)} | {("empty", r, c, 0.5) for r in range(3) for c in range(4)}
    got = [tuple(r) for r in grid.fill_dense(cells, head, "z", 0.5).collect()]
    assert len(got) == len(want) and set(got) == want


NRMSE = metrics.Metric(
    lambda: (0, 0.0, math.inf, -math.inf),
    lambda s, p, t: (s[0] + len(t), s[1] + float(((p - t) ** 2).sum()), min(s[2], float(t.min())), max(s[3], float(t.max()))),
    lambda a, b: (a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])),
    lambda s: math.sqrt(s[1] / s[0]) / (s[3] - s[2]),
)


@pytest.mark.parametrize("by", [["k"], ["k", "f"], []])
def test_mergeable_metric(spark, by):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, None, math.nan]), rng.random(), rng.random() * 3) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, f double, prediction double, label double")
    name = lambda x: "nan" if x != x else x
    groups = {}
    for r in rows:
        groups.setdefault(tuple(name(r[("k", "f").index(c)]) for c in by), []).append(r)
    want = {g: math.sqrt(sum((x[2] - x[3]) ** 2 for x in v) / len(v)) / (max(x[3] for x in v) - min(x[3] for x in v)) for g, v in groups.items()}
    for parts, held in ((1, 50_000), (7, 1), (40, 3)):
        got = metrics.metric_udaf(NRMSE, by, df.repartition(parts), held=held, salts=3).collect()
        assert len(got) == len(want)
        for r in got:
            assert r["metric"] == pytest.approx(want[tuple(name(x) for x in r[:-1])])
    assert metrics.metric_udaf(NRMSE, by, df.limit(0)).count() == 0


def test_states_not_rows_are_shuffled(spark):
    """A third of a million rows of one group: each task sends one state."""
    sizes = []
    big = spark.range(330_000, numPartitions=6).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("prediction"), (F.col("id") + 1.0).alias("label"))
    seen = spark.sparkContext.accumulator(0)

    def merge(a, b):
        seen.add(1)
        return NRMSE.merge(a, b)

    out = metrics.metric_udaf(metrics.Metric(NRMSE.init, NRMSE.update, merge, NRMSE.result), ["k"], big).collect()
    assert out[0]["metric"] == pytest.approx(1 / 329_999) and seen.value == 5 and not sizes


def gate(spark, tmp_path, areas, name):
    stream = spark.readStream.schema("area string, x_index int, y_index int, elevation_min double, elevation_max double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with arrivals.map_state(spark):
        q = arrivals.rescale_gate(stream, areas).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_the_gate_fires_once(spark, tmp_path):
    areas = spark.createDataFrame([("a", 4), ("b", 4)], "area string, expected int")
    (tmp_path / "in").mkdir()

    def put(k, rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"area": a, "x_index": x, "y_index": y, "elevation_min": lo, "elevation_max": 9.0}) for a, x, y, lo in rows))

    out = lambda: sorted(tuple(r) for r in spark.read.schema("area string, x_index int, y_index int, elevation_min double, elevation_max double").parquet(str(tmp_path / "out")).collect())
    put(0, [("a", 0, 0, 3.0), ("a", 0, 1, None), ("b", 0, 0, 1.0), ("other", 0, 0, 1.0)])
    put(1, [("a", 0, 0, 3.0), ("a", 1, 0, 2.0)])  # one comes again
    gate(spark, tmp_path, areas, "g")
    assert out() == []
    put(2, [("a", 1, 1, 5.0)])
    q = gate(spark, tmp_path, areas, "g")  # from the checkpoint
    want = [("a", x, y, 2.0, 9.0) for x in (0, 1) for y in (0, 1)]
    assert out() == want
    put(3, [("a", 1, 1, 5.0), ("a", 0, 0, 0.0)])
    q = gate(spark, tmp_path, areas, "g")
    assert out() == want
    # Area a is one value now, b a value and a chunk.
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4


def test_an_area_without_a_number_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"area": "a", "x_index": 0, "y_index": 0}')
    with pytest.raises(Exception, match="without chunk counts"):
        gate(spark, tmp_path, spark.createDataFrame([("a", None)], "area string, expected int"), "g")


def _orders(spark, path):
    rows = [(k, c, s) for k, (c, s) in enumerate([(1, "F"), (1, "O"), (1, "P"), (2, "O"), (302, "O"), (3, "F"), (3, "P")])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{path}/orders.parquet")


def test_check_layers_query_keeps_archives_with_gaps(spark, tmp_path):
    from geofeat.operators import features
    from geofeat.plans.queries import QUERIES

    _orders(spark, tmp_path)
    got = {(r["chunk"], r["n_layers"], r["missing"]) for r in QUERIES["check_layers"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, ""), (2, 1, "F,P"), (3, 2, "O")}
    files = spark.createDataFrame([("x", "F"), ("x", "O")], "chunk string, layer string")
    with pytest.raises(Exception, match="missing in x: P"):
        features.check_layers(files, ("F", "O", "P")).collect()


def test_exported_layers_hold_no_pairs(spark, tmp_path):
    """Three polygons upon one another, within three parts of a boundary: nine pairs a cell, three rows, and a table that gives the pairs back."""
    from geofeat.operators import geometry
    from geofeat.sources import writers
    from tests.test_grid import box, header, layer

    h = header(spark, 6, 6)
    whole, parts = layer(spark, [(box(0, 0, 4, 4), 1)] * 3), layer(spark, [(box(1, 1, 6, 6), 1)] * 3)
    writers.export_sim_inputs(grid.dense_grid(h).withColumn("z", F.lit(1.0)), h, parts, whole, whole, f"{tmp_path}/x")
    cells = spark.read.parquet(f"{tmp_path}/x/buildings")
    assert cells.count() == 27 and spark.read.parquet(f"{tmp_path}/x/green_areas").count() == 27
    pairs = cells.join(spark.read.parquet(f"{tmp_path}/x/boundary"), ["area", "row", "col"])
    key = lambda df: {tuple(r) for r in df.select("area", "ord", "part", "mask", "row", "col").collect()}
    assert key(pairs) == key(geometry.intersect_cells(whole, parts, h)) and pairs.count() == 81


def test_last_points_sort_only_those_of_the_greatest_first_field(spark):
    rows = [(0, 1, 5, 10.0), (0, 2, 1, 20.0), (0, 2, 3, 30.0), (1, None, 4, 40.0), (1, None, 9, 50.0), (2, 7, None, 60.0)]
    d = spark.createDataFrame(rows, "g int, a long, b long, depth double").select("g", F.struct("a", "b").alias("ord"), "depth")
    assert {tuple(r) for r in grid.last_points(d, ["g"]).collect()} == {(0, 30.0), (1, 50.0), (2, 60.0)}
    points = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 1), ("a", 1.0, 1.0, 3.0, 2)], "area string, x double, y double, depth double, n long")
    from tests.test_grid import header

    made = grid.rasterize_points(points.select("area", "x", "y", "depth", F.struct("n").alias("ord")), header(spark, 3, 3))
    assert {(r["row"], r["col"]): r["depth"] for r in made.collect() if r["depth"]} == {(2, 1): 3.0}


def test_one_text_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from geofeat.plans import queries, roundtrips

    rows = [(k % 17, k % 3, float(k % 5)) for k in range(100)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(roundtrips, "_PART_LINES", 9)
    monkeypatch.setattr(roundtrips, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    got = queries.QUERIES["split_point_scan"](spark, str(tmp_path)).collect()
    assert sorted((r["ord"], r["l_orderkey"], r["l_linenumber"], r["depth"]) for r in got) == [(n, *r) for n, r in enumerate(sorted(rows))]
    assert len(list((tmp_path / "split/body").glob("part-*"))) > 5


def test_arriving_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from geofeat.plans import queries, roundtrips

    spark.createDataFrame([(k,) for k in range(21)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(roundtrips, "_PART_FILES", 3)
    monkeypatch.setattr(roundtrips, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    got = {r["route"]: r["n"] for r in queries.QUERIES["arrivals"](spark, str(tmp_path)).collect()}
    assert got == {"depth": 11, "other": 10}
    tasks = [p.name[:10] for p in (tmp_path / "arrivals/in").glob("name=*/part-*")]
    assert len(tasks) == 21 and len(set(tasks)) == 7 and max(map(tasks.count, tasks)) < 6


def test_nearest_polygon_measures_a_ring_once(spark, monkeypatch):
    """Of 60 polygons with two rings, the first one of the nearer ring is the answer, and two rings are measured."""
    from geofeat.operators import geometry, ranks
    from tests.test_grid import box, header, layer

    seen, write = [], ranks.written
    monkeypatch.setattr(ranks, "written", lambda df, name: seen.append((name, out := write(df, name))) or out)
    shapes = [(box(0, 0, 1, 1), 9 - k % 3) for k in range(30)] + [(box(5, 5, 6, 6), 4 + k % 3) for k in range(30)]
    cells = spark.createDataFrame([("a", 7, 0), ("a", 0, 7)], "area string, row int, col int")
    got = {(r["row"], r["col"]): r["mask"] for r in geometry.nearest_polygon(cells, layer(spark, shapes), header(spark, 8, 8)).collect()}
    assert got == {(7, 0): 9, (0, 7): 4}
    assert [df.count() for name, df in seen if name == "rings"] == [2]


def test_all_pairs_of_areas_by_tiles(spark):
    rng = random.Random(8)
    names = ["a", "b/c", "b%2Fc", "big", "big", "big", None, "only one side"]
    sims = [(rng.randrange(150), rng.choice(names[:-1]), {"k": 1}) for _ in range(400)]  # some rows are equal
    chunks = [(rng.choice([*names[:-2], None, "none here"]), rng.randrange(60), None if k % 9 else "x") for k in range(300)]
    a, b = spark.createDataFrame(sims, "sim long, study_area string, m map<string, int>"), spark.createDataFrame(chunks, "study_area string, chunk int, note string")
    plain = lambda x: x and x.replace("%2F", "/")
    want = sorted(((s, area, c, n) for s, area, _ in sims for other, c, n in chunks if area and plain(area) == plain(other)), key=str)
    assert len(want) > 10_000
    got = examples.chunk_metadata(a, b, check=False)
    assert got.columns == ["sim", "study_area", "m", "chunk", "note"]
    assert sorted((tuple(r) for r in got.drop("m").collect()), key=str) == want
    keyed = [df.withColumn("key", F.url_decode("study_area")) for df in (a, b.select("study_area", "chunk", "note"))]
    cut = examples.all_pairs(keyed[0], keyed[1].drop("study_area"), "key", (16, 8), 1024)
    assert cut.rdd.getNumPartitions() > 10
    assert sorted((tuple(r) for r in cut.drop("key", "m").collect()), key=str) == want
    assert examples.chunk_metadata(a.limit(0), b, check=False).count() == examples.chunk_metadata(a, b.limit(0), check=False).count() == 0
    with pytest.raises(ValueError, match="without chunks"):
        examples.chunk_metadata(a.fillna("only one side", ["study_area"]), b)


def test_pairs_of_areas_take_a_fraction_of_a_byte(spark, tmp_path):
    """Two million pairs of 100 areas whose rows come mixed: each area's stand together and pack well."""
    area = F.concat(F.lit("area"), F.pmod(F.xxhash64("id"), F.lit(100)))
    sims, chunks = spark.range(10_000).select(F.col("id").alias("sim"), area.alias("study_area")), spark.range(20_000).select(F.col("id").alias("chunk"), area.alias("study_area"))
    examples.chunk_metadata(sims, chunks, check=False).select("sim", "chunk").write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert 1_900_000 < rows < 2_100_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.8 * rows


def test_chunk_metadata_query_takes_keys_as_its_sql_does(spark, tmp_path):
    """Nulls meet nothing, and a nation's key is taken as it is."""
    orders = [(97 + k, None if k == 0 else 5 + 25 * k) for k in range(3)] + [(98, 30), (3, -20), (None, 5)]
    customers = [(97, None), (98, 5), (1, 30), (194, 5), (3, -20), (None, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["chunk_metadata"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["chunk_metadata"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 2
