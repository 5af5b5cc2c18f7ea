"""Grids and polygons against plain containment, distance and slicing on shapes drawn by a seeded generator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.functions import scalar, seeds
from geofeat.operators import features, geometry, grid

POLYGON = "area string, ord int, mask int, xs array<double>, ys array<double>"


def ring(*points):
    return [float(x) for x, _ in (*points, points[0])], [float(y) for _, y in (*points, points[0])]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def layer(spark, shapes, area="a"):
    """Polygons of (ring, mask), in order."""
    return spark.createDataFrame([(area, k, m, *r) for k, (r, m) in enumerate(shapes)], POLYGON)


def header(spark, rows, cols, x=0.0, y=0.0, cell=1.0):
    return spark.createDataFrame([("a", cols, rows, x, y, cell)], grid.HEADER)


def cells(spark, values):
    """A cell table of a matrix; NaN is nodata."""
    rows = [("a", r, c, None if math.isnan(v) else float(v)) for r, line in enumerate(values.tolist()) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "area string, row int, col int, z double")


def matrix(df, value):
    got = {(r["row"], r["col"]): r[value] for r in df.collect()}
    n, m = max(k[0] for k in got) + 1, max(k[1] for k in got) + 1
    return np.array([[np.nan if got.get((r, c)) is None else got[r, c] for c in range(m)] for r in range(n)], float)


def same(a, b):
    return np.array_equal(np.asarray(a, float), np.asarray(b, float), equal_nan=True)


def inside(xs, ys, x, y):
    """Even-odd: how many edges cross the ray to the right."""
    odd = False
    for k in range(len(xs) - 1):
        if (ys[k] > y) != (ys[k + 1] > y) and x < xs[k] + (y - ys[k]) / (ys[k + 1] - ys[k]) * (xs[k + 1] - xs[k]):
            odd = not odd
    return odd


def distance(xs, ys, x, y):
    """From a point to a filled ring."""
    if inside(xs, ys, x, y):
        return 0.0
    best = math.inf
    for k in range(len(xs) - 1):
        dx, dy = xs[k + 1] - xs[k], ys[k + 1] - ys[k]
        t = min(1, max(0, ((x - xs[k]) * dx + (y - ys[k]) * dy) / (dx * dx + dy * dy or 1)))
        best = min(best, math.hypot(x - xs[k] - t * dx, y - ys[k] - t * dy))
    return best


def centre(rows, r, c):
    return c + 0.5, rows - r - 0.5


def brute_raster(shapes, rows, cols, background=0):
    out = np.full((rows, cols), background)
    for r in range(rows):
        for c in range(cols):
            for (xs, ys), mask in shapes:
                if inside(xs, ys, *centre(rows, r, c)):
                    out[r, c] = mask
    return out


def drawn(seed, n, width, height, corners=3):
    """Rings of some corners at odd places, which touch no cell centre."""
    rng = random.Random(seed)
    at = lambda: (rng.uniform(-1, width + 1), rng.uniform(-1, height + 1))
    return [(ring(*(at() for _ in range(corners))), k + 1) for k in range(n)]


@pytest.mark.parametrize("corners", [3, 4, 7])
def test_rasterize(spark, corners):
    shapes = drawn(corners, 6, 11, 8, corners)
    assert same(matrix(geometry.rasterize(layer(spark, shapes), header(spark, 8, 11)), "mask"), brute_raster(shapes, 8, 11))


def test_rasterize_background_and_errors(spark):
    shapes = drawn(21, 2, 6, 5)
    assert same(matrix(geometry.rasterize(layer(spark, shapes), header(spark, 5, 6), 77), "mask"), brute_raster(shapes, 5, 6, 77))
    assert same(matrix(geometry.rasterize(layer(spark, shapes).limit(0), header(spark, 2, 3), 77), "mask"), np.full((2, 3), 77))
    with pytest.raises(Exception, match="background"):
        geometry.rasterize(layer(spark, shapes).withColumn("mask", F.lit(77)), header(spark, 5, 6), 77).collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_rasterize_is_the_same_for_any_partitions(spark, parts):
    p = layer(spark, drawn(8, 15, 13, 13, 5))
    want = sorted(map(tuple, geometry.covered(p, header(spark, 13, 13)).collect()))
    assert sorted(map(tuple, geometry.covered(p.repartition(parts), header(spark, 13, 13)).collect())) == want


def test_layer_bbox(spark):
    shapes = drawn(4, 5, 30, 40, 6)
    xs, ys = ([v for (r, _) in shapes for v in r[k]] for k in (0, 1))
    assert tuple(geometry.layer_bbox(layer(spark, shapes), ["area"]).head())[1:] == (min(xs), min(ys), max(xs), max(ys))


def ring_area(points):
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]))) / 2


def test_crop_polygons(spark):
    rng = random.Random(6)
    cut = (3.3, 2.2, 12.7, 9.1)
    boxes = []
    for k in range(12):
        x, y = rng.uniform(-4, 16), rng.uniform(-4, 12)
        boxes.append((x, y, x + rng.uniform(1, 6), y + rng.uniform(1, 6)))
    want = {}
    for k, b in enumerate(boxes):
        part = (max(b[0], cut[0]), max(b[1], cut[1]), min(b[2], cut[2]), min(b[3], cut[3]))
        if part[0] < part[2] and part[1] < part[3]:
            want[k + 1] = pytest.approx(part)
    got = {r["mask"]: (min(r["xs"]), min(r["ys"]), max(r["xs"]), max(r["ys"])) for r in geometry.crop_polygons(layer(spark, [(box(*b), k + 1) for k, b in enumerate(boxes)]), cut).collect()}
    assert got == want and len(want) > 3


def test_crop_concave_ring():
    """A comb with three teeth: cut across the teeth it falls into three parts, whose area is that of the plain sum."""
    comb = [(0, 0), (1, 0), (1, 5), (2, 5), (2, 0), (3, 0), (3, 5), (4, 5), (4, 0), (5, 0), (5, 7), (0, 7)]
    xs, ys = ring(*comb)
    parts = geometry.clip_ring(xs, ys, (-1, 1, 6, 4))
    assert len(parts) == 3 and all(ring_area([tuple(p) for p in part]) == pytest.approx(3) for part in parts)
    assert geometry.clip_ring(xs, ys, (1.2, 1, 1.8, 4)) == []


def test_intersect_cells(spark):
    a, b = drawn(31, 3, 10, 9, 4), drawn(32, 3, 10, 9, 4)
    want = set()
    for (ra, m) in a:
        for k, (rb, _) in enumerate(b):
            want |= {(m, k, r, c) for r in range(9) for c in range(10) if inside(*ra, *centre(9, r, c)) and inside(*rb, *centre(9, r, c))}
    got = geometry.intersect_cells(layer(spark, a), layer(spark, b), header(spark, 9, 10)).collect()
    assert {(r["mask"], r["part"], r["row"], r["col"]) for r in got} == want and want


@pytest.mark.parametrize("far", [0, 300])
def test_nearest_polygon(spark, far):
    """The class of the polygon that is nearest to a cell's centre, near by or many tiles away."""
    shapes = [(([x + far for x in r[0]], r[1]), m) for r, m in drawn(17 + far, 4, 9, 7)]
    rng = random.Random(5)
    rows = [("a", r, c, int(rng.random() < 0.8), rng.choice([0, 0, 6])) for r in range(7) for c in range(9)]
    df = spark.createDataFrame(rows, "area string, row int, col int, green int, soil int")
    want = {}
    for _, r, c, green, soil in rows:
        if green and not soil:
            want[r, c] = min(shapes, key=lambda s: distance(*s[0], *centre(7, r, c)))[1]
    h = header(spark, 7, 9)
    near = [s for s in shapes]
    got = {(r["row"], r["col"]): r["soil"] for r in features.fill_nearest(df, layer(spark, near), h).collect()}
    apart = lambda k: {m for s, m in ((s[0], s[1]) for s in shapes) if distance(*s, *centre(7, *k)) <= min(distance(*t[0], *centre(7, *k)) for t in shapes) + 1e-9}
    assert set(got) == set(want) and all(got[k] in apart(k) for k in got)
    assert features.fill_nearest(df, layer(spark, near).limit(0), h).count() == 0


def test_feature_layers(spark):
    """All eight layers against a plain computation per cell, with nodata, a boundary, buildings and soil under part of the green."""
    rng = np.random.default_rng(12)
    rows, cols = 6, 7
    z = rng.uniform(0, 50, (rows, cols)).round(2)
    z[1, 2] = z[4, 4] = np.nan
    boundary = [(box(0.2, 0.2, 6.2, 5.7), 1)]
    buildings, green = [(box(4.1, 3.1, 5.9, 5.6), 1)], [(box(0.7, 0.3, 4.2, 4.4), 1)]
    soil = [(box(0.4, 0.4, 2.2, 2.3), 5), (box(2.6, 1.4, 3.8, 2.7), 4)]
    params = {r["soil_class"]: r for r in seeds.soil_params(spark).collect()}
    got = features.build_flood_features(cells(spark, z), header(spark, rows, cols), seeds.soil_params(spark), *(layer(spark, s) for s in (boundary, buildings, green, soil)))
    found = {(r["row"], r["col"]): [r[c] for c in features.LAYERS] for r in got.collect()}
    assert len(found) == rows * cols
    for r in range(rows):
        for c in range(cols):
            at = centre(rows, r, c)
            there = inside(*boundary[0][0], *at) and not math.isnan(z[r, c])
            kind = 0
            if there and inside(*green[0][0], *at):
                kind = next((m for s, m in reversed(soil) if inside(*s, *at)), 0) or min(soil, key=lambda s: distance(*s[0], *at))[1]
            shares = [params[kind][p] / max(q[p] for q in params.values()) if kind in params else 0 for p in features.PARAMETERS]
            want = [z[r, c] if there else features.NODATA, int(there), int(there and inside(*buildings[0][0], *at)), int(kind != 0), *shares]
            assert found[r, c] == pytest.approx(want, rel=1e-6), (r, c)


def test_feature_layers_without_polygons(spark):
    z = np.array([[4.5, np.nan, 3], [1, 2, 8]])
    got = features.build_flood_features(cells(spark, z), header(spark, 2, 3), seeds.soil_params(spark))
    assert same(matrix(got, "elevation"), np.where(np.isnan(z), features.NODATA, z))
    assert same(matrix(got, "elevation_mask"), ~np.isnan(z))


def test_rescale_and_stats(spark):
    z = np.array([[np.nan, 7.0, 2.5], [3.0, 12.0, -4.0]])
    stats = grid.elevation_stats(cells(spark, z), ["area"])
    assert tuple(stats.head()) == ("a", -4.0, 12.0)
    want = np.where(np.isnan(z), -1, (z + 4) / 16)
    assert np.allclose(matrix(grid.rescale_elevation(cells(spark, z), stats), "z"), want)
    with pytest.raises(Exception, match="range"):
        grid.rescale_elevation(cells(spark, z), stats.filter("area = 'b'")).collect()
    assert tuple(grid.elevation_stats(cells(spark, np.full((1, 3), np.nan)), ["area"]).head()) == ("a", None, None)


@pytest.mark.parametrize("pad", [0.0, None])
def test_split_chunks(spark, pad):
    z = np.random.default_rng(3).integers(1, 90, (5, 8)).astype(float)
    padded = np.full((6, 9), np.nan if pad is None else pad)
    padded[:5, :8] = z
    got = grid.split_chunks(cells(spark, z), header(spark, 5, 8), 3, pad)
    for x in range(3):
        for y in range(2):
            part = got.filter((F.col("x_index") == x) & (F.col("y_index") == y))
            assert same(matrix(part, "z"), padded[3 * y : 3 * y + 3, 3 * x : 3 * x + 3])


def test_chunk_headers(spark):
    """The lower left corner of each chunk: the top of the grid less the chunks above and its own rows."""
    got = {(r["x_index"], r["y_index"]): (r["x_ll"], r["y_ll"], r["col_count"]) for r in grid.chunk_headers(header(spark, 7, 6, 40.0, 8.0, 2.0), 4).collect()}
    assert got == {(x, y): (40 + 8 * x, 8 + 14 - 8 * (y + 1), 4) for x in range(2) for y in range(2)}


def test_assign_chunks(spark):
    """A polygon goes to the chunks that its box, widened by the border and a cell, meets."""
    shapes = drawn(40, 8, 24, 20)
    size, border = 8, 8
    want = {}
    for (xs, ys), m in shapes:
        for x in range(3):
            for y in range(3):
                x0, y1 = x * size - border - 1, 20 - y * size + border + 1
                x1, y0 = (x + 1) * size + border + 1, 20 - (y + 1) * size - border - 1
                if min(xs) <= x1 and max(xs) >= x0 and min(ys) <= y1 and max(ys) >= y0:
                    want.setdefault((x, y), set()).add(m)
    got = {}
    for r in geometry.assign_chunks(layer(spark, shapes), header(spark, 20, 24), size, border).collect():
        got.setdefault((r["x_index"], r["y_index"]), set()).add(r["mask"])
    assert got == want


@pytest.mark.parametrize("border", [0, 1, 2])
def test_crop_cells(spark, border):
    z = np.arange(54.0).reshape(6, 9)
    x, y, cell = 100.0, 50.0, 4.0
    cut = (111.0, 55.0, 125.0, 66.0)
    c0, c1 = math.floor((cut[0] - x) / cell) - border, math.ceil((cut[2] - x) / cell) + border
    top = y + 6 * cell
    r0, r1 = math.floor((top - cut[3]) / cell) - border, math.ceil((top - cut[1]) / cell) + border
    r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, 6), min(c1, 9)
    got, new = grid.crop_cells(cells(spark, z), header(spark, 6, 9, x, y, cell), cut, border)
    assert same(matrix(got, "z"), z[r0:r1, c0:c1])
    assert tuple(new.select("x_ll", "y_ll", "col_count", "row_count").head()) == (x + c0 * cell, top - r1 * cell, c1 - c0, r1 - r0)


def test_depth_points(spark):
    rng = random.Random(9)
    points = [("a", float(rng.randrange(6)), float(rng.randrange(1, 6)), rng.random(), k) for k in range(20)]
    want = np.zeros((5, 6))
    for _, x, y, depth, _ in points:  # a point marks its cell's corner; the last one of a cell counts
        want[5 - int(y), int(x)] = depth
    df = spark.createDataFrame(points, "area string, x double, y double, depth double, ord int")
    assert same(matrix(grid.rasterize_points(df, header(spark, 5, 6)), "depth"), want)


def test_scalars(spark):
    lo, hi = 20.0, 36.0
    row = spark.range(1).select(*[scalar.minmax(F.lit(v), lo, hi) for v in (24.0, 90.0, -3.0)], scalar.to_fraction(F.lit(61.5), F.lit("percentage"))).head()
    assert tuple(row) == (0.25, 1.0, 0.0, pytest.approx(0.615))
    s = spark.range(1).select(scalar.solar_time(F.lit("2023-03-09 21:30:00").cast("timestamp"), F.lit(52.5))["SOLAR_TIME"]).head()[0]
    assert s == pytest.approx((21.5 + 52.5 / 15) % 24)


def test_center_crop(spark):
    z = np.arange(35.0).reshape(5, 7)
    assert same(matrix(grid.center_crop(cells(spark, z), 3, 3, 5, 7), "z"), z[1:4, 2:5])
    with pytest.raises(ValueError):
        grid.center_crop(cells(spark, z), 6, 3, 5, 7)


def test_dedupe_polygons_by_ring_or_by_polygon(spark):
    """Polygons 1 and 2 share ring and mask; each comes twice."""
    d = layer(spark, [(box(0, 0, 2, 2), 1), (box(0, 0, 2, 2), 1), (box(0, 0, 2, 2), 3)])
    twice = d.union(d)
    assert geometry.dedupe_polygons(twice).count() == 2
    assert geometry.dedupe_polygons(twice, ("area", "ord", "mask", "xs", "ys")).count() == 3


def test_dedupe_polygons_query_counts_equal_rings(spark, tmp_path):
    """Suppliers 0 and 840 have the same rectangle and mask: the query counts both, as its SQL does."""
    from geofeat.plans.queries import QUERIES

    spark.createDataFrame([(0, 0), (840, 0), (1, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert QUERIES["dedupe_polygons"](spark, str(tmp_path)).head().asDict() == {"n": 3, "m": 5}
