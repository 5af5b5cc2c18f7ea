"""Polygon layers (area, layer, ord, mask, xs, ys) and their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofeat.operators import ranks
from geofeat.operators.grid import fill_dense


def bbox(xs: Column | str = "xs", ys: Column | str = "ys") -> tuple[Column, Column, Column, Column]:
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def layer_bbox(polygons: DataFrame, by: list[str]) -> DataFrame:
    x0, y0, x1, y1 = bbox()
    return polygons.groupBy(*by).agg(F.min(x0).alias("x_min"), F.min(y0).alias("y_min"), F.max(x1).alias("x_max"), F.max(y1).alias("y_max"))


def polygon_cells(polygons: DataFrame, headers: DataFrame) -> DataFrame:
    """(area, ord, mask, row, col) of every cell whose centre lies in a ring (even-odd; edges belong to the lower left).

    A scanline as joins: edges meet the rows whose centre line they cross, crossings are paired along each row, pairs become columns.
    """
    h = headers.select("area", "col_count", "row_count", "x_ll", "y_ll", "cell_size")
    after = lambda v, i: F.element_at(v, F.when(i < F.size("xs"), i + 1).otherwise(1))
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs")), lambda i: F.struct(F.element_at("xs", i).alias("x1"), F.element_at("ys", i).alias("y1"), after("xs", i).alias("x2"), after("ys", i).alias("y2")))
    edges = polygons.filter(F.size("xs") > 2).join(F.broadcast(h), "area").select("area", "ord", "mask", "col_count", "row_count", "x_ll", "y_ll", "cell_size", F.inline(pairs)).filter("y1 <> y2")
    line = lambda y: F.floor(F.col("row_count") - 0.5 - (y - F.col("y_ll")) / F.col("cell_size"))
    lo = F.greatest(line(F.greatest("y1", "y2")) + 1, F.lit(0))
    hi = F.least(line(F.least("y1", "y2")), F.col("row_count") - 1)
    hit = edges.withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int")).filter("lo <= hi").withColumn("row", F.explode(F.sequence("lo", "hi")))
    y = F.col("y_ll") + (F.col("row_count") - F.col("row") - 0.5) * F.col("cell_size")
    hit = hit.withColumn("x", F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    w = Window.partitionBy("area", "ord", "row").orderBy("x")
    spans = hit.withColumn("nth", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).filter("nth % 2 = 1 and to is not null")
    at = lambda x: F.ceil((F.col(x) - F.col("x_ll")) / F.col("cell_size") - 0.5)
    c0, c1 = F.greatest(at("x"), F.lit(0)).cast("int"), F.least(at("to") - 1, F.col("col_count") - 1).cast("int")
    spans = spans.withColumn("c0", c0).withColumn("c1", c1).filter("c0 <= c1")
    return spans.select("area", "ord", "mask", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def covered(polygons: DataFrame, headers: DataFrame) -> DataFrame:
    """(area, row, col, mask) of covered cells; the later polygon wins."""
    return polygon_cells(polygons, headers).groupBy("area", "row", "col").agg(F.max_by("mask", "ord").alias("mask"))


def rasterize(polygons: DataFrame, headers: DataFrame, background: int = 0) -> DataFrame:
    """The whole grid with ``background`` where no polygon lies; a polygon of that mask is an error."""
    wrong = F.raise_error(F.lit(f"mask equals the background {background}")).cast("int")
    checked = polygons.withColumn("mask", F.when(F.col("mask") == background, wrong).otherwise(F.col("mask")))
    return fill_dense(covered(checked, headers), headers, "mask", background)


def intersect_cells(layer: DataFrame, boundary: DataFrame, headers: DataFrame) -> DataFrame:
    """(area, ord, part, mask, row, col): the layer's cells within each boundary polygon, masks kept."""
    a = polygon_cells(layer, headers)
    b = polygon_cells(boundary, headers).select("area", "row", "col", F.col("ord").alias("part"))
    return a.join(b, ["area", "row", "col"]).select("area", "ord", "part", "mask", "row", "col")


def assign_chunks(polygons: DataFrame, headers: DataFrame, size: int, border: float = 0, border_units: str = "coords") -> DataFrame:
    """Each polygon with every chunk whose box, grown by a cell and the border, meets the polygon's box.

    The chunk range follows from the box, so no polygon is compared with every chunk.
    """
    h = headers.select("area", "col_count", "row_count", "x_ll", "y_ll", "cell_size")
    x0, y0, x1, y1 = bbox()
    side = F.col("cell_size") * size
    grow = F.col("cell_size") + (F.lit(border) * F.col("cell_size") if border_units == "cells" else F.lit(border))
    top = F.col("y_ll") + F.col("row_count") * F.col("cell_size")
    first = lambda near: F.greatest(F.ceil((near - grow) / side - 1), F.lit(0)).cast("int")
    last = lambda far, n: F.least(F.floor((far + grow) / side), F.ceil(F.col(n) / size) - 1).cast("int")
    j = polygons.join(h, "area").select(polygons["*"], first(x0 - F.col("x_ll")).alias("i0"), last(x1 - F.col("x_ll"), "col_count").alias("i1"), first(top - y1).alias("j0"), last(top - y0, "row_count").alias("j1"))
    j = j.filter("i0 <= i1 and j0 <= j1").withColumn("x_index", F.explode(F.sequence("i0", "i1"))).withColumn("y_index", F.explode(F.sequence("j0", "j1")))
    return j.drop("i0", "i1", "j0", "j1")


def chunk_polygons(polygons: DataFrame, headers: DataFrame, size: int, border: float = 0) -> DataFrame:
    """Chunk-major order; a polygon of several chunks comes several times."""
    return assign_chunks(polygons, headers, size, border).orderBy("area", "y_index", "x_index", "ord")


def cell_polygon(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One closed ring a cell."""
    x0 = F.col("x_ll") + F.col("cell_size") * F.col("col")
    y1 = F.col("y_ll") + (F.col("row_count") - F.col("row")) * F.col("cell_size")
    x1, y0 = x0 + F.col("cell_size"), y1 - F.col("cell_size")
    return cells.join(headers, "area").select(*cells.columns, F.array(x0, x1, x1, x0, x0).alias("xs"), F.array(y0, y0, y1, y1, y0).alias("ys"))


def dedupe_polygons(polygons: DataFrame, by: tuple[str, ...] = ("area", "mask", "xs", "ys")) -> DataFrame:
    """One polygon of each ring and mask; with ``ord`` in ``by``, only rows that repeat one polygon go and equal rings of several stay."""
    return polygons.dropDuplicates(list(by))


def explode_features(features: DataFrame) -> DataFrame:
    """Features (id, mask, type, rings array<array<struct<x,y>>>) of polygon kinds, one row a ring."""
    kept = features.filter(F.col("type").isin("Polygon", "MultiPolygon"))
    rings = kept.select("id", "mask", F.posexplode("rings").alias("part", "ring"))
    return rings.select("id", "mask", "part", F.transform("ring", lambda p: p["x"]).alias("xs"), F.transform("ring", lambda p: p["y"]).alias("ys"))


def _half_plane(ring: list, axis: int, bound: float, above: bool) -> list[list]:
    """Parts of a simple ring on one side of an axis-parallel line: inside chains are joined along the line in pairs."""
    side = [(p[axis] - bound if above else bound - p[axis]) for p in ring]
    if all(s >= 0 for s in side):
        return [ring] if any(s > 0 for s in side) else []
    if all(s <= 0 for s in side):
        return []
    n, chains, now = len(ring), [], None
    start = next(k for k in range(n) if side[k] <= 0 < side[(k + 1) % n])
    cut = lambda a, b, s, t: tuple(bound if k == axis else a[k] + (b[k] - a[k]) * s / (s - t) for k in (0, 1))
    for k in range(start, start + n):
        a, b, s, t = ring[k % n], ring[(k + 1) % n], side[k % n], side[(k + 1) % n]
        if s <= 0 < t:
            now = [cut(a, b, s, t) if s < 0 else a, b]
        elif s > 0 and t > 0:
            now.append(b)
        elif s > 0 >= t:
            now.append(cut(a, b, s, t) if t < 0 else b)
            chains.append(now)
            now = None
    other = 1 - axis
    ends = sorted([(c[0][other], i, 0) for i, c in enumerate(chains)] + [(c[-1][other], i, 1) for i, c in enumerate(chains)])
    mate = {}
    for (_, i, e), (_, j, f) in zip(ends[::2], ends[1::2]):
        mate[i, e], mate[j, f] = (j, f), (i, e)
    out, used = [], set()
    for i in range(len(chains)):
        if i in used:
            continue
        part, at = [], i
        while at not in used:
            used.add(at)
            part += chains[at]
            at = mate[at, 1][0]
        out.append(part)
    return out


def _area(ring: list) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def clip_ring(xs: list, ys: list, box: tuple) -> list[list]:
    ring = list(zip(map(float, xs), map(float, ys)))
    parts = [ring[:-1] if ring[0] == ring[-1] else ring]
    for axis, bound, above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        parts = [q for p in parts for q in _half_plane(p, axis, bound, above)]
    tidy = [[p for k, p in enumerate(r) if p != r[k - 1]] for r in parts]
    return [r for r in tidy if len(r) > 2 and _area(r) > 0]


def crop_polygons(polygons: DataFrame, box: tuple[float, float, float, float] | DataFrame) -> DataFrame:
    """Rings cut to a box: those outside go, those within stay as they are, others give a row a part. Only straddlers reach Python.

    A table (area, x_min, y_min, x_max, y_max) gives each area a box of its own; polygons of areas without one go.
    """
    from geofeat.functions.scalar import bbox_contains, bbox_intersects

    names, bounds = polygons.columns, ("x_min", "y_min", "x_max", "y_max")
    if isinstance(box, DataFrame):
        boxed = polygons.join(box.select("area", *[F.col(c).cast("double").alias(f"__{c}") for c in bounds]), "area")
    else:
        boxed = polygons.withColumns({f"__{c}": F.lit(float(v)) for c, v in zip(bounds, box)})
    cut, own = tuple(F.col(f"__{c}") for c in bounds), bbox()
    near = boxed.filter(bbox_intersects(cut, own))
    inside = bbox_contains(cut, own)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                for part in clip_ring(r["xs"], r["ys"], tuple(r[f"__{c}"] for c in bounds)):
                    closed = part + part[:1]
                    rows.append(r | {"xs": [p[0] for p in closed], "ys": [p[1] for p in closed]})
            yield pd.DataFrame(rows, columns=pdf.columns)[names]

    return near.filter(inside).select(*names).unionByName(near.filter(~inside).mapInPandas(run, polygons.select(*names).schema))


def ring_distance(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Least distance of a point from a ring, 0 inside (even-odd)."""
    n = F.size(xs)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(xs, i).alias("x1"), F.element_at(ys, i).alias("y1"), F.element_at(xs, F.when(i < n, i + 1).otherwise(1)).alias("x2"), F.element_at(ys, F.when(i < n, i + 1).otherwise(1)).alias("y2")))

    def gap(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))))
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"])))
    return F.when(F.size(crossed) % 2 == 1, F.lit(0.0)).otherwise(F.array_min(F.transform(edges, gap)))


def nearest_polygon(cells: DataFrame, polygons: DataFrame, headers: DataFrame, tile: int = 16) -> DataFrame:
    """(area, row, col, mask, dist): the polygon least far from each cell's centre; ties go to the first.

    Polygons are put on tiles of ``tile`` cells. A cell looks at its own tile and the eight around it; a best distance of no more than a
    tile's side is final. Tiles are twice as large in each further round, so that a cell looks at nine tiles whatever the distance,
    and only cells without a polygon near by go on. A polygon on several of the nine tiles is measured at the first one. Of polygons with one
    ring only the first can be the answer, so each ring is measured once.
    """
    h = headers.select("area", "col_count", "row_count", "x_ll", "y_ll", "cell_size")
    x0, y0, x1, y1 = bbox()
    unit = F.col("cell_size") * tile
    rings = polygons.groupBy("area", "xs", "ys").agg(F.min(F.struct("ord", "mask")).alias("first")).select("area", "first.ord", "first.mask", "xs", "ys")
    boxes = ranks.written(rings, "rings").join(F.broadcast(h), "area").select("area", "ord", "mask", "xs", "ys", *[((v - F.col(b)) / unit).alias(n) for n, v, b in (("i0", x0, "x_ll"), ("i1", x1, "x_ll"), ("j0", y0, "y_ll"), ("j1", y1, "y_ll"))])
    span = boxes.agg(F.max(F.greatest(*[F.abs(c) for c in ("i0", "i1", "j0", "j1")]))).head()[0]
    if span is None:
        return cells.select("area", "row", "col").limit(0).select("*", F.lit(0).alias("mask"), F.lit(0.0).alias("dist"))
    size = h.agg(F.max(F.greatest("col_count", "row_count"))).head()[0]
    x = F.col("x_ll") + (F.col("col") + 0.5) * F.col("cell_size")
    y = F.col("y_ll") + (F.col("row_count") - F.col("row") - 0.5) * F.col("cell_size")
    todo = cells.select("area", "row", "col").distinct().join(h, "area").select("area", "row", "col", x.alias("x"), y.alias("y"), unit.alias("unit"), ((x - F.col("x_ll")) / unit).alias("ci"), ((y - F.col("y_ll")) / unit).alias("cj"))
    done, scale = None, 1
    while True:
        at = lambda c: F.floor(F.col(c) / scale).cast("int")
        firsts = boxes.select("area", "ord", "mask", "xs", "ys", at("i0").alias("pi"), at("j0").alias("pj"), at("i1").alias("qi"), at("j1").alias("qj"))
        tiles = firsts.withColumn("i", F.explode(F.sequence("pi", "qi"))).withColumn("j", F.explode(F.sequence("pj", "qj"))).drop("qi", "qj")
        here = todo.withColumn("ti", at("ci")).withColumn("tj", at("cj"))
        around = here.withColumn("i", F.explode(F.sequence(F.col("ti") - 1, F.col("ti") + 1))).withColumn("j", F.explode(F.sequence(F.col("tj") - 1, F.col("tj") + 1)))
        met = around.join(tiles, ["area", "i", "j"]).filter((F.col("i") == F.greatest(F.col("ti") - 1, "pi")) & (F.col("j") == F.greatest(F.col("tj") - 1, "pj")))
        dist = ring_distance(F.col("x"), F.col("y"), F.col("xs"), F.col("ys"))
        best = met.groupBy("area", "row", "col").agg(F.min(F.struct(dist.alias("dist"), "ord", "mask")).alias("best"), F.first("unit").alias("unit"))
        last = scale > span + size / tile + 1
        sure = ranks.written(best.filter(F.lit(last) | (F.col("best.dist") <= F.col("unit") * scale)).select("area", "row", "col", "best.mask", "best.dist"), "nearest")
        done = sure if done is None else done.unionByName(sure)
        if last:
            return done
        todo = ranks.written(todo.join(sure.select("area", "row", "col"), ["area", "row", "col"], "left_anti"), "nearest")
        if todo.isEmpty():
            return done
        scale *= 2
