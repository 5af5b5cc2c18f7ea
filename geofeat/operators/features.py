"""Soil, green areas and the eight flood feature layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofeat.functions.seeds import NODATA
from geofeat.operators import geometry, grid

PARAMETERS = ["hydraulic_conductivity", "wetting_front_suction_head", "effective_porosity", "effective_saturation"]
LAYERS = ["elevation", "elevation_mask", "building", "green", "conductivity", "suction", "porosity", "saturation"]
_KEY = ["area", "row", "col"]


def fill_nearest(cells: DataFrame, polygons: DataFrame, headers: DataFrame) -> DataFrame:
    """(area, row, col, soil) for cells (green, soil) with green 1 and soil 0: the class of the nearest polygon."""
    empty = cells.filter("green = 1 and soil = 0")
    return geometry.nearest_polygon(empty, polygons, headers).select(*_KEY, F.col("mask").alias("soil"))


def soil_as_green(green: DataFrame, soil: DataFrame, headers: DataFrame, excluded: list[int]) -> DataFrame:
    """Soil classes on green cells: classes not excluded where they lie, the nearest such class on green cells without any soil."""
    greens = geometry.covered(green, headers).select(*_KEY)
    soils = geometry.covered(soil, headers)
    cut = soils.filter(~F.col("mask").isin(excluded)).join(greens, _KEY, "left_semi").withColumnRenamed("mask", "soil")
    bare = greens.join(soils.select(*_KEY), _KEY, "left_anti").select("*", F.lit(1).alias("green"), F.lit(0).alias("soil"))
    filled = fill_nearest(bare, soil.filter(~F.col("mask").isin(excluded)), headers)
    return union_layers(cut.select(*_KEY, "soil"), filled)


def union_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def infiltration_layers(soil_cells: DataFrame, params: DataFrame) -> DataFrame:
    """Each parameter over its largest value; classes without parameters give 0."""
    top = params.select(*[F.max(c).alias(f"max_{c}") for c in PARAMETERS])
    shares = params.crossJoin(F.broadcast(top)).select("soil_class", *[(F.col(c) / F.col(f"max_{c}")).alias(c) for c in PARAMETERS])
    joined = soil_cells.join(F.broadcast(shares), soil_cells.soil == shares.soil_class, "left")
    names = ["conductivity", "suction", "porosity", "saturation"]
    return joined.select(*_KEY, *[F.coalesce(F.col(c), F.lit(0.0)).alias(n) for c, n in zip(PARAMETERS, names)])


def building_layer(cells: DataFrame) -> DataFrame:
    """No buildings where there is no elevation."""
    return cells.withColumn("building", F.when(F.col("present") == 0, 0).otherwise(F.coalesce("building", F.lit(0))))


def green_layer(cells: DataFrame) -> DataFrame:
    return cells.withColumn("green", ((F.col("present") == 1) & (F.coalesce("soil", F.lit(0)) != 0)).cast("int"))


def build_flood_features(elevation: DataFrame, headers: DataFrame, params: DataFrame, boundary: DataFrame | None = None, buildings: DataFrame | None = None, green: DataFrame | None = None, soil: DataFrame | None = None) -> DataFrame:
    """The eight layers of every cell; all joins share the key (area, row, col), so the cells are shuffled by it once."""
    marks = None if boundary is None else geometry.covered(boundary, headers)
    out = grid.elevation_layers(elevation, marks)
    for name, layer in (("building", buildings), ("soil", _soil(green, soil, headers))):
        if layer is None:
            out = out.withColumn(name, F.lit(0))
        else:
            cells = geometry.covered(layer, headers).withColumnRenamed("mask", name) if name == "building" else layer
            out = out.join(cells.select(*_KEY, name), _KEY, "left")
    out = green_layer(building_layer(out.withColumn("building", F.when(F.col("building").isNotNull() & (F.col("building") != 0), 1).otherwise(0))))
    kept = out.withColumn("soil", F.when(F.col("present") == 1, F.coalesce("soil", F.lit(0))).otherwise(0))
    shares = params.select("soil_class", *[(F.col(c) / F.max(c).over(Window.partitionBy(F.lit(1)))).alias(c) for c in PARAMETERS])
    joined = kept.join(F.broadcast(shares), kept.soil == shares.soil_class, "left")
    f = lambda c: F.col(c).cast("float")
    return joined.select(*_KEY, F.coalesce(f("z"), F.lit(NODATA).cast("float")).alias("elevation"), f("present").alias("elevation_mask"), f("building").alias("building"), f("green").alias("green"), *[F.coalesce(f(c), F.lit(0.0).cast("float")).alias(n) for c, n in zip(PARAMETERS, LAYERS[4:])])


def _soil(green: DataFrame | None, soil: DataFrame | None, headers: DataFrame) -> DataFrame | None:
    if green is None or soil is None:
        return None
    cells = geometry.covered(green, headers).select(*_KEY)
    soils = geometry.covered(soil, headers).withColumnRenamed("mask", "soil")
    own = cells.join(soils, _KEY, "left").withColumn("soil", F.coalesce("soil", F.lit(0))).withColumn("green", F.lit(1))
    filled = fill_nearest(own, soil, headers).withColumnRenamed("soil", "near")
    return own.join(filled, _KEY, "left").select(*_KEY, F.when(F.col("soil") == 0, F.coalesce("near", F.lit(0))).otherwise(F.col("soil")).alias("soil"))


def check_layers(files: DataFrame, required: tuple[str, ...] = ("elevation", "boundaries", "buildings", "green_areas")) -> DataFrame:
    """(chunk, complete): an archive without members, or with a part of the required ones, is an error that names them."""
    want = F.array(*[F.lit(x) for x in required])
    got = files.groupBy("chunk").agg(F.array_sort(F.collect_set("layer")).alias("got"))
    missing = F.array_except(want, F.col("got"))
    empty = F.raise_error(F.concat(F.lit("empty archive: "), F.col("chunk"))).cast("boolean")
    part = F.raise_error(F.concat(F.lit("missing in "), F.col("chunk"), F.lit(": "), F.array_join(missing, ", "))).cast("boolean")
    return got.select("chunk", F.when(F.size("got") == 0, empty).when(F.size(missing) > 0, part).otherwise(F.lit(True)).alias("complete"))


def layer_gaps(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(chunk, n_layers, missing): the same check as rows, for an error channel."""
    got = files.groupBy("chunk").agg(F.collect_set("layer").alias("got"))
    missing = F.array_except(F.array(*[F.lit(x) for x in required]), F.col("got"))
    return got.select("chunk", F.size("got").cast("long").alias("n_layers"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def soil_class_counts(soil_cells: DataFrame, by: list[str]) -> DataFrame:
    return soil_cells.groupBy(*by).agg(F.count("*").alias("n"))


def build_chunks(elevation: DataFrame, headers: DataFrame, layers: dict[str, DataFrame], size: int, soil_border: bool = True) -> dict[str, DataFrame]:
    """All layers of a study area per chunk; soil reaches a chunk further where it is filled from neighbours."""
    cells, chunk_headers = grid.chunk_elevation(elevation, headers, size)
    out = {"elevation": cells, "headers": chunk_headers}
    for name, polygons in layers.items():
        out[name] = geometry.assign_chunks(polygons, headers, size, size if name == "soil_classes" and soil_border else 0)
    return out


def build_sim_chunks(elevation: DataFrame, headers: DataFrame, layers: dict[str, DataFrame], size: int, most_null: float = 0.5) -> dict[str, DataFrame]:
    """Chunks for the simulator: only those with less than ``most_null`` nodata, green areas without duplicates."""
    out = build_chunks(elevation, headers, {k: geometry.dedupe_polygons(v) if k == "green_areas" else v for k, v in layers.items()}, size)
    keyed = elevation.select("area", grid.chunk_index("col", size).alias("x_index"), grid.chunk_index("row", size).alias("y_index"), "z")
    ready = grid.null_ratio(keyed, ["area", "x_index", "y_index"], size).filter(F.col("null_ratio") < most_null).select("area", "x_index", "y_index")
    return {k: v.join(ready, ["area", "x_index", "y_index"], "left_semi") for k, v in out.items()}


def prepare_area(elevation: DataFrame, headers: DataFrame, boundary: DataFrame, layers: dict[str, DataFrame], classes: list[int]) -> dict[str, DataFrame]:
    """Raster and layers of each area cut to the box of its boundary; listed soil classes become the non-green class. Areas without a boundary go."""
    from geofeat.functions.scalar import remap_soil, validate_masks

    box = geometry.layer_bbox(boundary, ["area"])
    cells, header = grid.crop_cells(elevation, headers, box)
    out = {"elevation": cells, "headers": header, "boundaries": boundary}
    for name, polygons in layers.items():
        cut = validate_masks(geometry.crop_polygons(polygons, box))
        out[name] = remap_soil(cut, classes) if name == "soil_classes" else cut
    return out
