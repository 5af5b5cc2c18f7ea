"""Rasters as cell tables (area, row, col, z) with one header row an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geofeat.operators import ranks

HEADER = "area string, col_count int, row_count int, x_ll double, y_ll double, cell_size double"


#: Cells that are made, or compared with those present, at a time.
BLOCK = 4096


def grid_blocks(headers: DataFrame, per_task: int = 256) -> DataFrame:
    """(area, col_count, block, first, many): runs of up to ``BLOCK`` cells of each grid, in row order, dealt to tasks by ``per_task`` blocks.

    The number of partitions follows the number of cells, which is summed over the headers first.
    """
    sized = headers.select("area", "col_count", (F.col("row_count").cast("long") * F.col("col_count")).alias("cells")).filter("cells > 0")
    total = sized.agg(F.coalesce(F.sum(F.ceil(F.col("cells") / BLOCK)), F.lit(0))).head()[0]
    blocks = sized.select("area", "col_count", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("cells") / BLOCK) - 1)).alias("block"))
    first = F.col("block") * BLOCK
    made = blocks.select("area", "col_count", "block", first.alias("first"), F.least(F.lit(BLOCK), F.col("cells") - first).cast("int").alias("many"))
    return made if total <= per_task else made.repartition(-(-int(total) // per_task), "area", "block")


def _placed(blocks: DataFrame, inner: Column) -> DataFrame:
    at = F.col("first") + F.col("inner")
    cells = blocks.select("area", "col_count", "first", F.explode(inner).alias("inner"))
    return cells.select("area", F.floor(at / F.col("col_count")).cast("int").alias("row"), F.pmod(at, F.col("col_count")).cast("int").alias("col"))


def dense_grid(headers: DataFrame) -> DataFrame:
    """(area, row, col) of every cell, made in tasks from blocks of cells."""
    return _placed(grid_blocks(headers), F.sequence(F.lit(0), F.col("many") - 1))


def missing_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(area, row, col) of the cells of the grids that ``cells`` lacks: per block, all places but those present. Only places are shuffled."""
    at = F.col("row").cast("long") * F.col("col_count") + F.col("col")
    present = within(cells, headers).select("area", F.floor(at / BLOCK).alias("block"), F.pmod(at, F.lit(BLOCK)).cast("int").alias("inner"))
    present = present.groupBy("area", "block").agg(F.collect_set("inner").alias("there"))
    whole = F.sequence(F.lit(0), F.col("many") - 1)
    blocks = grid_blocks(headers).join(present, ["area", "block"], "left")
    return _placed(blocks, F.when(F.col("there").isNull(), whole).otherwise(F.array_except(whole, "there")))


def within(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The cells that lie on their area's grid, with its ``row_count`` and ``col_count``."""
    sizes = headers.select("area", "row_count", "col_count")
    return cells.join(F.broadcast(sizes), "area").filter("row >= 0 and row < row_count and col >= 0 and col < col_count")


def fill_dense(cells: DataFrame, headers: DataFrame, value: str, default) -> DataFrame:
    """Every cell of the grids with its value; ``default`` where it is absent or null. Cells that are present stay where they are."""
    there = within(cells, headers).select("area", "row", "col", F.coalesce(F.col(value), F.lit(default)).alias(value))
    return there.unionByName(missing_cells(cells, headers).withColumn(value, F.lit(default).cast(there.schema[value].dataType)))


def split_chunks(cells: DataFrame, headers: DataFrame, size: int, pad: float | None = 0.0, value: str = "z") -> DataFrame:
    """Chunks of size x size cells: (area, x_index, y_index, row, col, value); absent cells are null, edge chunks are padded to full size."""
    up = lambda c: (F.ceil(F.col(c) / size) * size).cast("int")
    grown = headers.select("area", up("col_count").alias("col_count"), up("row_count").alias("row_count"))
    kind = cells.schema[value].dataType
    there = within(cells, headers).select("area", "row", "col", value)
    absent = missing_cells(there, grown).join(headers.select("area", F.col("row_count").alias("rs"), F.col("col_count").alias("cs")), "area")
    filled = F.when((F.col("row") >= F.col("rs")) | (F.col("col") >= F.col("cs")), F.lit(pad)).cast(kind)
    full = there.unionByName(absent.select("area", "row", "col", filled.alias(value)))
    return full.select("area", chunk_index("col", size).alias("x_index"), chunk_index("row", size).alias("y_index"), F.pmod("row", F.lit(size)).alias("row"), F.pmod("col", F.lit(size)).alias("col"), value)


def chunk_index(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("int")


def chunk_headers(headers: DataFrame, size: int) -> DataFrame:
    """A header for each chunk; the lower left corner lies below the grid where the chunk is padded."""
    side = F.col("cell_size") * size
    xs = headers.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("col_count") / size).cast("int") - 1)).alias("x_index"))
    both = xs.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("row_count") / size).cast("int") - 1)).alias("y_index"))
    top = F.col("y_ll") + F.col("row_count") * F.col("cell_size")
    return both.select("area", "x_index", "y_index", F.lit(size).alias("col_count"), F.lit(size).alias("row_count"), (F.col("x_ll") + F.col("x_index") * side).alias("x_ll"), (top - (F.col("y_index") + 1) * side).alias("y_ll"), "cell_size")


def chunk_elevation(cells: DataFrame, headers: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Elevation chunks padded with nodata (null), and their headers."""
    return split_chunks(cells, headers, size, None), chunk_headers(headers, size)


def crop_cells(cells: DataFrame, headers: DataFrame, bbox: tuple[float, float, float, float] | DataFrame, border: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cells that the box touches, with a border of cells, and the new header; indices start at 0 again.

    A table (area, x_min, y_min, x_max, y_max) gives each area a box of its own; areas without one go.
    """
    if isinstance(bbox, DataFrame):
        headers = headers.join(bbox.select("area", *[F.col(c).cast("double").alias(f"__{c}") for c in ("x_min", "y_min", "x_max", "y_max")]), "area")
        x0, y0, x1, y1 = (F.col(f"__{c}") for c in ("x_min", "y_min", "x_max", "y_max"))
    else:
        x0, y0, x1, y1 = map(F.lit, bbox)
    top = F.col("y_ll") + F.col("row_count") * F.col("cell_size")
    lo = lambda v: F.greatest(F.floor(v).cast("int") - border, F.lit(0))
    hi = lambda v, most: F.least(F.ceil(v).cast("int") + border, F.col(most))
    h = headers.select("*", lo((x0 - F.col("x_ll")) / F.col("cell_size")).alias("c0"), hi((x1 - F.col("x_ll")) / F.col("cell_size"), "col_count").alias("c1"), lo((top - y1) / F.col("cell_size")).alias("r0"), hi((top - y0) / F.col("cell_size"), "row_count").alias("r1"))
    kept = cells.join(h.select("area", "c0", "c1", "r0", "r1"), "area").filter("row >= r0 and row < r1 and col >= c0 and col < c1")
    new = h.select("area", (F.col("c1") - F.col("c0")).alias("col_count"), (F.col("r1") - F.col("r0")).alias("row_count"), (F.col("x_ll") + F.col("c0") * F.col("cell_size")).alias("x_ll"), (top - F.col("r1") * F.col("cell_size")).alias("y_ll"), "cell_size")
    return kept.select("area", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "z"), new


def center_crop(cells: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """The middle of a rows x cols grid; an odd surplus leaves one row or column more than asked."""
    if height > rows or width > cols:
        raise ValueError(f"cannot crop {rows}x{cols} to {height}x{width}")
    r, c = (rows - height) // 2, (cols - width) // 2
    kept = cells.filter(F.col("row").between(r, rows - r - 1) & F.col("col").between(c, cols - c - 1))
    return kept.withColumn("row", F.col("row") - r).withColumn("col", F.col("col") - c)


def rasterize_points(points: DataFrame, headers: DataFrame) -> DataFrame:
    """Depth points on cells, 0 elsewhere; of several points of a cell the last one in order counts."""
    from geofeat.functions.scalar import xy_to_cell

    row, col = xy_to_cell(F.col("x"), F.col("y"), F.col("x_ll"), F.col("y_ll"), F.col("row_count"), F.col("cell_size"))
    # A point marks the corner of its cell; its row counts from the top.
    hit = points.join(F.broadcast(headers), "area").select("area", row.alias("row"), col.alias("col"), "depth", "ord")
    return fill_dense(last_points(hit, ["area", "row", "col"]), headers, "depth", 0.0)


def last_points(hit: DataFrame, by: list[str]) -> DataFrame:
    """(by, depth) of the greatest ``ord`` of each group.

    Where ``ord`` is a struct, its first field's maximum is found first, by a plain aggregation of one number a group; only the points that
    reach it are compared, and sorted, by the whole ``ord``.
    """
    kind = hit.schema["ord"].dataType
    if isinstance(kind, StructType):
        lead = f"ord.{kind.fieldNames()[0]}"
        top = ranks.written(hit.groupBy(*by).agg(F.max(lead).alias("__top")), "top")
        hit = hit.join(top, by).filter(F.col(lead).eqNullSafe(F.col("__top")))
    return hit.groupBy(*by).agg(F.max_by("depth", "ord").alias("depth"))


def elevation_layers(cells: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(area, row, col, z, present): nodata outside the boundary cells; an absent layer masks nothing, an empty one all."""
    if boundary is not None:
        inside = boundary.select("area", "row", "col").distinct().withColumn("inside", F.lit(True))
        cells = cells.join(inside, ["area", "row", "col"], "left").withColumn("z", F.when(F.col("inside"), F.col("z"))).drop("inside")
    return cells.select("area", "row", "col", "z", F.col("z").isNotNull().cast("int").alias("present"))


def mask_outside(cells: DataFrame, boundary: DataFrame, nodata: float | None = None) -> DataFrame:
    out = elevation_layers(cells, boundary)
    return out.select("area", "row", "col", F.coalesce("z", F.lit(nodata)).alias("z")) if nodata is not None else out.drop("present")


def elevation_stats(cells: DataFrame, by: list[str]) -> DataFrame:
    """min and max without nodata; null where all is nodata. Partial sums merge, so chunks and areas are one operator."""
    return cells.groupBy(*by).agg(F.min("z").alias("elevation_min"), F.max("z").alias("elevation_max"))


def merge_stats(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*by).agg(F.min("elevation_min").alias("elevation_min"), F.max("elevation_max").alias("elevation_max"))


def rescale_elevation(features: DataFrame, stats: DataFrame, value: str = "z") -> DataFrame:
    """(z - min) / (max - min) where present, -1 elsewhere; an area without statistics is an error."""
    lo, hi = F.col("elevation_min"), F.col("elevation_max")
    unset = F.raise_error(F.concat(F.lit("no elevation range: "), F.col("area"))).cast("double")
    scaled = F.when(F.col(value).isNull(), F.lit(-1.0)).when(lo.isNull() | hi.isNull(), unset).otherwise((F.col(value) - lo) / (hi - lo))
    return features.join(stats.select("area", "elevation_min", "elevation_max"), "area", "left").withColumn(value, scaled).drop("elevation_min", "elevation_max")


def null_ratio(cells: DataFrame, by: list[str], size: int) -> DataFrame:
    """Nodata cells before padding over the full chunk area."""
    return cells.groupBy(*by).agg((F.count_if(F.col("z").isNull()) / float(size * size)).alias("null_ratio"))


def chunk_grid(areas: DataFrame) -> DataFrame:
    """Chunks per area; areas registered with several chunk sizes are an error."""
    out = areas.groupBy("area").agg(F.max("col_count").alias("col_count"), F.max("row_count").alias("row_count"), F.min("chunk_size").alias("chunk_size"), F.countDistinct("chunk_size").alias("sizes"))
    size = F.when(F.col("sizes") > 1, F.raise_error(F.concat(F.lit("several chunk sizes: "), F.col("area"))).cast("int")).otherwise(F.col("chunk_size"))
    count = lambda c: F.ceil(F.col(c) / F.col("chunk_size")).cast("long")
    return out.withColumn("chunk_size", size).select("area", "chunk_size", count("col_count").alias("chunk_x_count"), count("row_count").alias("chunk_y_count"))


def select_layers(df: DataFrame, layers: list[str], n: int) -> DataFrame:
    """The first n feature layers; trailing ones go."""
    return df.select(*[c for c in df.columns if c not in layers[n:]])
