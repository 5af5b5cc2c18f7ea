"""Text, JSON, CSV and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def polygon_lines(polygons: DataFrame, by: list[str], with_mask: bool = True) -> DataFrame:
    """(by, text): the count, then a line a polygon: [mask] n xs ys."""
    join = lambda c: F.array_join(F.transform(c, _number), " ")
    parts = [F.col("mask").cast("string")] if with_mask else []
    line = F.concat_ws(" ", *parts, F.size("xs").cast("string"), join("xs"), join("ys"))
    got = polygons.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("all"))
    return got.select(*by, F.concat(F.size("all").cast("string"), F.lit("\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("text"))


def write_polygons(polygons: DataFrame, path: str, by: list[str], with_mask: bool = True, file_polygons: int = 100_000) -> None:
    """A file for about ``file_polygons`` polygons, cut at quantiles of ord; each begins with its own count, and files of an area are in order."""
    steps = 1000
    cuts = polygons.groupBy(*by).agg(F.ceil(F.count("*") / file_polygons).alias("files"), F.percentile_approx("ord", [k / steps for k in range(1, steps)]).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("ord"))) * F.least("files", F.lit(steps))
    file = F.format_string("%03d", F.coalesce(F.floor(below / steps), F.lit(0)))
    dealt = polygons.join(cuts, by, "left").withColumn("file", file).drop("files", "cuts")
    keys = [*by, "file"]
    polygon_lines(dealt, keys, with_mask).write.partitionBy(*keys).text(path)


def ascii_rows(cells: DataFrame, headers: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """(area, n, line): six header lines, then a line a row; only a row's cells meet in one place."""
    z = _number(F.coalesce("z", F.lit(nodata)))
    rows = cells.groupBy("area", "row").agg(F.array_sort(F.collect_list(F.struct("col", z.alias("z")))).alias("all"))
    body = rows.select("area", (F.col("row") + 6).alias("n"), F.array_join(F.transform("all", lambda x: x["z"]), " ").alias("line"))
    keys = [("ncols", F.col("col_count")), ("nrows", F.col("row_count")), ("xllcorner", _number(F.col("x_ll"))), ("yllcorner", _number(F.col("y_ll"))), ("cellsize", _number(F.col("cell_size"))), ("NODATA_value", _number(F.lit(nodata)))]
    head = headers.select("area", F.posexplode(F.array(*[F.concat(F.lit(f"{k} "), v.cast("string")) for k, v in keys])).alias("n", "line"))
    return head.unionByName(body)


def write_ascii_grid(cells: DataFrame, headers: DataFrame, path: str, nodata: float = -9999.0) -> None:
    """A folder an area of text parts, cut at ranges of rows: in the order of their names they are the grid file, the header first.

    ``path`` also gets ``_parts``, a table (area, part, file, lines) of them, for those who put a file together.
    """
    lines = ascii_rows(cells, headers, nodata)
    lines.repartitionByRange("area", "n").sortWithinPartitions("area", "n").select("area", "line").write.partitionBy("area").text(path)
    spark = cells.sparkSession
    files = spark.read.text(path).groupBy("area", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("lines"))
    part = F.row_number().over(Window.partitionBy("area").orderBy("file")) - 1
    files.select("area", part.alias("part"), "file", "lines").write.parquet(f"{path}/_parts")


def write_headers(headers: DataFrame, path: str) -> None:
    headers.write.json(path)


def write_cells(cells: DataFrame, path: str, by: tuple[str, ...] = ("study_area", "x_index", "y_index")) -> None:
    """Cells of a chunk in one file, sorted, so that range filters on row and col skip row groups."""
    cells.repartition(*by).sortWithinPartitions(*by, "row", "col").write.partitionBy(*by).parquet(path)


def write_layer(cells: DataFrame, path: str) -> None:
    """Cells of an area in files by ranges of rows, however many an area has."""
    keys = ["area", *[c for c in ("row", "col", "ord", "part") if c in cells.columns]]
    cells.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("area").parquet(path)


def curve_key(row: Column, col: Column, bits: int = 31) -> Column:
    """Place on the Z-order curve: the bits of row and column in turn. Cells that are near in the key lie near in the grid."""

    def spread(x: Column) -> Column:
        x = x.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def curve_ranges(r0: int, c0: int, r1: int, c1: int, most: int = 64) -> list[tuple[int, int]]:
    """Closed ranges of keys that cover the window of rows r0..r1-1 and columns c0..c1-1: squares of the curve, the largest cut first, up to ``most``."""
    side = 1
    while side < max(r1, c1):
        side *= 2
    squares, out = [(0, 0, side)] if r0 < r1 and c0 < c1 else [], []
    while squares:
        whole = [s for s in squares if r0 <= s[0] and s[0] + s[2] <= r1 and c0 <= s[1] and s[1] + s[2] <= c1]
        out += whole
        cut = [s for s in squares if s not in whole]
        if len(out) + 4 * len(cut) > most or not cut:
            out += cut
            break
        squares = [(r + i, c + j, n // 2) for r, c, n in cut for i in (0, n // 2) for j in (0, n // 2)]
        squares = [s for s in squares if s[0] < r1 and s[0] + s[2] > r0 and s[1] < c1 and s[1] + s[2] > c0]
    first = sorted((sum(((r >> k & 1) << 2 * k + 1) | ((c >> k & 1) << 2 * k) for k in range(32)), n * n) for r, c, n in out)
    ranges: list[tuple[int, int]] = []
    for at, n in first:
        if ranges and ranges[-1][1] == at - 1:
            ranges[-1] = (ranges[-1][0], at + n - 1)
        else:
            ranges.append((at, at + n - 1))
    return ranges


def write_cells_by_curve(cells: DataFrame, path: str, files: int) -> None:
    """Cells (area, row, col, ..) in ``files`` files along the curve, however many chunks there are; ``_ranges`` lists each file's keys."""
    keyed = cells.withColumn("key", curve_key(F.col("row"), F.col("col")))
    keyed.repartitionByRange(files, "area", "key").sortWithinPartitions("area", "key").write.parquet(f"{path}/cells")
    back = cells.sparkSession.read.parquet(f"{path}/cells")
    ranges = back.groupBy("area", F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("cells"))
    ranges.write.parquet(f"{path}/_ranges")


def read_window(spark: SparkSession, path: str, area: str, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The cells of a window (rows r0..r1-1, columns c0..c1-1) of an area; only files whose keys meet the window's are opened."""
    spans = curve_ranges(r0, c0, r1, c1)
    meets = F.lit(False)
    for lo, hi in spans:
        meets = meets | ((F.col("lo") <= hi) & (F.col("hi") >= lo))
    files = [r["file"] for r in spark.read.parquet(f"{path}/_ranges").filter((F.col("area") == area) & meets).select("file").collect()]
    whole = spark.read.parquet(f"{path}/cells")
    inside = (F.col("area") == area) & F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1)
    return (spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)).filter(inside & F.col("key").between(spans[0][0] if spans else 0, spans[-1][1] if spans else -1)).drop("key")


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """(chunk, line) in chunk order: instance and nested prediction rows, of cells (chunk, row, col, depth)."""
    rows = predictions.groupBy("chunk", "row").agg(F.array_sort(F.collect_list(F.struct("col", "depth"))).alias("c"))
    maps = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("row", F.transform("c", lambda x: x["depth"]).alias("v")))).alias("r"))
    line = F.to_json(F.struct(F.struct(F.array(F.lit(1)).alias("values"), F.col("chunk").alias("key")).alias("instance"), F.transform("r", lambda x: x["v"]).alias("prediction")))
    return maps.select("chunk", line.alias("line")).orderBy("chunk")


def write_prediction_jsonl(predictions: DataFrame, path: str) -> None:
    prediction_lines(predictions).select("line").write.text(path)


def prediction_path(run: Column, model: Column, area: Column, config: Column, chunk: Column) -> Column:
    return F.concat_ws("/", run, F.lit("flood"), model, area, config, chunk)


def guarded_write(df: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ()) -> None:
    """Fails where files exist, unless told to clear them."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def materialize_flood(features: DataFrame, labels: DataFrame, path: str) -> None:
    """Training layout: sim and split folders of features and labels."""
    keys = ["sim", "x_index", "y_index"]
    split = labels.select(*keys, "dataset").distinct()
    features.join(split, [k for k in keys if k in features.columns]).write.partitionBy("sim", "dataset").parquet(f"{path}/features")
    labels.write.partitionBy("sim", "dataset").parquet(f"{path}/labels")


def materialize_heat(dynamic: DataFrame, static: DataFrame, path: str) -> None:
    """Daily inputs by simulation and date, static layers once a simulation."""
    dynamic.write.partitionBy("sim", "date").parquet(f"{path}/dynamic")
    static.dropDuplicates(["sim", "row", "col", "var"]).write.partitionBy("sim").parquet(f"{path}/static")


def write_depth_csv(long: DataFrame, path: str) -> None:
    long.select("t", "x", "y", F.col("depth").alias("value")).write.partitionBy("t").option("header", True).csv(path)


def export_sim_inputs(elevation: DataFrame, headers: DataFrame, boundary: DataFrame, buildings: DataFrame, green: DataFrame, path: str, soil: DataFrame | None = None, excluded: tuple[int, ...] = ()) -> None:
    """City simulation inputs: elevation within the boundary, buildings and green areas cut to it, soil as green where present.

    A layer's cell comes once for each of its polygons; which parts of the boundary hold the cell is told by the table ``boundary`` (area, row, col,
    part), whose join with a layer is what ``geometry.intersect_cells`` gives. The pairs are not written out: where polygons lie upon one another
    their number grows with the square of the polygons.
    """
    from geofeat.operators import features, geometry, grid

    write_layer(geometry.polygon_cells(boundary, headers).select("area", "row", "col", F.col("ord").alias("part")), f"{path}/boundary")
    parts = boundary.sparkSession.read.schema("row int, col int, part long, area string").parquet(f"{path}/boundary")
    inside = parts.select("area", "row", "col").distinct()
    write_ascii_grid(grid.mask_outside(elevation, inside), headers, f"{path}/elevation")
    for name, layer in (("buildings", buildings), ("green_areas", green)):
        write_layer(geometry.polygon_cells(layer, headers).join(inside, ["area", "row", "col"], "left_semi"), f"{path}/{name}")
    if soil is not None:
        write_layer(features.soil_as_green(green, soil, headers, list(excluded)), f"{path}/spatial_green_areas")
