"""Text, JSON and binary scans. Text files are split by byte ranges, so that one of any size is many tasks; their lines are numbered across splits."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofeat.functions import scalar
from geofeat.operators import ranks
from geofeat.operators.examples import _fail

# The header keywords of grid files.
_HEAD = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def _whole(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _split(spark: SparkSession, paths, keep: Column | None, folders: bool = False) -> DataFrame:
    """(path, block, at, line): kept lines with the byte range that they begin in, and a number that grows with their place within it."""
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    block = F.struct(F.col("_metadata.file_name").alias("file") if folders else F.lit("").alias("file"), start.alias("start"))
    rows = spark.read.text(paths).select((F.regexp_extract(path, "^(.*)/[^/]*$", 1) if folders else path).alias("path"), block.alias("block"), F.col("value").alias("line"))
    rows = rows if keep is None else rows.filter(keep)
    return rows.withColumn("at", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, paths, keep: Column | None = None, folders: bool = False) -> DataFrame:
    """(path, n, line) of text files, n from 0 over the lines that ``keep`` (a condition on ``line``) takes, all by default.

    With ``folders`` the files of a folder, in the order of their names, are one text, and ``path`` is the folder.

    The lines of each byte range are counted in one pass; running sums over a file's ranges give each range its first number, and a line's number is
    that plus its place within the range. No file, and no range, goes to one task whole. Should the files be cut otherwise in the second pass (they
    changed, or the session's split size did), a line falls outside its range and the job fails; numbers are never silently wrong.
    """
    lines = _split(spark, paths, keep, folders)
    ranges = lines.groupBy("path", "block").agg(F.count("*").alias("m"), F.min("at").alias("lo"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row a byte range; written, so that its true size is known and lines are not shuffled to meet it.
    ranges = ranks.written(ranges.select("path", "block", "m", "lo", before.alias("base")), "ranges")
    both = lines.join(ranges, ["path", "block"], "left").withColumn("inner", F.col("at") - F.col("lo"))
    moved = F.raise_error(F.concat(F.lit("file was cut otherwise: "), F.col("path"))).cast("long")
    n = F.when(F.coalesce((F.col("inner") >= 0) & (F.col("inner") < F.col("m")), F.lit(False)), F.col("base") + F.col("inner")).otherwise(moved)
    return both.select("path", n.alias("n"), "line")


def read_ascii_grid(spark: SparkSession, paths, header_only: bool = False, nodata: float | None = None, folders: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(headers, cells); header keys in any case and order, nodata -9999 where absent. Nodata cells are null, or ``nodata`` if given.

    Blank lines don't count. Header lines are found by their keywords, the rows of cells by their number after them. With ``folders`` a grid is a
    folder of parts, as ``write_ascii_grid`` makes them.
    """
    head = rf"(?i)^\s*({'|'.join(_HEAD)})\s+(\S+)\s*$"
    text = _split(spark, paths, None, folders)
    keys = text.filter(F.col("line").rlike(head)).select("path", F.lower(F.regexp_extract("line", head, 1)).alias("k"), F.regexp_extract("line", head, 2).cast("double").alias("v"))
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    headers = keys.groupBy("path").agg(
        value("ncols").cast("int").alias("col_count"), value("nrows").cast("int").alias("row_count"), value("xllcorner").alias("x_ll"), value("yllcorner").alias("y_ll"),
        value("cellsize").alias("cell_size"), F.coalesce(value("nodata_value"), F.lit(-9999.0)).alias("nodata_value"), F.count("*").alias("n_head"),
    )
    if header_only:
        return headers.drop("n_head"), None
    lines = numbered_lines(spark, paths, F.trim("line") != "", folders).join(headers.select("path", "row_count", "nodata_value", "n_head"), "path")
    row = (F.col("n") - F.col("n_head")).cast("int")
    body = lines.filter((row >= 0) & (row < F.col("row_count"))).select("path", "nodata_value", row.alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "z"))
    z = F.col("z").cast("double")
    cells = body.select("path", "row", "col", F.when(z == F.col("nodata_value"), F.lit(nodata)).otherwise(z).alias("z"))
    return headers.drop("n_head"), cells


HEADER_JSON = "study_area string, col_count int, row_count int, x_ll_corner double, y_ll_corner double, cell_size double, nodata_value double, crs string"


def read_headers(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(HEADER_JSON).option("multiLine", True).json(paths)


def read_polygons(spark: SparkSession, paths) -> DataFrame:
    """(path, ord, mask, xs, ys): the first line counts the lines to read; an even number of values begins with the mask, else it is 1."""
    lines = numbered_lines(spark, paths)
    many = lines.filter("n = 0").select("path", F.trim("line").try_cast("int").alias("many"))
    rows = lines.join(many, "path").filter("n between 1 and many").select("path", (F.col("n") - 1).cast("int").alias("ord"), "line")
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    rows = rows.select("path", "ord", v.alias("v")).withColumn("base", (F.size("v") % 2 == 0).cast("int"))
    rows = rows.withColumn("n", F.element_at("v", F.col("base") + 1).cast("int"))
    mask = F.when(F.col("base") == 1, F.element_at("v", F.lit(1))).otherwise(F.lit(1.0)).cast("int")
    return rows.select("path", "ord", mask.alias("mask"), F.slice("v", F.col("base") + 2, F.col("n")).alias("xs"), F.slice("v", F.col("base") + 2 + F.col("n"), F.col("n")).alias("ys"))


def read_rainfall(spark: SparkSession, paths) -> DataFrame:
    """(config, t, amount): second numbers of lines that begin with two numbers."""
    line = r"^(\d+)\s+(-?\d*\.?\d+(?:[eE][-+]?\d+)?)"
    found = numbered_lines(spark, paths, F.col("line").rlike(line))
    return found.select(F.col("path").alias("config"), F.col("n").cast("int").alias("t"), F.regexp_extract("line", line, 2).cast("double").alias("amount"))


def read_kv(spark: SparkSession, paths) -> DataFrame:
    """(path, settings map): k = v or k: v, keys in lower case; comments and blanks are skipped, other lines are an error."""
    kept = F.filter(F.split("text", r"\r?\n"), lambda s: ~F.trim(s).rlike(r"^([#;].*)?$") & ~F.trim(s).rlike(r"^\[.*\]$"))
    pair = r"^\s*([^=:]+?)\s*[=:]\s*(.*?)\s*$"

    def entry(s):
        bad = F.raise_error(F.concat(F.lit("line without delimiter: "), s)).cast("string")
        return F.struct(F.when(s.rlike(pair), F.lower(F.regexp_extract(s, pair, 1))).otherwise(bad).alias("key"), F.regexp_extract(s, pair, 2).alias("value"))

    return _whole(spark, paths).select("path", F.map_from_entries(F.transform(kept, entry)).alias("settings"))


def read_depth_points(spark: SparkSession, paths) -> DataFrame:
    """(path, ord, x, y, depth) of whitespace tables, the header line aside; blank lines give no row but count for ``ord``."""
    rows = numbered_lines(spark, paths).filter("n > 0 and trim(line) <> ''")
    v = F.split(F.trim("line"), r"\s+")
    return rows.select("path", (F.col("n") - 1).alias("ord"), *[v[k].cast("float").alias(c) for k, c in enumerate(("x", "y", "depth"))])


def read_npy_cells(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(path, idx array<int>, value) of .npy arrays; without ``strict``, files that don't decode are left out."""
    return npy_cells(spark.read.format("binaryFile").option("ignoreMissingFiles", not strict).load(paths), strict)


def npy_cells(blobs: DataFrame, strict: bool = True) -> DataFrame:
    """The same of any table (path, content)."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    if strict:
                        raise
                    continue
                for k in range(0, a.size, 1 << 16):
                    at = np.stack(np.unravel_index(np.arange(k, min(k + (1 << 16), a.size)), a.shape), 1).astype("int32")
                    yield pd.DataFrame({"path": path, "idx": list(at), "value": a.ravel()[k : k + (1 << 16)].astype("float64")})

    return blobs.select("path", "content").mapInPandas(run, "path string, idx array<int>, value double")


# The member names of a bundle.
MEMBERS = ("elevation", "boundaries", "buildings", "green_areas", "soil_classes")


def read_bundle(spark: SparkSession, paths) -> DataFrame:
    """(path, member, layer, content) of tar archives; layer is null for unexpected names."""
    return bundle_members(spark.read.format("binaryFile").load(paths))


def bundle_members(blobs: DataFrame) -> DataFrame:
    """The same of any table (path, content)."""

    def run(frames):
        import tarfile

        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            stem = m.name.rsplit("/", 1)[-1].split(".")[0]
                            yield pd.DataFrame({"path": [path], "member": [m.name], "layer": [stem if stem in MEMBERS else None], "content": [tar.extractfile(m).read()]})

    return blobs.select("path", "content").mapInPandas(run, "path string, member string, layer string, content binary")


def read_met(spark: SparkSession, path: str) -> DataFrame:
    met = spark.read.parquet(path)
    return met.withColumn("ts", scalar.parse_ts(F.col("Times"))).drop("Times") if "Times" in met.columns else met


def met_cells(met: DataFrame, variables: list[str], dims: tuple[str, ...] = ("south_north", "west_east")) -> DataFrame:
    """A snapshot's arrays as cells: the other columns, a column a dimension (the place in it, from 0), and a column a variable.

    Each row holds one moment, each variable an array nested as deep as ``dims``. A null array, or part of one, gives no cells; variables of
    other extents are null where they end.
    """
    other = [c for c in met.columns if c not in variables]
    now = met.select(*other, F.arrays_zip(*variables).alias("cells"))
    for k, dim in enumerate(dims):
        now = now.select(*other, *dims[:k], F.posexplode("cells").alias(dim, "cells"))
        if k + 1 < len(dims):
            now = now.withColumn("cells", F.arrays_zip(*[F.col(f"cells.{v}").alias(v) for v in variables]))
    return now.select(*other, *dims, *[F.col(f"cells.{v}").alias(v) for v in variables])


def with_path_metadata(df: DataFrame, kind: str, name: str = "name") -> DataFrame:
    """Columns that names carry: ``timestep``, ``chunk`` or ``path``."""
    return df.withColumns({"timestep": scalar.timestep_parts, "chunk": scalar.chunk_parts, "path": scalar.path_parts}[kind](F.col(name)))


def list_sim_days(files: DataFrame, sims: DataFrame | None = None) -> DataFrame:
    """(sim, date) of names sim/../yyyy-mm-dd..; others are skipped. A named simulation without a day is an error."""
    date = F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1)
    days = files.select(F.element_at(F.split("name", "/"), 1).alias("sim"), F.when(date != "", date).try_cast("date").alias("date")).filter("date is not null").distinct()
    if sims is not None:
        _fail(sims.join(days, "sim", "left_anti"), "simulation without days", "sim")
    return days


def list_prefix(df: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    return df.filter(F.col(name).startswith(prefix))
