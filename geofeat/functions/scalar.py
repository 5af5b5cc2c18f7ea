"""Column functions on cells, boxes, weather values and names. Everything here stays a built-in expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_to_xy(row: Column, col: Column, x_ll: Column, y_ll: Column, rows: Column, cell: Column) -> tuple[Column, Column]:
    """Upper left corner of a cell; row 0 is the northern row."""
    return x_ll + cell * col, y_ll + rows * cell - cell * row


def xy_to_cell(x: Column, y: Column, x_ll: Column, y_ll: Column, rows: Column, cell: Column) -> tuple[Column, Column]:
    """(row, col), halves to the even neighbour."""
    return F.rint((y_ll + rows * cell - y) / cell).cast("int"), F.rint((x - x_ll) / cell).cast("int")


def bbox_intersects(a: tuple, b: tuple) -> Column:
    """Closed boxes (x0, y0, x1, y1)."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def bbox_contains(a: tuple, b: tuple) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def normalize_nodata(df: DataFrame, nodata: float, to: float | None = None, column: str = "z") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == nodata, F.lit(to)).otherwise(F.col(column)))


def to_fraction(v: Column, unit: Column) -> Column:
    return F.when(unit == "percentage", v / 100).otherwise(v)


def minmax(v: Column, lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return (F.least(F.greatest(v, lo), hi) - lo) / (hi - lo)


def unscale(v: Column, lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return v * (hi - lo) + lo


def wind(u: Column, v: Column) -> dict[str, Column]:
    """Speed, direction (degrees the wind comes from), and its sine and cosine."""
    direction = F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))
    return {"WSPD": F.sqrt(u * u + v * v), "WDIR": direction, "WDIR_SIN": F.sin(F.radians(direction)), "WDIR_COS": F.cos(F.radians(direction))}


def solar_time(ts: Column, lon: Column) -> dict[str, Column]:
    """Local solar hours of a UTC time, and their sine and cosine over the day."""
    hours = F.pmod(F.hour(ts) + F.minute(ts) / 60.0 + lon / 15.0, F.lit(24.0))
    angle = hours * (2 * math.pi / 24)
    return {"SOLAR_TIME": hours, "SOLAR_TIME_SIN": F.sin(angle), "SOLAR_TIME_COS": F.cos(angle)}


def wind_label(degrees: Column) -> dict[str, Column]:
    return {"WSPD_WDIR10_SIN": F.sin(F.radians(degrees)), "WSPD_WDIR10_COS": F.cos(F.radians(degrees))}


def parse_ts(c: Column) -> Column:
    return F.to_timestamp(c, "yyyy-MM-dd_HH:mm:ss")


def hash_day(sim: Column, date: Column) -> Column:
    """sha256 of name and ISO date, as a number modulo 10**8, over 10**8."""
    digits = F.split(F.sha2(F.concat(sim, date), 256), "")
    value = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("long"), F.lit(100_000_000).cast("long")))
    return value / 1e8


def filter_hash_range(df: DataFrame, lo: float, hi: float, sim: str = "sim", date: str = "date") -> DataFrame:
    h = hash_day(F.col(sim), F.col(date).cast("string"))
    return df.filter((h >= lo) & (h < hi))


def remap_soil(df: DataFrame, classes: list[int], column: str = "mask", to: int = -9999) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(classes), to).otherwise(F.col(column)))


def validate_masks(df: DataFrame, column: str = "mask") -> DataFrame:
    """The property must be an integer; rows with 0 are dropped."""
    value = F.col(column).try_cast("int")
    wrong = F.raise_error(F.concat(F.lit("mask is no integer: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return df.withColumn(column, F.when(value.isNull(), wrong).otherwise(value)).filter(F.col(column) != 0)


def binarize(v: Column, threshold: float) -> Column:
    return (v > threshold).cast("int")


def sim_name(city: Column, config: Column, number: Column) -> Column:
    return F.concat(city, F.lit("-"), config, F.lit("/"), number)


def study_area_of(sim: Column) -> Column:
    return F.element_at(F.split(sim, "-"), 1)


def timestep_parts(name: Column) -> dict[str, Column]:
    """Rows, columns and step of names like R3_C4_T15."""
    return {k: F.regexp_extract(name, rf"{p}(\d+)", 1).try_cast("int") for k, p in (("r", "R"), ("c", "C"), ("t", "T"))}


def chunk_parts(name: Column) -> dict[str, Column]:
    """Indices of chunk names x_y, a path and a suffix aside."""
    return {"x_index": F.regexp_extract(name, r"(?:^|/)(\d+)_(\d+)(?:\.\w+)?$", 1).try_cast("int"), "y_index": F.regexp_extract(name, r"(?:^|/)(\d+)_(\d+)(?:\.\w+)?$", 2).try_cast("int")}


def path_parts(name: Column) -> dict[str, Column]:
    """Study area (first part), configuration (middle parts) and file (last part)."""
    parts = F.split(name, "/")
    return {"study_area": parts[0], "config": F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/"), "file": F.element_at(parts, -1)}


def document_id(name: Column) -> Column:
    """A name fit for a document id: slashes and dots become dashes."""
    return F.regexp_replace(name, "[/.]", "-")
