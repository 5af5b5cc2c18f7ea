"""Weather cells (sim, ts, sn, we, ...) to feature groups and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofeat.functions import scalar
from geofeat.functions.seeds import LABEL_RANGES


def wind_components(met: DataFrame) -> DataFrame:
    """UU at cell sides and VV at cell ends are averaged to centres; the last line of each, which has no neighbour, goes."""
    if not {"UU", "VV"} <= set(met.columns):
        return met
    along_we = Window.partitionBy("sim", "ts", "sn").orderBy("we")
    along_sn = Window.partitionBy("sim", "ts", "we").orderBy("sn")
    u = (F.col("UU") + F.lead("UU").over(along_we)) / 2
    v = (F.col("VV") + F.lead("VV").over(along_sn)) / 2
    centred = met.withColumn("u", u).withColumn("v", v).filter("u is not null and v is not null")
    return centred.withColumns(scalar.wind(F.col("u"), F.col("v"))).drop("u", "v")


def with_solar_time(met: DataFrame) -> DataFrame:
    return met.withColumns(scalar.solar_time(F.col("ts"), F.col("lon")))


def select_slices(met: DataFrame, level: int = 0) -> DataFrame:
    """One level, and of monthly variables the snapshot's month (from 0); the level filter reaches the scan."""
    return met.filter((F.col("level") == level) & (F.col("month") == F.month("ts") - 1))


def scale_variables(values: DataFrame, variables: DataFrame) -> DataFrame:
    """(.., var, value): percent to fraction, then the clipped scale where the variable is scaled over its global range."""
    joined = values.join(F.broadcast(variables.select("var", "unit", "scaling", "vmin", "vmax")), "var")
    v = scalar.to_fraction(F.col("value"), F.col("unit"))
    return joined.withColumn("value", F.when(F.col("scaling") == "global", scalar.minmax(v, F.col("vmin"), F.col("vmax"))).otherwise(v)).drop("unit", "scaling", "vmin", "vmax")


def build_heat_features(met: DataFrame, variables: DataFrame) -> dict[str, DataFrame]:
    """Long cells (sim, ts, we, sn, var, ord, value) of the three groups, scaled, in the order of the catalogue."""
    whole = with_solar_time(wind_components(select_slices(met)))
    names = [r["var"] for r in variables.select("var").collect() if r["var"] in whole.columns]
    long = whole.unpivot(["sim", "ts", "we", "sn"], [F.col(n).cast("double").alias(n) for n in names], "var", "value")
    scaled = scale_variables(long, variables).join(F.broadcast(variables.select("var", "var_type", "ord")), "var")
    return {g: scaled.filter(F.col("var_type") == g).drop("var_type") for g in ("spatiotemporal", "spatial", "lu_index")}


def build_heat_labels(wrf: DataFrame) -> DataFrame:
    """RH2, T2, wind speed and the sine and cosine of its direction, by name."""
    return wrf.withColumns(scalar.wind_label(F.col("wdir"))).select("sim", "ts", "we", "sn", F.col("rh2").alias("RH2"), F.col("t2").alias("T2"), F.col("wspd").alias("WSPD_WDIR10"), "WSPD_WDIR10_SIN", "WSPD_WDIR10_COS")


def preprocess_labels(labels: DataFrame, names: list[str], height: int, width: int, rows: int, cols: int) -> DataFrame:
    """Chosen label variables, each scaled over its range, cut to the middle of the grid."""
    from geofeat.operators.grid import center_crop

    scaled = labels.select("sim", "ts", F.col("sn").alias("row"), F.col("we").alias("col"), *[scalar.minmax(F.col(n), *LABEL_RANGES[n]).alias(n) for n in names])
    return center_crop(scaled, height, width, rows, cols)
