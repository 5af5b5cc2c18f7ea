"""Dimension seeds: soil infiltration parameters and the weather variable catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODATA = -9999.0
RAIN_STEPS = 864

# Soil class, hydraulic conductivity, wetting front suction head, effective porosity, effective saturation.
SOIL = [
    (1, 1.09, 11.01, 0.412, 0.5),
    (2, 0.65, 16.68, 0.486, 0.5),
    (3, 0.1, 20.88, 0.309, 0.5),
    (4, 0.34, 8.89, 0.434, 0.5),
    (5, 2.99, 6.13, 0.401, 0.5),
    (6, 11.78, 4.95, 0.417, 0.5),
    (11, 1.09, 11.01, 0.412, 0.99),
    (12, 0.65, 16.68, 0.486, 0.99),
    (13, 0.1, 20.88, 0.309, 0.99),
    (14, 0.34, 8.89, 0.434, 0.99),
    (16, 11.78, 4.95, 0.417, 0.5),
]
SOIL_SCHEMA = "soil_class int, hydraulic_conductivity double, wetting_front_suction_head double, effective_porosity double, effective_saturation double"

# Variable, group, unit, scaling, smallest, largest; in model order within a group.
_DISTRIBUTION = [(f"HGT_DIST_{m}m", "spatial", "fraction", "none", None, None) for m in range(5, 80, 5)]
VARIABLES = [
    ("PRES", "spatiotemporal", "pascals", "global", 98000.0, 121590.0),
    ("GHT", "spatiotemporal", "meters", "global", 0.0, 6000.0),
    ("RH", "spatiotemporal", "percentage", "none", None, None),
    ("TT", "spatiotemporal", "kelvin", "global", 263.15, 333.15),
    ("WSPD", "spatiotemporal", "meters_per_sec", "global", 0.0, 100.0),
    ("ALBEDO12M", "spatiotemporal", "percentage", "none", None, None),
    ("GREENFRAC", "spatiotemporal", "fraction", "none", None, None),
    ("WDIR_SIN", "spatiotemporal", "none", "global", -1.0, 1.0),
    ("WDIR_COS", "spatiotemporal", "none", "global", -1.0, 1.0),
    ("LAI12M", "spatiotemporal", "fraction", "global", 0.0, 10.0),
    ("SOLAR_TIME_SIN", "spatiotemporal", "none", "global", -1.0, 1.0),
    ("SOLAR_TIME_COS", "spatiotemporal", "none", "global", -1.0, 1.0),
    ("HGT_M", "spatial", "meters", "global", 0.0, 5100.0),
    ("ST000010", "spatial", "kelvin", "global", 263.15, 333.15),
    ("SM000010", "spatial", "fraction", "none", None, None),
    *_DISTRIBUTION,
    ("AW_BUILD_HEIGHT", "spatial", "meters", "global", 0.0, 250.0),
    ("BUILDING_AREA_FRACTION", "spatial", "fraction", "none", None, None),
    ("FRC_URB2D", "spatial", "fraction", "none", None, None),
    ("BUILD_SURF_RATIO", "spatial", "fraction", "none", 0.0, 200.0),
    ("LU_INDEX", "lu_index", "none", "none", None, None),
]
# Ranges of the label variables.
LABEL_RANGES = {"RH2": (0.0, 100.0), "T2": (263.15, 333.15), "WSPD_WDIR10": (0.0, 100.0), "WSPD_WDIR10_SIN": (-1.0, 1.0), "WSPD_WDIR10_COS": (-1.0, 1.0)}


def soil_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOIL, SOIL_SCHEMA)


def variables(spark: SparkSession) -> DataFrame:
    rows = [(v, g, k, u, s, lo, hi) for k, (v, g, u, s, lo, hi) in enumerate(VARIABLES)]
    return spark.createDataFrame(rows, "var string, var_type string, ord int, unit string, scaling string, vmin double, vmax double")
