"""Views that derive rasters, polygons and time series from the supplied star schema; one text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_cells": """SELECT l_returnflag AS area, CAST(l_orderkey % 64 AS int) AS r, CAST(l_partkey % 64 AS int) AS c,
        max(CASE WHEN l_discount > 0.01 THEN l_extendedprice END) AS z FROM {lineitem} GROUP BY 1, 2, 3""",
    "v_points": """SELECT l_returnflag AS area, l_suppkey % 60 + l_discount * 3 AS x, l_linenumber * 8 + l_tax * 5 AS y, l_quantity AS depth,
        l_orderkey * 10 + l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3, l_extendedprice AS o4 FROM {lineitem}""",
    "v_rects": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'A' WHEN s_suppkey % 3 = 1 THEN 'N' ELSE 'R' END AS area,
        (s_suppkey * 7) % 56 + 0.25e0 AS x0, (s_suppkey * 13) % 56 + 0.25e0 AS y0, (s_suppkey * 7) % 56 + 0.25e0 + 1 + s_suppkey % 6 AS x1,
        (s_suppkey * 13) % 56 + 0.25e0 + 1 + s_nationkey % 5 AS y1, CAST(s_nationkey + 1 AS int) AS mask, s_suppkey AS ord FROM {supplier}""",
    "v_series": """SELECT CAST(dayofmonth(ts) - 1 AS int) AS t, CAST(user_id % 32 AS int) AS cell, avg(value) AS v FROM {events} GROUP BY 1, 2""",
    "v_pred": """SELECT CAST(dayofmonth(ts) - 1 AS int) AS t, CAST(user_id % 8 AS int) AS r, CAST(user_id % 4 AS int) AS c, event_type AS example,
        avg(value) AS label, avg(value) * 1.01e0 + 0.1e0 * (dayofmonth(ts) % 4) AS prediction FROM {events} GROUP BY 1, 2, 3, 4, dayofmonth(ts)""",
    "v_met": """SELECT event_id, event_type AS sim, ts, value AS uu, CAST(event_id % 97 - 48 AS double) AS vv, CAST(user_id - 75 AS double) AS lon FROM {events}""",
    "v_hours": """SELECT event_type AS sim, date_trunc('day', ts) AS day0, CAST(hour(ts) AS int) AS h, avg(value) AS v FROM {events} GROUP BY 1, 2, 3""",
    "v_feature_chunks": """SELECT DISTINCT CAST(c_custkey % 40 AS int) AS x_index, CAST(c_nationkey AS int) AS y_index FROM {customer}""",
    "v_label_chunks": """SELECT CAST(o_custkey % 40 AS int) AS x_index, CAST(o_custkey % 25 AS int) AS y_index, o_orderpriority AS sim, max(o_totalprice) AS v FROM {orders} GROUP BY 1, 2, 3""",
    "v_manifest": """SELECT CONCAT('area', CAST(o_custkey % 50 AS varchar(9))) AS area, CAST(o_orderkey % 20 AS int) AS chunk, o_orderkey AS version,
        o_orderstatus AS state, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS path, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' END AS error FROM {orders}""",
    "v_names": """SELECT o_orderkey AS id, CONCAT('city', CAST(o_custkey % 9 AS varchar(9)), '/cfg', CAST(o_orderkey % 4 AS varchar(9)), '/rain/R', CAST(o_orderkey % 7 AS varchar(9)), '_C', CAST(o_custkey % 5 AS varchar(9)), '_T', CAST(o_orderkey % 11 AS varchar(9)), '.rsl') AS name, CAST(o_orderdate AS date) AS day FROM {orders}""",
    "v_rain": """SELECT event_type AS config, CAST(event_id % 50 AS int) AS t, max(value) AS amount FROM {events} GROUP BY 1, 2""",
    "v_soil": """SELECT l_returnflag AS area, CAST(l_orderkey % 64 AS int) AS r, CAST(l_partkey % 64 AS int) AS c, CAST(max(l_suppkey) % 18 AS int) AS soil FROM {lineitem} GROUP BY 1, 2, 3""",
    "v_runs": """SELECT o_orderpriority AS run, o_orderstatus AS model, CAST(o_custkey AS int) AS chunk_id, o_totalprice AS v FROM {orders}""",
}
_AREAS = ("A", "N", "R")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})


def headers(spark: SparkSession, n: int = 64) -> DataFrame:
    return spark.createDataFrame([(a, n, n, 0.0, 0.0, 1.0) for a in _AREAS], "area string, col_count int, row_count int, x_ll double, y_ll double, cell_size double")


def duck(sql: str) -> str:
    """A DuckDB query with the views it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in used]
    if re.search(r"\bv_grid\b", sql):
        parts.append("v_grid AS (SELECT a.area, r.r::int AS r, c.c::int AS c FROM (VALUES ('A'), ('N'), ('R')) a(area), range(64) r(r), range(64) c(c))")
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
