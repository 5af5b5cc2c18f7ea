"""Positions and quantiles of groups of any size: no group is sorted or counted in one task."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, ``spark.checkpoint.dir``; in local mode a local one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="geofeat-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage is cut, and its rows stay as they are whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, by: list[str], order: list[Column], pos: str = "pos") -> DataFrame:
    """The rows with their place (from 0) in the order within their group, by two levels of sums.

    Rows are cut into ranges of (group, order) and written; a place is the place within the range plus the group's rows in the ranges before. Ties get places
    in the order that the ranges hold them, which the written table fixes.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    cut = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    cut = written(cut, "ranges").withColumn("__part", F.shiftright("__at", 33))
    runs = cut.groupBy(*by, "__part").agg(F.min("__at").alias("__lo"), F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), (F.coalesce(before, F.lit(0)) - F.col("__lo")).alias("__shift"))
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return cut.join(runs, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(pos))


def numbered_by_hash(rows: DataFrame, by: list[str], key: Column, pos: str = "pos", n: str = "n") -> DataFrame:
    """The rows with their place (from 0) in the order of a hex digest within their group, and the group's size.

    The digest's first three digits make 4096 buckets in its own order: counts of buckets, sums over them, then places within a bucket.
    """
    keyed = rows.withColumns({"__key": key, "__bucket": F.substring(key, 1, 3)})
    counts = keyed.groupBy(*by, "__bucket").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "__bucket", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__m").over(Window.partitionBy(*by)).alias(n))
    inner = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__key")) - 1
    return keyed.join(counts, [*by, "__bucket"]).select(*rows.columns, (inner + F.col("__before")).alias(pos), n)


def first_rows(rows: DataFrame, by: str, order: list[str], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each group: the first k of each of ``salts`` shares of it, then the first k of those."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    for keys in (["__salt", by], [by]):
        rows = rows.withColumn("__salt", salt) if "__salt" in keys else rows
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__nth") <= k).drop("__nth")
    return rows.drop("__salt")


def exact_quantiles(df: DataFrame, by: list[str], points: tuple[float, ...], names: list[str], value: str = "v", bound: int = 10_000, bins: int = 256) -> DataFrame:
    """(by, names): exact quantiles of each group, interpolated as ``percentile`` does, by distributed selection.

    Every wanted rank begins with its group's whole range of values. A pass counts the values of each open range in ``bins`` equal bins (with
    the least and greatest value of each) and narrows the range to the bin that holds the rank. A range of one value is done; one of at most ``bound`` values is
    sorted. So no task sorts, or gathers, more than ``bound`` values of a group. Nulls and NaN don't count; a group of these alone gives nulls.
    """
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    keyed = rows.select(F.struct(F.lit(0).alias("all"), *by).alias("g"), "v")
    groups = df.select(F.struct(F.lit(0).alias("all"), *by).alias("g")).distinct()
    whole = keyed.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for k, q in enumerate(points)])
    asked = whole.select("g", "n", "lo", "hi", F.inline(ranks))
    asked = asked.select("g", "k", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), "lo", "hi")
    asked = written(asked, "ranks")
    settled = asked.filter(F.col("lo") == F.col("hi")).select("g", "k", "at", "rank", F.col("lo").alias("value"))
    while True:
        wide = asked.filter((F.col("lo") < F.col("hi")) & (F.col("m") > bound))
        if wide.isEmpty():
            break
        # Halves before the difference: a range may span more than the greatest double.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        at = F.least(F.floor(share * bins), F.lit(bins - 1))
        inside = keyed.join(wide, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        counts = inside.groupBy("g", "k", "at", "rank", "below", at.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        so_far = F.sum("m").over(Window.partitionBy("g", "k", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", F.col("below") + so_far)
        hit = counts.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
        narrowed = hit.select("g", "k", "at", "rank", (F.col("upto") - F.col("m")).alias("below"), "m", "lo", "hi")
        asked = written(narrowed.unionByName(asked.filter((F.col("lo") < F.col("hi")) & (F.col("m") <= bound))), "ranks")
        settled = settled.unionByName(asked.filter(F.col("lo") == F.col("hi")).select("g", "k", "at", "rank", F.col("lo").alias("value")))
    few = asked.filter(F.col("lo") < F.col("hi"))
    inside = keyed.join(few, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    place = F.row_number().over(Window.partitionBy("g", "k", "rank").orderBy("v")) - 1 + F.col("below")
    sorted_ = inside.withColumn("place", place).filter(F.col("place") == F.col("rank")).select("g", "k", "at", "rank", F.col("v").alias("value"))
    found = settled.unionByName(sorted_).groupBy("g", "k", "at").agg(F.min_by("value", "rank").alias("lower"), F.max_by("value", "rank").alias("upper"))
    between = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise((F.ceil("at") - F.col("at")) * F.col("lower") + (F.col("at") - F.floor("at")) * F.col("upper"))
    each = found.select("g", "k", between.alias("q")).groupBy("g").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(name) for k, name in enumerate(names)])
    return groups.join(each.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left").select(*[F.col(f"g.{c}").alias(c) for c in by], *names)
