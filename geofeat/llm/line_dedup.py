"""Line dedup by distinct-site spread. DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites it stands on; sketches are made map-side and merged by aggregation. Lines whose
estimate lies near the threshold get an exact distinct count; the others are decided by the estimate, which at this sketch size errs by
far less than the band. Lines on ``min_sites`` sites or more are boilerplate and leave every text.

Defined results. A line is compared trimmed; shorter ones than ``min_chars`` are kept. Null text: stays null, no lines. Null site: counts
as one site of its own. Null doc_id and repeated rows: each row cleaned alike, since the decision hangs on the text alone.
Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import materialize, require


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("k"))


def boilerplate_lines(docs: DataFrame, site: str, min_sites: int, min_chars: int, lg_k: int = 12, band: float = 0.3) -> DataFrame:
    """(h, k): keys of lines on at least ``min_sites`` distinct sites."""
    trimmed = F.trim(F.col("line"))
    lines = docs.select(F.coalesce(F.xxhash64(site), F.lit(0)).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter(F.length(trimmed) >= min_chars).select("site", F.xxhash64(trimmed).alias("h"), F.hash(trimmed).alias("k"))
    # A line met fewer times than the threshold cannot be on so many sites; the count is summed map-side beside the sketch.
    spread = lines.groupBy("h", "k").agg(F.count("*").alias("rows"), F.hll_sketch_agg("site", lg_k).alias("sketch")).filter(F.col("rows") >= min_sites)
    spread = materialize(spread.select("h", "k", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    low, high = min_sites * (1 - band), min_sites * (1 + band) + 1
    near = spread.filter((F.col("sites") > low) & (F.col("sites") < high)).select("h", "k")
    exact = lines.join(near, ["h", "k"]).groupBy("h", "k", "site").agg(F.lit(1).alias("one")).groupBy("h", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return spread.filter(F.col("sites") >= high).select("h", "k").union(exact.select("h", "k"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = 5, min_chars: int = 16) -> DataFrame:
    """Per document: doc_id, source (the site), text without boilerplate lines, n_lines, n_removed."""
    docs = require(docs, "doc_id", site, "text")
    common = materialize(boilerplate_lines(docs, site, min_sites, min_chars), "line-common")
    trimmed = F.trim(F.col("line"))
    # Which lines go is a function of the text, so texts are named by hash and not by an id that may be null or repeated.
    name = F.struct(F.xxhash64("text").alias("t"), F.hash("text").alias("u"))
    lines = docs.select(name.alias("name"), F.explode(F.split("text", "\n")).alias("line")).filter(F.length(trimmed) >= min_chars)
    lines = lines.select("name.t", "name.u", F.xxhash64(trimmed).alias("h"), F.hash(trimmed).alias("k"))
    hits = lines.join(common, ["h", "k"]).select("t", "u", "h", "k").distinct()
    gone = hits.groupBy("t", "u").agg(F.collect_list(F.struct("h", "k")).alias("gone"))
    marked = docs.withColumn("t", F.xxhash64("text")).withColumn("u", F.hash("text")).join(gone, ["t", "u"], "left")
    parts = F.split("text", "\n")
    stays = F.filter(parts, lambda x: (F.length(F.trim(x)) < min_chars) | ~F.array_contains(F.col("gone"), _key(F.trim(x))))
    kept = F.when(F.col("gone").isNull(), parts).otherwise(stays)
    n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    count = F.when(F.col("text").isNull(), F.lit(0).cast("long"))
    return marked.select(
        "doc_id",
        site,
        F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text"),
        count.otherwise(n(parts)).alias("n_lines"),
        count.otherwise(n(parts) - n(kept)).alias("n_removed"),
    )


#: The same with exact distinct counts throughout, for DuckDB.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
  FROM documents),
common AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE length(trim(line, ' ')) >= 16
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, '?null')) >= 5),
marked AS (SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON trim(l.line, ' ') = c.line)
SELECT doc_id, source,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
FROM marked GROUP BY doc_id, source
"""
