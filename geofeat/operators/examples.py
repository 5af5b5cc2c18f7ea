"""Pairing, splitting, sampling and batching of examples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geofeat.functions import scalar
from geofeat.operators import ranks, windows

XY = ["x_index", "y_index"]


def _fail(rows: DataFrame, message: str, *columns: str) -> None:
    bad = rows.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: " + ", ".join(str(tuple(r[c] for c in columns)) for r in bad))


def pair_features_labels(features: DataFrame, labels: DataFrame, by: list[str] = XY, check: bool = True) -> DataFrame:
    """Labels with their features; a label without feature is an error that names its indices, a feature without label goes."""
    if check:
        _fail(labels.join(features, by, "left_anti"), "labels without features", *by)
    return features.join(labels, by)


def normal_name(c: Column) -> Column:
    return F.url_decode(c)


def temporal_metadata(sims: DataFrame, configs: DataFrame, check: bool = True) -> DataFrame:
    """Simulations with their rainfall configuration; quoted and unquoted names are the same."""
    a, b = sims.withColumn("key", normal_name(F.col("configuration"))), configs.withColumn("key", normal_name(F.col("name")))
    if check:
        _fail(a.join(b, "key", "left_anti"), "unknown configuration", "configuration")
    return a.join(b, "key").drop("key")


def chunk_metadata(sims: DataFrame, chunks: DataFrame, check: bool = True) -> DataFrame:
    """Simulations with the chunks of their study area; an area without chunks is an error."""
    a, b = sims.withColumn("key", normal_name(F.col("study_area"))), chunks.withColumn("key", normal_name(F.col("study_area"))).drop("study_area")
    if check:
        _fail(a.join(b.select("key").distinct(), "key", "left_anti"), "study area without chunks", "study_area")
    return all_pairs(a, b, "key").drop("key")


def all_pairs(a: DataFrame, b: DataFrame, key: str, tile: tuple[int, int] = (4096, 512), per_task: int = 1 << 24) -> DataFrame:
    """``a.join(b, key)`` for keys with many rows on both sides, in an order that columnar files hold in a fraction of a byte a row.

    A key's pairs are cut into tiles of about ``tile[0]`` rows of ``a`` by ``tile[1]`` of ``b``, dealt to as many tasks as the number of pairs asks for. In a
    tile each row of ``a`` stands with all rows of ``b`` in turn, so one side is long runs and the other a short cycle (of a multiple of eight rows but for a
    key's last tile, as files pack values by eights). A row is shuffled once for each tile that it meets.
    """
    hashed = lambda df: F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])  # noqa: E731  maps have no hash
    b = ranks.numbered(b, [key], [hashed(b)], "__b")
    n, m = (df.groupBy(key).agg(F.count("*").alias(c)) for df, c in ((a, "__n"), (b, "__m")))
    cut = n.join(m, key).select("*", *[F.ceil(F.col(c) / k).cast("int").alias(p) for c, k, p in (("__n", tile[0], "__rows"), ("__m", tile[1], "__cols"))])
    cut = ranks.written(cut, "pairs")
    sums = cut.agg(*[F.sum(v).cast("double") for v in (F.col("__n").cast("double") * F.col("__m"), F.col("__n") * F.col("__cols"), F.col("__m") * F.col("__rows"))]).head()
    pairs, *moved = [v or 0 for v in sums]
    few = per_task >> 4
    tasks = math.ceil(pairs / per_task + sum(moved) / few) or 1

    def dealt(df: DataFrame, row: Column, col: Column, copies: float) -> DataFrame:
        met = df.join(cut.select(key, "__rows", "__cols"), key)
        # What tasks copy to tiles hangs on the copies, not on the files that they read.
        met = met if copies <= few else met.repartition(math.ceil(copies / few), hashed(df))
        return met.withColumn("__row", row).withColumn("__col", col).drop("__rows", "__cols").repartition(tasks, key, "__row", "__col")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt(a, F.pmod(hashed(a), F.col("__rows")).cast("int"), every("__cols"), moved[0])
    right = dealt(b, every("__rows"), F.floor(F.col("__b") / tile[1]).cast("int"), moved[1]).drop("__b")
    # A broadcast would keep the order of files, in which keys are mixed.
    return left.join(right.hint("merge"), [key, "__row", "__col"]).drop("__row", "__col")


def prediction_inputs(chunks: DataFrame, rainfall: DataFrame) -> DataFrame:
    """Every chunk with every step of its rainfall: by ``config`` where both have it, else all of one configuration (at most 864 rows)."""
    return chunks.join(rainfall, "config") if "config" in chunks.columns and "config" in rainfall.columns else chunks.crossJoin(rainfall)


def common_chunks(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, "stem")


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def missing_and_extra(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Rows on one side only, with ``side`` missing or extra."""
    return expected.subtract(present).withColumn("side", F.lit("missing")).unionByName(present.subtract(expected).withColumn("side", F.lit("extra")))


def distinct_days(df: DataFrame) -> DataFrame:
    return df.select(F.to_date("ts").alias("date")).distinct()


def daily_examples(inputs: DataFrame, labels: DataFrame | None, by: list[str]) -> DataFrame:
    """Days (by, date, ..) with inputs and labels; without labels only inputs count."""
    return inputs if labels is None else inputs.join(labels, [*by, "date"])


def skipped_days(inputs: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, date) that lack inputs or labels."""
    keys = [*by, "date"]
    a, b = inputs.select(*keys).distinct().withColumn("i", F.lit(1)), labels.select(*keys).distinct().withColumn("l", F.lit(1))
    return a.join(b, keys, "full_outer").filter("i is null or l is null").select(*keys)


def attach_static(cells: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Static layers repeated at each step: one static row a cell, shuffled by the cell's key with the steps."""
    return cells.join(static, keys)


def attach_rainfall(cells: DataFrame, rainfall: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(rainfall, keys)


def sim_dates(sims: DataFrame, dates: DataFrame) -> DataFrame:
    return sims.crossJoin(dates)


def chunk_metadata_rows(predictions: DataFrame, chunks: DataFrame) -> DataFrame:
    return predictions.join(chunks, "chunk_id")


def flood_examples(labels: DataFrame, features: DataFrame, rainfall: DataFrame, sims: DataFrame, n: int, split: str | None = None) -> dict[str, DataFrame]:
    """Windowed flood examples: label windows (with the split's labels only), features by chunk, rainfall windows.

    Labels are (sim, x_index, y_index, dataset, t, row, col, v); features (study_area, x_index, y_index, row, col, ..).
    """
    chosen = labels if split is None else labels.filter(F.col("dataset") == split)
    known = temporal_metadata(sims, rainfall.select(F.col("config").alias("name")).distinct(), check=False)
    keyed = chosen.join(known.select("sim", "study_area", F.col("name").alias("config")), "sim")
    chunks = keyed.select("sim", "study_area", *XY).distinct()
    return {
        "spatiotemporal": windows.label_windows(keyed, n, ["sim", *XY, "row", "col"]),
        "geospatial": features.join(chunks, ["study_area", *XY]),
        "temporal": windows.rain_windows(rainfall, n),
    }


def heat_examples(met: DataFrame, wrf: DataFrame | None, by: list[str], lo: float, hi: float, k: int = 8) -> tuple[DataFrame, DataFrame | None]:
    """Days of the hash range with all six input steps, and the last k label steps of the same days."""
    x = scalar.filter_hash_range(windows.day_spatiotemporal(met, by), lo, hi)
    if wrf is None:
        return x, None
    y = windows.day_labels(wrf, by, k)
    both = x.select(*by, "date").distinct().intersect(y.select(*by, "date").distinct())
    return x.join(both, [*by, "date"], "left_semi"), y.join(both, [*by, "date"], "left_semi")


def order_timesteps(files: DataFrame) -> DataFrame:
    return files.withColumn("t", F.regexp_extract("name", r"(\d+)\.\w+$", 1).try_cast("int")).orderBy("t")


def shuffle(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """A repeatable order by hash: it hangs on the rows and the seed, not on partitions. Order keys first, then join payloads."""
    return df.withColumn("place", F.xxhash64(F.lit(seed), *keys)).orderBy("place", *keys).drop("place")


def limit_per_sim(df: DataFrame, k: int, order: list[str], by: str = "sim") -> DataFrame:
    return ranks.first_rows(df, by, order, k)


def take(df: DataFrame, k: int, skip: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(k)


def with_batch_id(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Batches of ``size`` within a simulation, the last one short; a simulation of any size is many tasks."""
    at = ranks.numbered(df, ["sim"], [F.col(c) for c in order], "__pos")
    return at.withColumn("batch_id", F.floor(F.col("__pos") / size).cast("long")).drop("__pos")


def shard(df: DataFrame, n: int, k: int, by: str = "sim") -> DataFrame:
    """All rows of every n-th simulation of the sorted list, from simulation k on. The list has one short row a simulation."""
    listed = df.select(by).distinct().withColumn("at", F.row_number().over(Window.orderBy(by)) - 1)
    return df.join(listed.filter(F.pmod("at", F.lit(n)) == k).select(by), by, "left_semi")


def stable_order(features: DataFrame, labels: DataFrame | None = None, key: str = "stem") -> DataFrame:
    """Examples in the order of their keys, whatever order the files were listed in; given labels, only keys that both have."""
    both = features if labels is None else features.join(labels.select(key).distinct(), key, "left_semi")
    return both.orderBy(key)


def dataset_split(chunks: DataFrame, mode: str = "hash") -> DataFrame:
    """Exact 60/20/20 per (study_area, config): cuts at int(0.6 N) and int(0.8 N) of a repeatable order of the chunks given.

    ``hash`` orders by sha256 of area, config and indices. ``compat`` is ``area_split``'s: its order is over the area's full grid, so the
    chunks need ``chunk_x_count`` and ``chunk_y_count``.
    """
    by = ["study_area", "config"]
    if mode == "compat":
        grids = chunks.select(*by, "chunk_x_count", "chunk_y_count").distinct()
        return chunks.select(*by, *XY).join(area_split(grids, mode), [*by, *XY])
    return _by_hash(chunks.select(*by, *XY), by)


def _by_hash(chunks: DataFrame, by: list[str]) -> DataFrame:
    key = F.sha2(F.concat_ws("|", *by, *[F.col(c).cast("string") for c in XY]), 256)
    ranked = ranks.numbered_by_hash(chunks, by, key, "at")
    name = F.when(F.col("at") < F.floor(F.col("n") * 0.6), "train").when(F.col("at") < F.floor(F.col("n") * 0.8), "val").otherwise("test")
    return ranked.select(*by, *XY, name.alias("dataset"))


def area_split(grids: DataFrame, mode: str = "hash") -> DataFrame:
    """(study_area, config, x_index, y_index, dataset) of every chunk of the full grids (study_area, config, chunk_x_count, chunk_y_count).

    ``compat`` follows the published split: Python's random generator, seeded with the SHA-1 hex digest of area and config, shuffles the
    x-major list of all chunks. A missing count is an error.
    """
    by = ["study_area", "config"]
    counted = grids
    for c in ("chunk_x_count", "chunk_y_count"):
        unset = F.raise_error(F.concat(F.lit(f"{c} must be set: "), F.col("study_area"))).cast("int")
        counted = counted.withColumn(c, F.when(F.col(c).isNull(), unset).otherwise(F.col(c).cast("int")))
    index = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    whole = counted.filter("chunk_x_count > 0 and chunk_y_count > 0")
    if mode != "compat":
        cells = whole.select(*by, F.explode(index("chunk_x_count")).alias("x_index"), "chunk_y_count")
        return _by_hash(cells.select(*by, "x_index", F.explode(index("chunk_y_count")).alias("y_index")), by)
    schema = "study_area string, config string, x_index int, y_index int, dataset string"

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield _shuffled_grid(*row)

    return whole.select(*by, "chunk_x_count", "chunk_y_count").mapInPandas(run, schema)


def _shuffled_grid(area: str, config: str, nx: int, ny: int):
    import hashlib
    import random

    import pandas as pd

    order = list(range(nx * ny))
    random.Random(hashlib.sha1((area + config).encode(), usedforsecurity=False).hexdigest()).shuffle(order)
    n = len(order)
    train, val = int(0.6 * n), int(0.8 * n)
    names = ["train"] * train + ["val"] * (val - train) + ["test"] * (n - val)
    return pd.DataFrame({"study_area": area, "config": config, "x_index": [k // ny for k in order], "y_index": [k % ny for k in order], "dataset": names})


def collapse_timesteps(df: DataFrame, by: list[str], n: int | Column, value: str = "v") -> DataFrame:
    """(by, steps, series): groups whose steps are exactly 0..n-1, values in order of the step; duplicates do no harm."""
    once = df.groupBy(*by, "t").agg(F.max(value).alias(value))
    n = F.lit(n) if isinstance(n, int) else n
    got = once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), value))).alias("all"))
    steps = F.transform("all", lambda x: x["t"])
    return got.filter(steps == F.sequence(F.lit(0), n - 1)).select(*by, F.size("all").alias("steps"), F.transform("all", lambda x: x[value]).alias("series"))


def depth_matrix_to_long(centers: DataFrame, matrix: DataFrame) -> DataFrame:
    """(x, y, t, depth) of cell centres (cell_id, x, y) and series (cell_id, depths); a length mismatch gives no rows."""
    sizes = centers.agg(F.count("*").alias("a")).crossJoin(matrix.agg(F.count("*").alias("b"))).filter("a = b").select(F.lit(1).alias("alike"))
    long = centers.join(matrix, "cell_id").select("x", "y", F.posexplode("depths").alias("t", "depth"))
    return long.crossJoin(F.broadcast(sizes)).drop("alike")
