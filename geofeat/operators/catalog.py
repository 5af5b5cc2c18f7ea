"""The metadata catalogue: every change gives a new table, which its owner commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofeat.operators.changelog import ChangeLog
from geofeat.operators.examples import _fail, area_split

STATES = ("init", "chunks-uploaded", "feature-matrices-created", "rescaling-done")
CHUNK_STATES = ("processing", "ready")
SPLITS = ("train", "val", "test")


class Catalog:
    """Tables under a root folder, each a log of commits: a table switches to its new content at once, and a crash leaves the old one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, name: str, keys: list[str]) -> ChangeLog:
        return ChangeLog(self.spark, f"{self.root}/{name}", keys)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows as of a version, the newest by default."""
        return self.log(name, []).contents(version)

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite", read: int | None = None) -> int:
        """The whole table anew, or with ``append`` more rows; the new version. With ``read``, the version that the rows were made from, a conflict is an error."""
        log = self.log(name, [])
        return log.commit(rows, log.version() if read is None else read, {"overwrite": "snapshot", "append": "append"}[mode])

    def assert_exists(self, name: str, keys: DataFrame) -> None:
        _fail(keys.join(self.table(name), keys.columns, "left_anti"), f"not in {name}", *keys.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """``replace`` sets rows whole, otherwise rows that exist stay. Absent columns become null."""
    old, new = (rows, table) if not replace else (table, rows)
    kept = old.join(new.select(*keys), keys, "left_anti")
    return new.unionByName(kept, allowMissingColumns=True).select(*table.columns)


def merge_fields(table: DataFrame, rows: DataFrame, keys: list[str], clear: tuple[str, ...] = ()) -> DataFrame:
    """Only non-null fields overwrite; the named columns of touched rows are cleared."""
    fields = [c for c in table.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("touched"))
    both = table.join(new, keys, "full_outer")
    out = []
    for c in fields:
        value = F.coalesce(F.col(f"new_{c}"), F.col(c)) if f"new_{c}" in new.columns else F.col(c)
        out.append((F.when(F.col("touched"), F.col(f"new_{c}") if f"new_{c}" in new.columns else F.lit(None)).otherwise(F.col(c)) if c in clear else value).alias(c))
    return both.select(*keys, *out)


def delete_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.distinct(), keys.columns, "left_anti")


def set_state(table: DataFrame, keys: DataFrame, state: str, allowed: tuple[str, ...] = STATES + CHUNK_STATES) -> DataFrame:
    """An update: a key that the table lacks is an error, raised when the rows are computed."""
    if state not in allowed:
        raise ValueError(f"unknown state {state}")
    there = table.withColumn("__there", F.lit(True))
    both = there.join(keys.distinct().withColumn("__set", F.lit(True)), keys.columns, "full_outer")
    absent = F.raise_error(F.concat(F.lit("no such row: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in keys.columns]))).cast("string")
    new = F.when(F.col("__there").isNull(), absent).when(F.col("__set"), F.lit(state)).otherwise(F.col("state"))
    return both.select(*[new.alias(c) if c == "state" else F.col(c) for c in table.columns])


def scaling_done(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """State ready, no scaling needed, the new path, errors cleared."""
    rows = done.select(*keys, "feature_matrix_path").withColumn("state", F.lit("ready")).withColumn("needs_scaling", F.lit(False))
    return merge_fields(chunks, rows, keys, ("error",))


def area_state(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Rows (.., expected, has_features, state): how far an area has come."""
    n = F.count("*")
    done = chunks.groupBy(*by).agg(F.max("expected").alias("e"), n.alias("n"), F.count_if(F.col("has_features")).alias("f"), F.bool_and(F.col("state") == "ready").alias("ready"))
    full = F.col("n") == F.col("e")
    ladder = F.when(full & F.col("ready"), STATES[3]).when(full & (F.col("f") == F.col("e")), STATES[2]).when(full, STATES[1]).otherwise(STATES[0])
    return done.select(*by, ladder.alias("area_state"))


def register_configs(rainfall: DataFrame, parents: DataFrame) -> DataFrame:
    """Flood configuration rows from rainfall steps (config, t, amount): name, parent, duration."""
    return rainfall.groupBy(F.col("config").alias("name")).agg(F.count("*").cast("int").alias("rainfall_duration")).join(parents, "name", "left")


def register_areas(headers: DataFrame, chunk_size: int) -> DataFrame:
    return headers.select("*", F.lit(STATES[0]).alias("state"), F.lit(chunk_size).alias("chunk_size"), F.ceil(F.col("col_count") / chunk_size).cast("int").alias("chunk_x_count"), F.ceil(F.col("row_count") / chunk_size).cast("int").alias("chunk_y_count"))


def reset_chunks(chunks: DataFrame, areas: DataFrame, key: str = "study_area") -> DataFrame:
    """The chunk table without the chunks of areas that are registered (again): their chunks start anew."""
    return delete_rows(chunks, areas.select(F.col("area").alias(key)))


def _of_parents(rows: DataFrame, areas: DataFrame, configs: DataFrame) -> DataFrame:
    """The rows, in which an unknown study area or configuration is an error that is raised when they are computed."""
    known = lambda parents, key: parents.select(F.col("name").alias(key)).distinct().withColumn(f"__{key}", F.lit(True))
    for parents, key in ((areas, "study_area"), (configs, "configuration")):
        missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key), F.lit("null")))).cast("string")
        rows = rows.join(known(parents, key), key, "left").withColumn(key, F.when(F.col(f"__{key}"), F.col(key)).otherwise(missing)).drop(f"__{key}")
    return rows


def insert_simulation(sims: DataFrame, rows: DataFrame, areas: DataFrame, configs: DataFrame, key: str = "path") -> DataFrame:
    """Simulations by their storage path; parents must exist."""
    return upsert(sims, _of_parents(rows, areas, configs), [key])


def register_label_chunks(table: DataFrame, rows: DataFrame, areas: DataFrame, configs: DataFrame, mode: str = "hash") -> DataFrame:
    """The label-chunk table with new rows (study_area, configuration, and x_index, y_index for spatial chunks or time for temporal ones; path).

    Parents must exist. Spatial chunks get their split: of all chunks of the area (``chunk_x_count`` x ``chunk_y_count`` in ``areas``),
    not of those present, so that it never changes as chunks arrive.
    """
    rows = _of_parents(rows, areas, configs)
    by = ["study_area", "configuration"]
    if "time" in rows.columns:
        return upsert(table, rows, [*by, "time"])
    pairs = rows.select(*by).distinct().join(areas.select(F.col("name").alias("study_area"), "chunk_x_count", "chunk_y_count"), "study_area")
    split = area_split(pairs.withColumnRenamed("configuration", "config"), mode).withColumnRenamed("config", "configuration")
    return upsert(table, rows.join(split, [*by, "x_index", "y_index"], "left"), [*by, "x_index", "y_index"])


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows without parent: the foreign-key check as a result."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def register_runs(predictions: DataFrame) -> DataFrame:
    """One row a run: its chunks in order."""
    return predictions.groupBy("run", "model").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list("chunk_id")).alias("chunks"))


run_metadata = register_runs


def simulation_inventory(sims: DataFrame, labels: DataFrame) -> DataFrame:
    """Simulations with labelled chunks and their number."""
    return sims.join(labels, "sim").groupBy("sim").agg(F.count("*").alias("n_chunks"))


def register_weather(corner: DataFrame, size: int = 200) -> DataFrame:
    """Weather study areas (area, x_ll, y_ll, cell_size): a fixed grid of size x size cells."""
    return corner.select("area", F.lit(size).alias("col_count"), F.lit(size).alias("row_count"), "x_ll", "y_ll", "cell_size", F.lit(STATES[0]).alias("state"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
