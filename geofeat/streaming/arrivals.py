"""Arrival streams, late and repeated events, stateful collapse and the readiness gate."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geofeat.operators import catalog, grid

# Name patterns and their routes, first match counts.
ROUTES = [(r"/chunks/.*\.tar$", "elevation_chunk"), (r"/met_em\.[^/]*$", "weather_input"), (r"/wrfout[^/]*$", "weather_output"), (r"R\d+_C\d+_T\d+[^/]*\.rsl$", "depth"), (r"(^|/)Rainfall_Data_[^/]*$", "config")]


def route(name: Column) -> Column:
    out = F.lit("other")
    for pattern, kind in reversed(ROUTES):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """A stream of files with their route."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("event_time"), "content", route(F.col("path")).alias("route"))


#: The folder of unfinished uploads; give your store's own.
TEMPORARY = "tmp/uploads"


def drop_temporary(df: DataFrame, name: str = "name", prefix: str = TEMPORARY) -> DataFrame:
    """Without the parts of unfinished uploads."""
    return df.filter(~F.col(name).startswith(prefix))


def with_staleness(df: DataFrame, now: Column, seconds: int = 3600, time: str = "event_time") -> DataFrame:
    """``stale``: whether an event is older than the budget; one without a time is."""
    return df.withColumn("stale", F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(F.col(time)) > seconds, F.lit(True)))


def drop_stale(df: DataFrame, now: Column, seconds: int = 3600, time: str = "event_time") -> DataFrame:
    """Events within the budget; those without a time go too."""
    return with_staleness(df, now, seconds, time).filter("not stale").drop("stale")


def stale(df: DataFrame, now: Column, seconds: int = 3600, time: str = "event_time") -> DataFrame:
    """The record of what ``drop_stale`` leaves out."""
    return with_staleness(df, now, seconds, time).filter("stale").drop("stale")


def split_late(stream: DataFrame, good: str, dropped: str, checkpoint: str, now: Column | None = None, seconds: int = 3600, time: str = "event_time"):
    """A stream's events within the budget to the table ``good``, the others to the record ``dropped``; each batch in a folder of its own, so replays replace."""
    moment = F.current_timestamp() if now is None else now

    def write(batch: DataFrame, k: int) -> None:
        for path, rows in ((good, drop_stale(batch, moment, seconds, time)), (dropped, stale(batch, moment, seconds, time))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={k}")

    return each_batch(stream, write, checkpoint)


def skip_done(batch: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    return batch.join(chunks.filter("state is not null").select(*keys).distinct(), keys, "left_anti")


def split_errors(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``error``): the first failed check names the error."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = df.withColumn("error", error)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


# Fixed value: the state store that keeps map entries and timers one by one, on disk.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def map_state(spark: SparkSession):
    """Start ``collapse_stream`` and ``rescale_gate`` within it: their state needs a store of single entries, which a query takes as it starts."""
    old = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE[0], old) if old else spark.conf.unset(_STORE[0])


class _Forgetting(StatefulProcessor):
    """A processor whose keys are forgotten when the watermark is ``keep`` seconds past their latest row's time; never without ``time``."""

    time: str | None = None
    keep = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def touch(self, frames: list[pd.DataFrame], timers) -> None:
        if self.time is None:
            return
        latest = max((int(f[self.time].max().timestamp() * 1000) for f in frames if f[self.time].notna().any()), default=0)
        at = max(timers.getCurrentWatermarkInMs(), latest, 0) + self.keep * 1000
        if self.due.exists():
            old = self.due.get()[0]
            if old >= at:
                return
            self.handle.deleteTimer(old)
        self.due.update((at,))
        self.handle.registerTimer(at)

    def forget(self) -> None:
        self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _Collapse(_Forgetting):
    """Steps of a chunk as single map entries; a row comes out once, when the last one is in."""

    def __init__(self, steps: int, time: str | None, keep: int):
        self.steps, self.time, self.keep = steps, time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "t int", "there boolean")
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues):
        n = before = self.count.get()[0] if self.count.exists() else 0
        frames = list(rows)
        for pdf in frames:
            for t in pdf["t"].dropna().astype(int).unique().tolist():
                if n < self.steps and 0 <= t < self.steps and not self.seen.containsKey((t,)):
                    self.seen.updateValue((t,), (True,))
                    n += 1
        self.touch(frames, timerValues)
        if n != before:
            self.count.update((n,))
            if n == self.steps:
                self.seen.clear()  # the count alone says that the chunk is done
                yield pd.DataFrame({"sim": [key[0]], "x_index": [key[1]], "y_index": [key[2]], "steps": [n]})

    def forget(self) -> None:
        super().forget()
        self.seen.clear()
        self.count.clear()


def collapse_stream(stream: DataFrame, steps: int, time: str | None = None, delay: str = "1 hour", keep: int = 3600) -> DataFrame:
    """(sim, x_index, y_index, steps), once, when all steps 0..n-1 of a chunk have come; repeats do no harm.

    A step is one entry of the chunk's state, which goes when the chunk is done; only its count stays. With ``time``, an event-time column, that
    is freed, too: a chunk is forgotten when the watermark (``delay`` behind the latest event of all) is ``keep`` seconds past its own latest event.
    Without it, counts are kept for ever, which suits a bounded set of chunks only. Start it within ``map_state``.
    """
    columns = ["sim", "x_index", "y_index", "t"]
    held = stream.select(*columns) if time is None else stream.withWatermark(time, delay).select(*columns, time)
    keyed = held.groupBy("sim", "x_index", "y_index")
    mode = "None" if time is None else "EventTime"
    return keyed.transformWithStateInPandas(_Collapse(steps, time, keep), "sim string, x_index int, y_index int, steps int", "append", mode)


class _Gate(_Forgetting):
    """An area's chunks as single map entries and their number; the order to rescale them comes out once, when the last one is in."""

    def __init__(self, time: str | None, keep: int):
        self.time, self.keep = time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.chunks = handle.getMapState("chunks", "x_index int, y_index int", "lo double, hi double")
        self.state = handle.getValueState("state", "n long, fired boolean")

    def handleInputRows(self, key, rows, timerValues):
        n, fired = self.state.get() if self.state.exists() else (0, False)
        frames = list(rows)
        for pdf in frames:
            if fired:
                continue
            if pdf["expected"].isna().any():
                raise ValueError(f"area without chunk counts: {key[0]}")
            for x, y, lo, hi, expected in pdf[["x_index", "y_index", "elevation_min", "elevation_max", "expected"]].itertuples(index=False):
                n += not self.chunks.containsKey((int(x), int(y)))
                self.chunks.updateValue((int(x), int(y)), tuple(None if pd.isna(v) else float(v) for v in (lo, hi)))
                if n == expected:
                    fired = True
                    yield self.orders(key[0])
                    self.chunks.clear()
                    break
        self.state.update((n, fired))
        self.touch(frames, timerValues)

    def orders(self, area: str) -> pd.DataFrame:
        entries = list(self.chunks.iterator())
        lows, highs = ([v[k] for _, v in entries if v[k] is not None] for k in (0, 1))
        out = pd.DataFrame([k for k, _ in entries], columns=["x_index", "y_index"])
        return out.assign(area=area, elevation_min=min(lows, default=None), elevation_max=max(highs, default=None))[["area", "x_index", "y_index", "elevation_min", "elevation_max"]]

    def forget(self) -> None:
        super().forget()
        self.chunks.clear()
        self.state.clear()


def rescale_gate(stream: DataFrame, areas: DataFrame, time: str | None = None, delay: str = "1 hour", keep: int = 86400) -> DataFrame:
    """A rescale order (area, x_index, y_index, elevation_min, elevation_max) for every chunk of an area, once, when its last chunk has come.

    ``stream`` has a row a finished chunk (area, x_index, y_index, elevation_min, elevation_max), ``areas`` its number of chunks (area,
    ``expected``). Chunks that come again, and replays after a restart, fire nothing. An area without a number is an error; a chunk of an
    area that ``areas`` lacks is skipped. What is kept of an area that has fired is one flag; with ``time`` that is freed as in ``collapse_stream``.
    """
    columns = ["area", "x_index", "y_index", "elevation_min", "elevation_max"]
    held = stream if time is None else stream.withWatermark(time, delay)
    known = held.select(*columns, *([time] if time else [])).join(areas.select("area", F.col("expected").cast("double").alias("expected")), "area")
    out = "area string, x_index int, y_index int, elevation_min double, elevation_max double"
    return known.groupBy("area").transformWithStateInPandas(_Gate(time, keep), out, "append", "None" if time is None else "EventTime")


def elevation_stats_stream(stream: DataFrame) -> DataFrame:
    return grid.elevation_stats(stream, ["area"])


def rescale_when_ready(cells: DataFrame, chunks: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scaled cells, new chunk rows) of areas whose chunks are all in and not yet scaled."""
    state = catalog.area_state(chunks.join(areas.select("area", "expected"), "area"), ["area"])
    ready = state.filter(F.col("area_state") == catalog.STATES[2]).select("area")
    waiting = chunks.filter("needs_scaling").join(ready, "area", "left_semi")
    keys = ["area", "x_index", "y_index"]
    todo = cells.join(waiting.select(*keys), keys, "left_semi")
    scaled = grid.rescale_elevation(todo, grid.elevation_stats(cells, ["area"]))
    return scaled, catalog.scaling_done(chunks, waiting, keys)


#: Fixed value: the name of rainfall files, the only ones that make a configuration.
RAINFALL = r"(^|/)Rainfall_Data_[^/]*$"


def config_deletes(table: DataFrame, changes: DataFrame, key: str = "name", only: str | None = None) -> DataFrame:
    """The table without what change events delete; with ``only``, events of files with other names (column ``file``) do nothing."""
    gone = changes.filter("op = 'delete'")
    return catalog.delete_rows(table, (gone if only is None else gone.filter(F.col("file").rlike(only))).select(key))


def ingest_depth_stream(points: DataFrame, headers: DataFrame, size: int) -> DataFrame:
    """A batch of depth files (area, t, ord, x, y, depth) as chunked cells (area, t, x_index, y_index, row, col, depth).

    A file holds all points of one time step of an area and a batch holds whole files, so each step that the batch names comes out
    whole: cells without a point are dry. Write it with ``write_steps``, which replaces steps.
    """
    step = F.concat_ws("\x1f", "area", F.col("t").cast("string"))
    keys = points.select("area", "t").distinct()
    of = keys.join(headers, "area").select(step.alias("area"), *[c for c in headers.columns if c != "area"])
    cells = grid.rasterize_points(points.withColumn("area", step), of)
    out = grid.split_chunks(cells, of, size, 0.0, "depth")
    parts = F.split("area", "\x1f")
    kind = dict(points.dtypes)["t"]
    return out.select(parts[0].alias("area"), parts[1].cast(kind).alias("t"), *[c for c in out.columns if c != "area"])


def write_steps(cells: DataFrame, path: str) -> None:
    """Steps (area, t) as partitions that replace what was there: a replay or a later file of a step leaves one version of it."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area", "t").parquet(path)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``fn`` on all that has come, then stop; the batch number lets a sink drop replays."""
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
