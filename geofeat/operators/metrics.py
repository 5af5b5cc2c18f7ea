"""Error metrics on long cells (prediction, label) by any grouping."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofeat.operators import ranks


def _p() -> Column:
    return F.col("prediction")


def _l() -> Column:
    return F.col("label")


def spatial_mae(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(_p() - _l())).alias("mae"))


temporal_mae = spatial_mae


def temporal_rmse(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(_p() - _l(), 2))).alias("rmse"))


def spatial_nse(df: DataFrame, by: list[str], example: str = "example", eps: float = 1e-9) -> DataFrame:
    """1 - squared error over squared deviation of the labels from their mean, per example; then the mean over examples."""
    one = df.groupBy(example, *by).agg(F.sum(F.pow(_l() - _p(), 2)).alias("e"), (F.var_pop(_l()) * F.count(_l())).alias("d"))
    return one.select(*by, (1 - F.col("e") / (F.col("d") + eps)).alias("nse")).groupBy(*by).agg(F.avg("nse").alias("nse"))


def max_depth(df: DataFrame, by: list[str], value: str = "prediction") -> DataFrame:
    return df.groupBy(*by).agg(F.max(value).alias("max_depth"))


def regression_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Squared logarithmic error takes values below 0 as 0."""
    gap = _p() - _l()
    log = lambda c: F.log1p(F.greatest(c, F.lit(0.0)))
    return df.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap * gap).alias("mse"), F.avg(F.pow(log(_p()) - log(_l()), 2)).alias("msle"))


def nrmse(df: DataFrame, by: list[str]) -> DataFrame:
    gap = _p() - _l()
    out = df.groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("r"), (F.max(_l()) - F.min(_l())).alias("w"))
    return out.select(*by, F.when(F.col("w") == 0, 0.0).otherwise(F.col("r") / F.when(F.col("w") == 0, F.lit(1.0)).otherwise(F.col("w"))).alias("nrmse"))


def mse_by_variable(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(_p() - _l(), 2)).alias("mse"))


def psnr(df: DataFrame, by: list[str], image: str = "image", max_value: float = 1.0) -> DataFrame:
    one = df.groupBy(image, *by).agg(F.avg(F.pow(_p() - _l(), 2)).alias("mse"))
    each = F.when(F.col("mse") == 0, F.lit(math.inf)).otherwise(10 * F.log10(max_value**2 / F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.col("mse"))))
    return one.select(*by, each.alias("psnr")).groupBy(*by).agg(F.avg("psnr").alias("psnr"))


def gaussian(size: int = 11, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma**2)) for k in range(size)]
    return [x / sum(raw) for x in raw]


def ssim(df: DataFrame, image: str = "image", max_value: float = 1.0, size: int = 11) -> DataFrame:
    """(image, ssim): mean over places where the whole stencil lies on the image. Two passes of ``size`` taps, not size squared."""
    taps = F.array(*[F.lit(w) for w in gaussian(size)])
    moments = {"a": _p(), "b": _l(), "aa": _p() * _p(), "bb": _l() * _l(), "ab": _p() * _l()}
    now = df.select(image, "row", "col", *[m.alias(k) for k, m in moments.items()])
    for axis in ("row", "col"):
        keys = [image, *("row", "col")]
        spread = now.select("*", F.posexplode(taps).alias("k", "w")).withColumn(axis, F.col(axis) + F.col("k") - size // 2)
        now = spread.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(m) * F.col("w")).alias(m) for m in moments]).filter(F.col("n") == size).drop("n")
    c1, c2 = (0.01 * max_value) ** 2, (0.03 * max_value) ** 2
    a, b = F.col("a"), F.col("b")
    va, vb, cov = F.col("aa") - a * a, F.col("bb") - b * b, F.col("ab") - a * b
    value = ((2 * a * b + c1) * (2 * cov + c2)) / ((a * a + b * b + c1) * (va + vb + c2))
    return now.groupBy(image).agg(F.avg(value).alias("ssim"))


def weighted_mse(df: DataFrame, by: list[str]) -> DataFrame:
    """Weights 1 / (1 + 100 label); rows with NaN on either side are left out."""
    w = 1 / (1 + 100 * _l())
    kept = df.filter(~(F.isnan(_p().cast("double")) | F.isnan(_l().cast("double"))))
    return kept.groupBy(*by).agg((F.sum(w * F.pow(_p() - _l(), 2)) / F.sum(w)).alias("weighted_mse"))


def flood_weighted_mse(df: DataFrame, by: list[str]) -> DataFrame:
    w = 1 + 30 / (1 + F.exp(-10 * (_l() - 0.05)))
    return df.groupBy(*by).agg(F.avg(w * F.pow(_p() - _l(), 2)).alias("flood_weighted_mse"))


def log_cosh(df: DataFrame, by: list[str]) -> DataFrame:
    """log(cosh(x)) as |x| + log1p(exp(-2|x|)) - log 2, which does not overflow."""
    x = F.abs(_p() - _l())
    return df.groupBy(*by).agg(F.avg(x + F.log1p(F.exp(-2 * x)) - math.log(2)).alias("log_cosh"))


def flood_skill(df: DataFrame, by: list[str], depth: float = 0.1, wet: float = 0.01) -> DataFrame:
    """Bias, intersection over union of flooded cells (denominator at least 1), share of cells alike at ``wet``."""
    p, t = _p() > depth, _l() > depth
    return df.groupBy(*by).agg(
        F.avg(_p() - _l()).alias("bias"),
        (F.count_if(p & t) / F.greatest(F.count_if(p | t), F.lit(1))).alias("iou"),
        F.avg(((_p() > wet) == (_l() > wet)).cast("double")).alias("accuracy"),
    )


def compare_models(df: DataFrame, by: list[str], models: list[str]) -> DataFrame:
    """flood_skill side by side; naming the models saves a pass that looks for them."""
    skill = flood_skill(df, [*by, "model"])
    return skill.groupBy(*by).pivot("model", models).agg(F.first("bias").alias("bias"), F.first("iou").alias("iou"), F.first("accuracy").alias("accuracy"))


def depth_percentiles(df: DataFrame, by: list[str], points: tuple = (0.02, 0.98, 0.995), value: str = "v", exact: bool = True) -> DataFrame:
    """NaN values don't count. Exact for groups of any size, by distributed selection; ``exact=False`` uses the sketch, in one pass."""
    names = [f"p{q * 1000:g}".replace(".", "_") for q in points]
    if exact:
        return ranks.exact_quantiles(df, by, points, names, value)
    kept = df.filter(~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*by).agg(*[F.percentile_approx(value, F.lit(q)).alias(n) for q, n in zip(points, names)])


def summarize_metrics(df: DataFrame, value: str = "v") -> DataFrame:
    """One row; quartiles are exact, and no task gathers the values. NaN values don't count for them."""
    sums = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    quarters = ranks.exact_quantiles(df, [], (0.25, 0.5, 0.75), ["q25", "q50", "q75"], value)
    one = F.lit(0).alias("one")
    both = sums.select("*", one).join(quarters.select("*", one), "one", "left")
    return both.select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def worst_chunk(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """All cells of the chunk with the largest mean absolute error (ties: the first name)."""
    mae = df.groupBy(chunk).agg(F.avg(F.abs(_p() - _l())).alias("mae"))
    worst = mae.orderBy(F.desc("mae"), chunk).limit(1)
    return df.join(F.broadcast(worst), chunk)


def map_stats(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.countDistinct(value).alias("distinct"))


def map_histogram(df: DataFrame, by: list[str], lo: float, hi: float, bins: int, value: str = "v") -> DataFrame:
    """Equal bins from lo to hi, the last one closed; values outside don't count."""
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return df.filter(F.col(value).between(lo, hi)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def dataset_profile(df: DataFrame, by: list[str], n: int, value: str = "v", trivial: float = 0.001) -> DataFrame:
    """Steps, windows of n steps, whether labels are non-trivial (mean above ``trivial``) and real (any non-zero)."""
    steps = F.max("t") + 1
    return df.groupBy(*by).agg(steps.cast("long").alias("steps"), F.greatest(steps - n, F.lit(0)).cast("long").alias("windows"), (F.avg(value) > trivial).alias("non_trivial"), F.bool_or(F.col(value) != 0).alias("real"))


def day_selection_stats(days: DataFrame, by: list[str]) -> DataFrame:
    """Rows (.., selected, has_inputs, has_labels): selected percentage, generated and missing days."""
    made = F.col("selected") & F.col("has_inputs") & F.col("has_labels")
    return days.groupBy(*by).agg((F.count_if(F.col("selected")) * 100.0 / F.count("*")).alias("selected_percent"), F.count_if(made).alias("generated"), F.count_if(F.col("selected") & ~made).alias("missing"))


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def difference_map(df: DataFrame, lo: float, hi: float) -> DataFrame:
    from geofeat.functions.scalar import unscale

    return df.withColumn("difference", unscale(_p(), lo, hi) - unscale(_l(), lo, hi))


@dataclass(frozen=True)
class Metric:
    """A user's metric in mergeable form: states are small values that can be pickled, and never hold a group's rows.

    ``init()`` gives an empty state, ``update(state, predictions, labels)`` takes in two numpy arrays, ``merge(a, b)`` joins two states, ``result(state)``
    is the value. Rows may come in any order and any pieces.
    """

    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], float | None]


_ONE_NAN = float("nan")


def _codes(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """(rows sorted by group, the groups' keys, where each group begins among them). Null and NaN are keys like others."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        index = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code * (index.max(initial=0) + 1) + index, return_inverse=True)
    order = np.argsort(code, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0])) if len(order) else order
    first = batch.select(by).take(pa.array(order[begin]))
    keys = [tuple(_ONE_NAN if x != x else x for x in row) for row in zip(*[first.column(c).to_pylist() for c in by])] if by else [()] * len(begin)
    return order, keys, begin


def metric_udaf(metric: Metric, by: list[str], df: DataFrame, held: int = 50_000, salts: int = 64) -> DataFrame:
    """(by, metric) of columns prediction and label, for groups of any size and number.

    Tasks reduce their rows to one state a group before anything is shuffled (``held`` states at a time in memory); states are then merged in
    order of their keys, one at a time, in two steps: within ``salts`` shares of the tasks, then over the shares.
    """
    keys = df.select(*by).schema
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    rows = df.select(*by, F.col("prediction").cast("double"), F.col("label").cast("double"))

    def record(names: list[tuple], batch: pa.RecordBatch, last: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in names], batch.schema.field(c).type) for i, c in enumerate(by)]
        return pa.record_batch([*columns, pa.array(values, kind)], [*by, last])

    def partial(batches):
        states: dict[tuple, Any] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            p, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("prediction", "label"))
            order, names, begin = _codes(batch, by)
            for name, part in zip(names, np.split(order, begin[1:])):
                states[name] = metric.update(states[name] if name in states else metric.init(), p[part], t[part])
            if len(states) > held:
                yield record(list(states), batch, "state", [pickle.dumps(x) for x in states.values()], pa.binary())
                states.clear()
        if states:
            yield record(list(states), batch, "state", [pickle.dumps(x) for x in states.values()], pa.binary())

    def merging(finish: bool):
        def out(name: tuple, state, batch: pa.RecordBatch) -> pa.RecordBatch:
            if finish:
                return record([name], batch, "metric", [metric.result(state)], pa.float64())
            return record([name], batch, "state", [pickle.dumps(state)], pa.binary())

        def run(batches):
            name, state, batch = None, None, None
            for batch in batches:
                columns, states = [batch.column(c).to_pylist() for c in by], batch.column("state").to_pylist()
                for row, packed in enumerate(states):
                    now, more = tuple(_ONE_NAN if c[row] != c[row] else c[row] for c in columns), pickle.loads(packed)
                    if now == name:
                        state = metric.merge(state, more)
                        continue
                    if name is not None:
                        yield out(name, state, batch)
                    name, state = now, more
            if name is not None:
                yield out(name, state, batch)

        return run

    states = rows.mapInArrow(partial, kinds + "state binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    shares = states.repartition(*by, "salt").sortWithinPartitions(*by, "salt").drop("salt").mapInArrow(merging(False), kinds + "state binary")
    whole = shares.repartition(*by).sortWithinPartitions(*by) if by else shares.coalesce(1)
    return whole.mapInArrow(merging(True), kinds + "metric double")
