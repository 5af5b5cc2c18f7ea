"""Windows over time steps, in long form: one row a step, never arrays before the sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_windows(labels: DataFrame, n: int, by: list[str], value: str = "v") -> DataFrame:
    """(by, t, k, value, label): for each step t with all n steps before it their values (k from 0), and its own value."""
    w = Window.partitionBy(*by).orderBy("t")
    past = labels.withColumn("past", F.collect_list(value).over(w.rangeBetween(-n, -1))).filter(F.size("past") == n)
    return past.select(*by, "t", F.col(value).alias("label"), F.posexplode("past").alias("k", value))


def label_windows_compact(labels: DataFrame, n: int, by: list[str], value: str = "v") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("t")
    return labels.withColumn("past", F.collect_list(value).over(w.rangeBetween(-n, -1))).filter(F.size("past") == n)


def rain_windows(rain: DataFrame, n: int) -> DataFrame:
    """(config, t, k, amount): amounts of the steps t-n .. t-1, 0 before the start."""
    steps = rain.select("config", "t").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.col("t") - n + F.col("k"))
    amounts = rain.select("config", F.col("t").alias("at"), "amount")
    return steps.join(amounts, ["config", "at"], "left").select("config", "t", "k", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def check_rainfall_length(rain: DataFrame, most: int) -> DataFrame:
    count = F.count("*").over(Window.partitionBy("config"))
    wrong = F.raise_error(F.concat(F.lit("too many rainfall entries: "), F.col("config"))).cast("double")
    return rain.withColumn("n", count).withColumn("amount", F.when(F.col("n") > most, wrong).otherwise(F.col("amount"))).drop("n")


def pad_rainfall(rain: DataFrame, length: int) -> DataFrame:
    """(config, t, amount, duration): zeros up to the length; the real count is kept. More entries are an error."""
    sizes = rain.groupBy("config").agg(F.count("*").alias("duration"))
    full = sizes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return full.join(check_rainfall_length(rain, length), ["config", "t"], "left").select("config", "t", F.coalesce("amount", F.lit(0.0)).alias("amount"), "duration")


def tile(rain: DataFrame, m: int) -> DataFrame:
    return rain.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def boundary_pairs(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, t, first, second) of steps t and t+1."""
    w = Window.partitionBy(*by).orderBy("t")
    return df.select(*by, "t", F.col(value).alias("first"), F.lead(value).over(w).alias("second"), F.lead("t").over(w).alias("to")).filter("to is not null").drop("to")


def split_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, step, value): the halves of all pairs in order, without the outermost two."""
    w = Window.partitionBy(*by)
    both = pairs.withColumn("lo", F.min("t").over(w)).withColumn("hi", F.max("t").over(w))
    halves = both.select(*by, "t", "lo", "hi", F.posexplode(F.array("first", "second")).alias("k", "value"))
    kept = halves.filter(~((F.col("t") == F.col("lo")) & (F.col("k") == 0)) & ~((F.col("t") == F.col("hi")) & (F.col("k") == 1)))
    return kept.select(*by, ((F.col("t") - F.col("lo")) * 2 + F.col("k") - 1).cast("long").alias("step"), "value")


def divide_into_days(inputs: DataFrame, by: list[str], per_day: int = 4, value: str = "v") -> DataFrame:
    """(by, day, k, value): a day's steps with one before and one after; the first and last step are repeated at the ends."""
    last = inputs.groupBy(*by).agg(F.max("t").alias("last"))
    days = last.filter(F.col("last") + 1 >= per_day).withColumn("day", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") + 1) / per_day).cast("int") - 1)))
    steps = days.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_day + 1))))
    at = F.least(F.greatest(F.col("day") * per_day + F.col("k") - 1, F.lit(0)), F.col("last"))
    return steps.withColumn("t", at.cast("int")).join(inputs.withColumn("t", F.col("t").cast("int")), [*by, "t"]).select(*by, "day", "k", value)


def day_label_split(labels: DataFrame, per_day: int = 8, value: str = "v") -> DataFrame:
    return labels.withColumn("day", F.floor(F.col("t") / per_day).cast("int")).withColumn("k", F.pmod("t", F.lit(per_day)))


def io_sequences(inputs: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, t, before, now, after), the ends repeated."""
    w = Window.partitionBy(*by).orderBy("t")
    return inputs.select(*by, "t", F.coalesce(F.lag(value).over(w), F.col(value)).alias("before"), F.col(value).alias("now"), F.coalesce(F.lead(value).over(w), F.col(value)).alias("after"))


def output_pairs(labels: DataFrame, value: str = "v") -> DataFrame:
    return labels.withColumn("pair", F.floor(F.col("t") / 2).cast("int")).withColumn("k", F.pmod("t", F.lit(2)))


def check_divides(inputs: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio): labels an input step; steps that don't divide are an error."""
    a = inputs.groupBy(*by).agg(F.count("*").alias("i")).join(labels.groupBy(*by).agg(F.count("*").alias("l")), by)
    return a.select(*by, F.when(F.col("l") % F.col("i") != 0, F.raise_error(F.lit("steps do not divide")).cast("long")).otherwise((F.col("l") / F.col("i")).cast("long")).alias("ratio"))


def _gather(df: DataFrame, by: list[str], hours: int, offsets: Column, need: int, value: str) -> DataFrame:
    days = df.select(*by, F.to_date("ts").alias("date")).distinct()
    wanted = days.withColumn("k", F.explode(offsets))
    wanted = wanted.withColumn("ts", F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.col("k") * hours))
    got = wanted.join(df.select(*by, "ts", value), [*by, "ts"])
    return got.withColumn("n", F.count("*").over(Window.partitionBy(*by, "date"))).filter(F.col("n") == need).select(*by, "date", "k", value)


def day_spatiotemporal(met: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, date, k, value): the six six-hourly steps from -6 h to +24 h; days that lack one go."""
    return _gather(met, by, 6, F.sequence(F.lit(-1), F.lit(4)), 6, value)


def day_labels(wrf: DataFrame, by: list[str], k: int, value: str = "v") -> DataFrame:
    """The last k of a day's eight three-hourly steps; days that lack one go."""
    return _gather(wrf, by, 3, F.sequence(F.lit(8 - k), F.lit(7)), k, value)


def last_steps(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("t"))
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def rollout(inputs: DataFrame, by: list[str], n: int, step_fn: Callable, schema: str) -> DataFrame:
    """Autoregressive steps per group: ``step_fn(window, t)`` gives the next values, the window drops its oldest step.

    ``inputs`` are (by, t, row, col, v); the function gets a frame of the window and returns row, col, v of the next step.
    """

    def run(pdf):
        import pandas as pd

        keys = {c: pdf[c].iloc[0] for c in by}
        window, out = pdf.sort_values("t"), []
        for _ in range(n):
            now = int(window["t"].max()) + 1
            new = step_fn(window, now).assign(t=now, **keys)
            out.append(new)
            window = pd.concat([window[window["t"] > window["t"].min()], new], ignore_index=True)
        return pd.concat(out, ignore_index=True)[[c.split()[0] for c in schema.split(", ")]]

    return inputs.groupBy(*by).applyInPandas(run, schema)
