"""Positions, quantiles and the change log against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofeat.operators import examples, metrics, ranks
from geofeat.operators.changelog import ChangeLog, ConflictError


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), k) for k in range(2000)]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, x int, id int").repartition(7), ["g"], [F.col("x"), F.col("id")]).collect()
    want = {}
    for g in ("hot", "b", None):
        for p, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = p
    assert {r["id"]: r["pos"] for r in got} == want


def test_batches_and_limits(spark):
    rows = [("s" if k % 5 else "t", (k * 37) % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "sim string, x int, id int")
    of = lambda s: [r[2] for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1])]
    got = {r["id"]: r["batch_id"] for r in examples.with_batch_id(df, 64, ["x"]).collect()}
    assert got == {i: p // 64 for s in "st" for p, i in enumerate(of(s))}
    for k in (1, 30, 5000):
        assert {r["id"] for r in examples.limit_per_sim(df, k, ["x"]).collect()} == {i for s in "st" for i in of(s)[:k]}


def test_a_split_is_numbered_by_buckets(spark):
    chunks = spark.createDataFrame([("s", "c", x, y) for x in range(30) for y in range(20)], "study_area string, config string, x_index int, y_index int")
    got = {(r["x_index"], r["y_index"]): r["dataset"] for r in examples.dataset_split(chunks).collect()}
    order = sorted(got, key=lambda k: hashlib.sha256(f"s|c|{k[0]}|{k[1]}".encode()).hexdigest())
    assert [got[k] for k in order] == ["train"] * 360 + ["val"] * 120 + ["test"] * 120


@pytest.mark.parametrize("bound,bins", [(10_000, 256), (60, 16)])
def test_quantiles_equal_percentile(spark, bound, bins):
    rng = random.Random(2)
    rows = [("ties", rng.choice([1.0, 1.0, 1.0, 2.5])) for _ in range(300)] + [("wide", math.copysign(10 ** rng.uniform(-300, 308), rng.random() - 0.5)) for _ in range(200)]
    rows += [("odd", x) for x in (math.nan, None, 3.0, -math.inf and -1.0)] + [("none", None), ("none", math.nan), (None, 4.0), (None, 5.0)]
    rows += [("normal", rng.gauss(0, 1)) for _ in range(997)]
    df = spark.createDataFrame(rows, "g string, v double")
    points, names = (0.0, 0.02, 0.5, 0.75, 0.98, 1.0), ["a", "b", "c", "d", "e", "f"]
    kept = df.filter("v is not null and not isnan(v)")
    want = {r["g"]: tuple(r)[1:] for r in kept.groupBy("g").agg(*[F.percentile("v", F.lit(q)) for q in points]).collect()} | {"none": (None,) * 6}
    got = {r["g"]: tuple(r)[1:] for r in ranks.exact_quantiles(df, ["g"], points, names, bound=bound, bins=bins).collect()}
    assert got == want


def test_summary_needs_no_single_task(spark):
    v = [float((k * 7919) % 10007) for k in range(10007)]
    row = metrics.summarize_metrics(spark.createDataFrame([(x,) for x in v], "v double")).head()
    assert (row["count"], row["min"], row["q25"], row["q50"], row["q75"], row["max"]) == (10007, 0.0, *np.percentile(v, [25, 50, 75]), 10006.0)
    empty = metrics.summarize_metrics(spark.createDataFrame([], "v double")).head()
    assert empty["count"] == 0 and empty["q50"] is None


ROWS = "id int, state string, n int"


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/t", ["id"])
    with pytest.raises(ValueError, match="no version"):
        log.snapshot()
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    table = lambda v=None: sorted(tuple(r) for r in log.snapshot(v).collect())
    assert log.version() == -1 and log.commit(rows((1, "a", 1), (2, "b", 2)), -1) == 0
    assert log.commit(rows((2, "c", None), (3, "d", 3)), 0) == 1
    assert log.commit(spark.createDataFrame([(1,)], "id int"), 1, "delete") == 2
    assert table() == [(2, "c", None), (3, "d", 3)] and table(1) == [(1, "a", 1), (2, "c", None), (3, "d", 3)] and table(0) == [(1, "a", 1), (2, "b", 2)]
    assert log.compact() == 3 and table() == table(2) and table(0) == [(1, "a", 1), (2, "b", 2)]
    assert len(log._entries()) == 1
    log.commit(rows((1, "again", 9)), 3)
    assert table() == [(1, "again", 9), (2, "c", None), (3, "d", 3)]
    with pytest.raises(ValueError):
        log.snapshot(99)
    with pytest.raises(ValueError):
        log.commit(rows((1, "x", 1)), 40)


def test_of_two_writers_one_loses(spark, tmp_path):
    first, second = (ChangeLog(spark, f"file://{tmp_path}/t", ["id"]) for _ in range(2))
    first.commit(spark.createDataFrame([(1, "a", 0)], ROWS), -1)
    read = second.version()
    first.commit(spark.createDataFrame([(1, "b", 1)], ROWS), read)
    with pytest.raises(ConflictError):
        second.commit(spark.createDataFrame([(1, "lost", 1)], ROWS), read)
    assert [r["state"] for r in second.snapshot().collect()] == ["b"]
    # A change that is made again from the newer snapshot goes through.
    calls = []

    def change(now):
        if not calls:
            first.commit(spark.createDataFrame([(1, "c", 5)], ROWS), first.version())
        calls.append(1)
        return now.withColumn("n", F.col("n") + 1)

    second.update(change)
    assert len(calls) == 2 and [(r["state"], r["n"]) for r in second.snapshot().collect()] == [("c", 6)]


def test_a_crash_between_the_steps_leaves_the_old_table(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, f"file://{tmp_path}/t", ["id"])
    log.commit(spark.createDataFrame([(1, "a", 0)], ROWS), -1)
    monkeypatch.setattr(ChangeLog, "_append", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError, match="crash"):
        log.commit(spark.createDataFrame([(1, "half", 0)], ROWS), 0)
    monkeypatch.undo()
    assert log.version() == 0 and [r["state"] for r in log.snapshot().collect()] == ["a"]
    assert log.commit(spark.createDataFrame([(1, "b", 0)], ROWS), 0) == 1
