"""Forms for groups and slices of any size, each against the plain one."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.functions import quantiles
from cubeloom.operators import gapfilling, lookup


def test_medians_of_large_groups(spark):
    rng = random.Random(2)
    inf = float("inf")
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(700)], "b": [float(rng.randrange(5)) for _ in range(500)], None: [rng.random() * 1e-9 for _ in range(301)], "ties": [4.0] * 400, "few": [3.0, 1.0], "nulls": [None] * 300, "odd": [inf, -inf, 1.0, 2.0, float("nan"), None, *[2.5] * 300, -inf]}
    rows = [(k, n, x, None if x is None else -2 * x) for k, v in groups.items() for n, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, n int, x double, y double").repartition(5)
    for most in (100, 10**9):  # by histograms, by sorting
        got = {r["k"]: (r["m"], r["w"], r["c"]) for r in quantiles.aggregated(df, ["k"], [F.count("*").alias("c")], {"m": F.col("x"), "w": F.col("y")}, most).collect()}
        for k, v in groups.items():
            some = [x for x in v if x is not None and x == x]
            want = statistics.median(some) if some else None
            assert got[k] == (want, None if want is None else -2 * want, len(v)), (k, most)
    bare = quantiles.aggregated(df, ["k"], [], {"m": F.col("x")}, 100)
    assert {r["k"]: r["m"] for r in bare.collect()}["b"] == statistics.median(groups["b"])
    whole = quantiles.aggregated(df, [], [F.count("x").alias("c")], {"m": F.col("n")}).first()
    assert whole["m"] == statistics.median(r[1] for r in rows)
    assert quantiles.aggregated(df.limit(0), ["k"], [], {"m": F.col("x")}).count() == 0
    assert quantiles.aggregated(df.limit(0), [], [F.count("*").alias("c")], {"m": F.col("x")}).collect() == [(0, None)]


@pytest.mark.parametrize(("tile", "steps"), [(5, 2), (7, 99), (64, 4)])
def test_tiles_equal_whole_slices(spark, tile, steps):
    rng = np.random.default_rng(6)
    kernel = rng.uniform(0.2, 1, (3, 5))
    rows, want = [], {}
    for t in range(3):
        block = np.where(rng.random((23, 17)) < (0.1, 0.4, 0.0)[t], rng.normal(size=(23, 17)), np.nan)
        filled = gapfilling.fill(block, kernel)
        for y in range(23):
            for x in range(17):
                want[t, y, x] = filled[y, x]
                if t == 0 or not np.isnan(block[y, x]) or (x, y) == (0, 0):  # other slices hold few rows
                    rows.append((t, float(y), float(x), None if np.isnan(block[y, x]) else float(block[y, x])))
    cube = Cube.of(spark.createDataFrame(rows, "t int, lat double, lon double, v double"), ("t", "lat", "lon"))
    got = gapfilling.gapfill(cube, kernel, tile=tile, steps=steps).df.collect()
    slices = {(r["t"], int(r["lat"]), int(r["lon"])): r["v"] for r in got}
    assert len(slices) == len(got) and {k[0] for k in slices} == {0, 1, 2}
    assert all((v is None) == bool(np.isnan(want[k])) and (v is None or abs(v - want[k]) < 1e-9) for k, v in slices.items())
    assert len([k for k in slices if k[0] < 2]) == 2 * 23 * 17


def test_gaps_of_nothing(spark):
    empty = Cube.of(spark.createDataFrame([], "lat double, lon double, v double"), ("lat", "lon"))
    assert gapfilling.gapfill(empty).df.count() == 0
    one = Cube.of(spark.createDataFrame([(1.0, 2.0, None)], "lat double, lon double, v double"), ("lat", "lon"))
    assert gapfilling.gapfill(one).df.collect() == [(1.0, 2.0, None)]


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_nearest_steps(spark, buckets):
    rng = random.Random(buckets)
    start = dt.datetime(2001, 1, 1)
    steps = sorted({start + dt.timedelta(seconds=rng.choice((rng.randrange(100), rng.randrange(10**6)))) for _ in range(300)})
    asked = {start + dt.timedelta(seconds=rng.randrange(-1000, 2 * 10**6), microseconds=rng.choice((0, 500_000))) for _ in range(500)} | set(steps[:40]) | {steps[5] + (steps[6] - steps[5]) / 2}
    frame = lambda ts: spark.createDataFrame([(t,) for t in [*ts, None]], "t timestamp_ntz")
    got = {r["asked_time"]: r["nearest"] for r in lookup.nearest_steps(frame(asked), frame(steps), buckets).collect()}
    assert got == {t: min(steps, key=lambda s: (abs(s - t), s)) for t in asked}
    assert lookup.nearest_steps(frame([]), frame(steps)).count() == 0
    assert {r["nearest"] for r in lookup.nearest_steps(frame(asked), frame([])).collect()} == {None}


def test_nearest_steps_read_each_time_once(spark):
    """In a bucket no frame runs on to the last row, as that would read all further rows for each."""
    at = lambda s: f"timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, 0, 0, 0, {s})"
    found = lookup.nearest_steps(spark.range(40_000).selectExpr(f"{at('id')} AS t"), spark.range(100).selectExpr(f"{at('id * 300')} AS t"), buckets=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rangeframe" in plan and "currentrow$(), unboundedfollowing" not in plan
    late = found.selectExpr("unix_seconds(cast(asked_time AS timestamp)) - 978307200 AS a", "unix_seconds(cast(nearest AS timestamp)) - 978307200 AS b")
    assert late.where("b <> least(29700, 300 * floor((a + 149) / 300))").count() == 0 and late.count() == 40_000
