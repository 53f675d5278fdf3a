"""Splines, canonical correlation, projections and regions over the antimeridian, each against a plain computation."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.functions import geometry as g
from cubeloom.functions import splines
from cubeloom.operators import alignment, correlation, regions, resampling, subset


def cox(t, k, i, u, last):
    """A basis function by its definition."""
    if k == 0:
        return float(t[i] <= u < t[i + 1] or (u == last == t[i + 1] and t[i] < t[i + 1]))
    a = (u - t[i]) / (t[i + k] - t[i]) * cox(t, k - 1, i, u, last) if t[i + k] > t[i] else 0.0
    b = (t[i + k + 1] - u) / (t[i + k + 1] - t[i + 1]) * cox(t, k - 1, i + 1, u, last) if t[i + k + 1] > t[i + 1] else 0.0
    return a + b


def dense(x, y, at, k):
    """The spline by one dense solve over all labels."""
    t, n = splines.knots(np.asarray(x, float), k), len(x)
    a = np.array([[cox(t, k, i, u, x[-1]) for i in range(n)] for u in x])
    return np.array([[cox(t, k, i, u, x[-1]) for i in range(n)] for u in at]) @ np.linalg.solve(a, y)


@pytest.mark.parametrize("degree", [2, 3, 4, 5])
def test_splines_equal_a_dense_solve(degree):
    rng = np.random.default_rng(degree)
    x = np.cumsum(rng.uniform(0.5, 2, 40))
    y, at = rng.normal(size=40), np.sort(rng.uniform(x[0], x[-1], 60))
    at[0], at[-1] = x[0], x[-1]
    made = np.zeros(60)
    for i, j, w in splines.between(list(x), list(at), degree):
        made[i] += w * y[j]
    np.testing.assert_allclose(made, dense(x, y, at, degree), atol=1e-9)
    assert splines.between([1.0, 2.0], [1.5], degree) == [] and {i for i, _, _ in splines.between(list(x), [x[0] - 1, x[3], x[-1] + 1], degree)} == {1}


def test_long_axes_in_blocks():
    x, at = list(range(2000)), [0.0, 3.25, 777.5, 255.9, 1999.0, 1998.5]
    for degree in (3, 5):
        found = splines.between(x, at, degree)
        y = np.random.default_rng(1).normal(size=2000)
        made = np.zeros(len(at))
        for i, j, w in found:
            made[i] += w * y[j]
        t = splines.knots(np.arange(2000.0), degree)
        a = np.zeros((2000, 2000))
        for i in range(2000):
            k, v = splines.basis(t, degree, float(i), 2000)
            a[i, k] = v
        c = np.linalg.solve(a, y)
        want = [sum(c[k] * v for k, v in zip(*splines.basis(t, degree, u, 2000))) for u in at]
        np.testing.assert_allclose(made, want, atol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_stretched(order):
    y = np.random.default_rng(order).normal(size=30)
    a = np.zeros((30, 30))
    for i in range(30):  # the mirrored cardinal spline by definition
        for k in range(i - 4, i + 5):
            m = abs(k) % 58
            a[i, min(m, 58 - m)] += splines.cardinal(order, i - k)
    c, made = np.linalg.solve(a, y), np.zeros(71)
    for o, i, w in splines.stretched(30, 71, order):
        made[o] += w * y[i]
    at = [29 / 70 * o for o in range(71)]
    mirrored = lambda k: c[min(abs(k) % 58, 58 - abs(k) % 58)]
    want = [sum(mirrored(k) * splines.cardinal(order, u - k) for k in range(int(u) - 5, int(u) + 7)) for u in at]
    np.testing.assert_allclose(made, want, atol=1e-9)
    np.testing.assert_allclose(made[::70], y[[0, -1]], atol=1e-9)


def test_spline_operations(spark):
    start = dt.datetime(2001, 1, 1)
    rows = [(start + dt.timedelta(days=3 * k), c, math.sin(k) + 5 * c) for k in range(12) for c in (0.0, 1.0)] + [(start + dt.timedelta(days=3 * k), 2.0, None if k == 5 else 1.0) for k in range(12)]
    replica = Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, lat double, v double"), ("time", "lat"))
    primary = Cube.of(spark.createDataFrame([(start + dt.timedelta(days=k), 1.0) for k in range(40)], "time timestamp_ntz, p double"), ("time",))
    for method, degree in (("quadratic", 2), ("cubic", 3)):
        got = {((r["time"] - start).days, r["lat"]): r["v"] for r in alignment.temporal_alignment(primary, replica, method).df.collect()}
        want = dense([3.0 * k for k in range(12)], np.array([math.sin(k) for k in range(12)]), [float(k) for k in range(34)], degree)
        assert all(abs(got[k, c] - want[k] - 5 * c) < 1e-9 for k in range(34) for c in (0.0, 1.0)) and got[36, 0.0] is None
        assert got[15, 2.0] is None and len(got) == 120
    rng = np.random.default_rng(4)
    block = rng.normal(size=(6, 8))
    cells = spark.createDataFrame([(1, float(y), float(x), float(block[y, x])) for y in range(6) for x in range(8)], "t int, lat double, lon double, v double")
    found = resampling.resample(Cube.of(cells, ("t", "lat", "lon")), 0.5, 0.5, upsampling_float="cubic").df.orderBy("lat", "lon").collect()
    wy, wx = np.zeros((12, 6)), np.zeros((16, 8))
    for m, n in ((wy, 6), (wx, 8)):
        for o, i, w in splines.stretched(n, 2 * n, 3):
            m[o, i] += w
    np.testing.assert_allclose([r["v"] for r in found], (wy @ block @ wx.T).ravel(), atol=1e-9)


def plain_correlation(x, y):
    """By the singular values of the product of orthogonal bases of centred samples."""

    def base(m):
        m = m - m.mean(axis=0)
        m = m / np.where(m.std(axis=0) > 0, m.std(axis=0), 1)
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        return u[:, s > 1e-5 * max(1.0, s.max(initial=0.0))]

    p, q = base(x), base(y)
    return min(1.0, np.linalg.svd(p.T @ q, compute_uv=False)[0]) if p.shape[1] and q.shape[1] else None


@pytest.mark.parametrize("turned", [False, True])
def test_canonical_correlation(spark, turned):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for pixel in range(12):
        n = (30, 30, 5, 3, 2, 1)[pixel % 6]
        x, y = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) * 1e4
        y[:, 0] += 1e4 * x[:, 1] * (pixel > 5)
        if pixel == 1:
            x[:, 2] = 2 * x[:, 0] + 3  # one direction less
        if pixel == 7:
            x[:] = 4.0
        rows += [(t, 0.0, float(pixel), *map(float, x[t]), *map(float, y[t])) for t in range(n)]
        if turned:
            want[pixel] = plain_correlation(x.T, y.T)
        else:
            want[pixel] = plain_correlation(x, y) if n > 1 else None
    rows += [(t, 0.0, 99.0, None if t == 2 else 1.0 * t, 2.0, 3.0 + t, 1.0, 2.0 * t, 3.0) for t in range(5)]
    want[99] = None
    df = spark.createDataFrame(rows, "time int, lat double, lon double, a double, b double, c double, x double, y double, z double")
    cube = Cube.of(df, ("time", "lat", "lon"))
    got = {int(r["lon"]): r["correlation"] for r in correlation.pixelwise_group_correlation(cube.select(["a", "b", "c"]), cube.select(["x", "y", "z"]), reference_orientation=turned).df.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-6), (k, got[k], w)


def test_equal_area_projection(spark):
    e, n = g.project_point(5.0, 50.0, "EPSG:3035")
    assert abs(e - 3962799.45) < 0.01 and abs(n - 2999718.85) < 0.01  # published with the system's definition
    rng = random.Random(1)
    points = [(rng.uniform(-30, 60), rng.uniform(30, 75)) for _ in range(300)] + [(10.0, 52.0), (10.0, 60.0), (40.0, 52.0)]
    df = spark.createDataFrame(points, "x double, y double")
    for crs in ("EPSG:3035", "EPSG:6931", "EPSG:3857", "EPSG:4326"):
        e, n = g.project(F.col("x"), F.col("y"), crs)
        there = df.select("x", "y", e.alias("e"), n.alias("n"))
        lon, lat = g.unproject(F.col("e"), F.col("n"), crs)
        for r in there.select("*", lon.alias("lon"), lat.alias("lat")).collect():
            assert abs(r["lon"] - r["x"]) < 1e-6 and abs(r["lat"] - r["y"]) < 1e-6, crs
            assert np.allclose(g.project_point(r["x"], r["y"], crs), (r["e"], r["n"]))
    assert g.unproject(F.col("x"), F.col("y"), "EPSG:9999") is None


def test_polygon_over_the_antimeridian(spark):
    cells = spark.createDataFrame([(float(y), float(x) + 0.5, 1.0) for y in range(-20, 21) for x in range(-180, 180)], "lat double, lon double, v double")
    cube = Cube.of(cells, ("lat", "lon")).with_(attrs={"geospatial_lat_resolution": 1.0, "geospatial_lon_resolution": 1.0})
    triangle = "POLYGON ((170 -10, 175 12, -165 -10, 170 -10))"
    got = {(r["lat"], r["lon"]): r["v"] for r in subset.subset_spatial(cube, triangle).df.collect()}
    ring = [(170, -10), (175, 12), (195, -10)]

    def inside(x, y):
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(ring, ring[1:] + ring[:1])]
        return all(s <= 1e-9 for s in side) or all(s >= -1e-9 for s in side)

    assert {x for _, x in got} == {x + 0.5 for x in (*range(169, 180), *range(-180, -164))}
    for (y, x), v in got.items():
        corners = any(inside((x + 360 if x < 0 else x) + a, y + b) for a in (-0.5, 0.5) for b in (-0.5, 0.5))
        assert (v is not None) == corners, (y, x)
    assert any(v for (_, x), v in got.items() if x < 0) and any(v for (_, x), v in got.items() if x > 0)
    box = subset.subset_spatial(cube, "175,-5,-175,5").df
    assert {r["lon"] for r in box.select("lon").distinct().collect()} == {x + 0.5 for x in (*range(174, 180), *range(-180, -174))}


def test_regions_by_scan_lines(spark):
    rng = random.Random(5)
    shapes = []
    for k in range(25):
        cx, cy, n = rng.uniform(-150, 150), rng.uniform(-60, 60), rng.randrange(3, 12)
        ring = [(cx + 25 * rng.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), cy + 25 * rng.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        shapes.append((f"r{k}", f"c{k % 3}", g.Geometry("POLYGON", [[*ring, ring[0]]])))
    shapes.append(("ring", "c0", "POLYGON ((-20 -20, 20 -20, 20 20, -20 20, -20 -20), (-10 -10, 10 -10, 10 10, -10 10, -10 -10))"))
    known = regions.Regions(shapes)
    cells = spark.createDataFrame([(float(y), float(x)) for y in range(-88, 89, 4) for x in range(-178, 179, 4)], "lat double, lon double")
    cube = Cube.of(cells.withColumn("v", F.lit(1.0)), ("lat", "lon"))
    got = {(r["lat"], r["lon"]): r["code"] for r in regions.region_codes(cube, known).collect()}

    def odd(x, y, s):
        hits = 0
        for x1, y1, x2, y2 in g._edges(s):
            if (y1 > y) != (y2 > y) and x < (y - y1) * (x2 - x1) / (y2 - y1) + x1:
                hits += 1
        return hits % 2

    for y in range(-88, 89, 4):
        for x in range(-178, 179, 4):
            want = next((i + 1 for i, (_, _, s) in enumerate(known.rows) if odd(x, y, s)), None)
            assert got.get((float(y), float(x))) == want
    plan = regions.region_codes(cube, known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
