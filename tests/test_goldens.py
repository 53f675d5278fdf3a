"""Small cases with known results. The numbers in the tables are fixed values."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cubeloom.cube import Cube, ValidationError
from cubeloom.functions import geometry as g
from cubeloom.operators import aggregate, alignment, anomaly, arithmetics, correlation, data_frame, gapfilling, normalize, outliers, resampling, select, subset, timeseries, utility

N = None
#: (primary: steps, frequency, start), (replica: the same), method, first cell at each primary step
ALIGNMENTS = [
    ((5, "YS", "2010-01-01"), (10, "MS", "2009-08-01"), "mean", [14, N, N, N, N]),
    ((5, "YS", "2010-01-01"), (10, "MS", "2011-08-01"), "mean", [N, 4, 14, N, N]),
    ((5, "YE", "2010-01-01"), (10, "ME", "2015-07-01"), "mean", [N, N, N, N, 4]),
    ((5, "MS", "2011-09-01"), (10, "D", "2011-08-25"), "mean", [16, N, N, N, N]),
    ((5, "MS", "2011-07-01"), (10, "D", "2011-09-26"), "mean", [N, N, 4, 14, N]),
    ((5, "MS", "2011-05-01"), (10, "D", "2011-09-26"), "mean", [N, N, N, N, 4]),
    ((5, "5D", "2011-09-01"), (10, "D", "2011-08-25"), "mean", [16, N, N, N, N]),
    ((5, "5D", "2011-09-01"), (10, "D", "2011-09-08"), "mean", [N, 1, 8, 16, N]),
    ((5, "5D", "2011-09-01"), (10, "D", "2011-09-21"), "mean", [N, N, N, N, 4]),
    ((5, "MS", "2011-09-01"), (10, "5D", "2011-08-15"), "mean", [11, 18, N, N, N]),
    ((5, "MS", "2011-07-01"), (10, "5D", "2011-08-15"), "mean", [N, 2, 11, 18, N]),
    ((5, "MS", "2011-05-01"), (10, "5D", "2011-08-15"), "mean", [N, N, N, 2, 11]),
    ((5, "D", "2011-08-18"), (10, "6h", "2011-08-15T21:00"), "mean", [17, N, N, N, N]),
    ((5, "D", "2011-08-14"), (10, "6h", "2011-08-15T03:00"), "mean", [N, 3, 11, 17, N]),
    ((5, "D", "2011-08-11"), (10, "6h", "2011-08-15T03:00"), "mean", [N, N, N, N, 3]),
    ((5, "QS", "2011-01-01"), (10, "2W", "2010-10-10"), "mean", [15, N, N, N, N]),
    ((5, "QS", "2011-01-01"), (10, "2W", "2011-05-10"), "mean", [N, 2, 12, N, N]),
    ((5, "QS", "2010-01-01"), (10, "2W", "2011-03-01"), "mean", [N, N, N, N, 1]),
    ((10, "ME", "2015-07-01"), (5, "YE", "2010-01-01"), "nearest", [8] * 5 + [N] * 5),
    ((10, "MS", "2012-07-01"), (5, "YS", "2010-01-01"), "mean", [4] * 6 + [6] * 4),
    ((10, "MS", "2009-07-01"), (5, "YS", "2010-01-01"), "mean", [N] * 6 + [0] * 4),
    ((10, "D", "2015-06-22"), (5, "5D", "2015-06-01"), "nearest", [8] * 4 + [N] * 6),
    ((10, "D", "2015-06-12"), (5, "5D", "2015-06-01"), "nearest", [4] * 4 + [6] * 5 + [8]),
    ((10, "D", "2015-06-02"), (5, "5D", "2015-06-11"), "nearest", [N] * 9 + [0]),
    ((10, "2W", "2016-02-17"), (5, "QS", "2015-01-01"), "nearest", [8] * 3 + [N] * 7),
    ((10, "2W", "2016-02-17"), (5, "QS", "2015-07-01"), "nearest", [4] * 3 + [6] * 6 + [8]),
    ((10, "2W", "2015-03-17"), (5, "QS", "2015-07-01"), "nearest", [N] * 7 + [0] * 3),
    ((10, "10h", "2015-07-25T19:00"), (5, "2D", "2015-07-18"), "nearest", [6] + [8] * 4 + [N] * 5),
    ((10, "10h", "2015-07-25T19:00"), (5, "2D", "2015-07-22"), "nearest", [2] + [4] * 4 + [6] * 5),
    ((10, "10h", "2015-07-19T19:00"), (5, "2D", "2015-07-22"), "nearest", [N] * 5 + [0] * 5),
]


def series(spark, n, freq, start, name):
    t = pd.date_range(start, periods=n + 1, freq=freq)
    times = [x.to_pydatetime() for x in t[:-1] + (t[1] - t[0]) // 2]
    df = spark.createDataFrame([(x, float(la), 0.0, 2.0 * i + la) for i, x in enumerate(times) for la in range(2)], f"time timestamp_ntz, lat double, lon double, {name} double")
    return Cube.of(df, ("time", "lat", "lon")), times


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("case", range(len(ALIGNMENTS)))
def test_alignment(spark, case):
    a, b, method, want = ALIGNMENTS[case]
    (p, times), (r, _) = series(spark, *a, "p"), series(spark, *b, "r")
    rows = alignment.temporal_alignment(p, r, method=method).df.orderBy("time", "lat").collect()
    assert [x["time"] for x in rows[::2]] == times
    assert [x["r"] for x in rows[::2]] == want and [x["r"] for x in rows[1::2]] == [None if w is None else w + 1 for w in want]


def test_statistics_of_a_function_cube(spark):
    df = spark.range(5 * 8 * 16).select(
        (F.col("id") % 5).cast("int").alias("time"), (F.floor(F.col("id") / 5) % 8 - 89.5).cast("double").alias("lat"), F.floor(F.col("id") / 40).cast("double").alias("lon"),
        (F.floor(F.col("id") / 5) % 8 + F.floor(F.col("id") / 40) * 0.1).alias("chl"), (F.floor(F.col("id") / 5) % 8 * 0.1 + F.floor(F.col("id") / 40)).alias("aot"),
    )
    cube = Cube.of(df, ("time", "lat", "lon"))
    methods = ["count", "mean", "median", "sum", "std", "min", "max"]
    plain = aggregate.statistics(cube, methods=methods, apply_spatial_weighting=False).sides[()].first()
    weighted = aggregate.statistics(cube, methods=methods).sides[()].first()
    want = {"chl": (635, 4.25, 4.25, 2720, 2.337199, 0, 8.5), "aot": (635, 7.85, 7.85, 5024, 4.615463, 0, 15.7)}
    heavy = {"chl": (635, 5.56079961, 4.25, 248.05866912, 0, 0, 8.5), "aot": (635, 7.98107996, 7.85, 356.02363189, 0, 0, 15.7)}
    for v in want:
        assert [plain[f"{v}_{m}"] for m in methods] == pytest.approx(want[v], abs=1e-6)
        assert [weighted[f"{v}_{m}"] for m in methods] == pytest.approx(heavy[v], abs=1e-6)


def cells(spark, rows):
    return spark.createDataFrame([(y, x, None if v is None else float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "iy int, ix int, v double"), (len(rows), len(rows[0]))


def matrix(df, shape):
    out = [[None] * shape[1] for _ in range(shape[0])]
    for r in df.collect():
        out[r["iy"]][r["ix"]] = r["v"]
    return out


DOWN = [
    ([[0.6, 0.2, 3.4], [1.4, 1.6, 1.0], [4.0, 2.8, 3.0]], "mean", 1, [[1.8 / 2.25, 4.4 / 2.25], [6.5 / 2.25, 5.3 / 2.25]]),
    ([[0.9, 0.5, 3.0, 4.0], [1.1, 1.5, 1.0, 2.0], [4.0, 2.1, 3.0, 5.0], [3.0, 4.9, 3.0, 1.0]], "mean", 1, [[1.0, 2.5], [3.5, 3.0]]),
    ([[N, N, 3.0, 4.0], [N, N, 1.0, 2.0], [4.0, 2.1, 3.0, N], [3.0, 4.9, N, 1.0]], "mean", 1, [[N, 2.5], [3.5, 2.0]]),
    ([[2, 4, 1], [1, 2, 2], [1, 1, 1]], "mode", 1, [[2, 1], [1, 1]]),
    ([[3, 5, 2, 1], [3, 5, 4, 3], [1, 1, 3, 4], [4, 1, 4, 4]], "mode", 1, [[3, 2], [1, 4]]),
    ([[3, 5, 2, 1], [3, 5, 4, 3], [1, 1, 3, 4], [4, 1, 4, 4]], "mode", 2, [[5, 1], [4, 3]]),
]
UP = [
    ([[1, 2, 3]], (1, 5), "linear", [[1, 1.5, 2, 2.5, 3]]),
    ([[1, 2, 3, 4]], (1, 6), "linear", [[1, 1.6, 2.2, 2.8, 3.4, 4]]),
    ([[1, 2], [3, N]], (4, 4), "linear", [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, N, N], [3, 3, N, N]]),
    ([[1, 2, 3], [1, 2, 3], [1, 2, N]], (5, 5), "linear", [[1, 1.5, 2, 2.5, 3], [1, 1.5, 2, 2.5, 3], [1, 1.5, 2, 3, 3], [1, 1.5, 2, N, N], [1, 1.5, 2, N, N]]),
    ([[1, 2], [3, 4]], (4, 4), "nearest", [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]),
]


def flat(rows):
    return [-99 if v is None else v for r in rows for v in r]


def test_grids(spark):
    for source, method, rank, want in DOWN:
        df, shape = cells(spark, source)
        assert flat(matrix(resampling.resample_2d(df, shape, (2, 2), down=method, mode_rank=rank), (2, 2))) == pytest.approx(flat(want)), method
    for source, out, method, want in UP:
        df, shape = cells(spark, source)
        assert flat(matrix(resampling.resample_2d(df, shape, out, up=method), out)) == pytest.approx(flat(want)), method
    df, shape = cells(spark, [[1.0, 2.0, 3.0, 4.0]] * 2)
    assert flat(matrix(resampling.resample_2d(df, shape, (4, 2)), (4, 2))) == pytest.approx([1.5, 3.5] * 4)


def test_coregistration_of_a_fine_and_a_coarse_grid(spark):
    fine = spark.createDataFrame([(0, -67.5 + 45 * i, -157.5 + 45 * j, float(i == j)) for i in range(4) for j in range(8)], "time int, lat double, lon double, first double")
    coarse = spark.createDataFrame([(0, -60.0 + 60 * i, -150.0 + 60 * j, float(i == j)) for i in range(3) for j in range(6)], "time int, lat double, lon double, first double")
    a, b = Cube.of(fine, ("time", "lat", "lon")), Cube.of(coarse, ("time", "lat", "lon"))
    down = resampling.coregister(b, a).df.orderBy("lat", "lon").collect()
    assert len(down) == 18 and down[0]["first"] == pytest.approx((1 + 1 / 3 * 1 / 3) / (4 / 3) ** 2) and down[0]["lat"] == -60
    up = resampling.coregister(a, b, method_us="nearest").df.orderBy("lat", "lon").collect()
    assert len(up) == 32 and [r["first"] for r in up[:8]] == [1, 1, 0, 0, 0, 0, 0, 0]
    assert resampling.coregister(a, a).df is a.df
    with pytest.raises(ValidationError):
        resampling.coregister(a, Cube.of(fine.where("lat <> -22.5"), ("time", "lat", "lon")))


def test_gap_filling(spark):
    import numpy as np

    ones, nan = np.ones((3, 3)), float("nan")
    check = lambda a, b, k=ones: np.testing.assert_allclose(gapfilling.fill(np.array(a, float), k), np.array(b, float))
    check([[nan, 2], [3, 4]], [[3, 2], [3, 4]])
    check([[nan, nan]], [[nan, nan]])
    check([[nan, nan], [nan, 4]], [[4, 4], [4, 4]])
    check([[nan, 2, 3], [4, nan, 6], [7, 8, 9]], [[3, 2, 3], [4, 39 / 7, 6], [7, 8, 9]])
    check([[nan, nan], [nan, 4]], [[nan, nan], [nan, 4]], np.array(gapfilling.KERNEL))
    df = spark.createDataFrame([(0, float(y), float(x), None if y == x == 1 else 1.0 * (y + x)) for y in range(3) for x in range(3)], "time int, lat double, lon double, v double")
    assert gapfilling.gapfill(Cube.of(df, ("time", "lat", "lon"))).df.where("lat = 1 AND lon = 1").first()["v"] == pytest.approx(2.0)


def test_points_and_regions(spark):
    rows = [("a", 10.0, 10.0), ("b", 10.0, 20.0), ("c", 10.0, 30.0), ("d", 20.0, 30.0), ("e", 20.0, 20.0), ("f", 20.0, 10.0)]
    df = data_frame.as_geodataframe(spark.createDataFrame(rows, "n string, lon double, lat double"))
    ask = lambda q: sorted(r["n"] for r in data_frame.query(df, q).collect())
    assert ask("@within('POLYGON ((5 5, 15 5, 15 35, 5 35, 5 5))')") == ["a", "b", "c"]
    assert ask("@touches('POLYGON ((10 5, 30 5, 30 35, 10 35, 10 5))')") == ["a", "b", "c"]
    assert ask("@almost_equals('10,10')") == ["a"] and ask("@disjoint('5,5,15,35')") == ["d", "e", "f"]
    assert ask("lon == 20 and not (lat < 15 or n == 'd')") == ["e"] and ask("n in ['a', 'f'] and lat + 1 > 10") == ["a", "f"]
    near = data_frame.find_closest(df, "20, 29", max_results=2).collect()
    assert [r["n"] for r in near] == ["d", "c"] and near[0]["distance"] == pytest.approx(1.0)
    assert data_frame.find_closest(df, "20, 29", max_dist=0.5).count() == 0
    assert data_frame.data_frame_max(df, "lat").first()["n"] == "c" and data_frame.data_frame_min(df, "lat").first()["n"] == "a"
    for bad in ("nothing == 1", "lon ==", "__import__('os')", "@unknown > 3", "lon.real"):
        with pytest.raises(ValidationError):
            data_frame.query(df, bad)
    hole = g.parse_geometry("POLYGON ((0 0, 30 0, 30 40, 0 40, 0 0), (9 9, 11 9, 11 11, 9 11, 9 9))")
    inside = df.where(g.within(F.col("lon"), F.col("lat"), hole)).count()
    assert inside == 5 and hole.area == 1196 and g.parse_geometry(hole.wkt).wkt == hole.wkt
    x, y = g.project_point(-75.0, -10.0, "EPSG:32718")
    assert (round(x), round(y)) == (500000, 8894588)


def globe(spark, step=30):
    df = spark.range((180 // step) * (360 // step) * 3).select((F.col("id") % 3).cast("int").alias("time"), (F.floor(F.col("id") / 3) % (180 // step) * step - 90 + step / 2).cast("double").alias("lat"), (F.floor(F.col("id") / (3 * (180 // step))) * step - 180 + step / 2).cast("double").alias("lon"), F.lit(1.0).alias("first"))
    return Cube.of(df, ("time", "lat", "lon"))


def test_subsets(spark):
    cube = globe(spark)
    box = subset.subset_spatial(globe(spark, 1), "-20,-10,20,10")
    assert (len(box.labels("lon")), len(box.labels("lat"))) == (42, 22) and box.attrs["history"].startswith("Modified with subset_spatial")
    masked = subset.subset_spatial(cube, "POLYGON ((-60 -60, 60 -60, 0 60, -60 -60))").df
    assert masked.where("first IS NULL").count() > 0 and masked.where("first IS NOT NULL").count() > 0
    across = subset.subset_spatial(cube, "150,-30,-150,30")
    assert across.labels("lon") == [-165.0, -135.0, 135.0, 165.0]
    with pytest.raises(ValidationError):
        subset.subset_spatial(Cube.of(cube.df.where("lat < -60 AND lon < -100"), cube.dims), "100,40,120,60")
    with pytest.raises(ValidationError):
        subset.subset_spatial(cube, "-190,-30,0,30")
    assert subset.subset_temporal_index(cube, 1, 2).labels("time") == [1, 2]
    with pytest.raises(ValidationError):
        subset.subset_temporal(cube, "2000-01-01, 2001-01-01")
    assert subset.extract_point(cube.with_(df=cube.df.drop("time").distinct(), dims=("lat", "lon")), (16, 14)) == {"first": 1.0, "lat": 15.0, "lon": 15.0}


def test_small_operators(spark):
    t = spark.createDataFrame([(i, 0.0, float(i), 2.0) for i in range(4)], "time int, lat double, a double, b double")
    cube = Cube.of(t, ("time", "lat"))
    get = lambda c, v: [r[v] for r in c.df.orderBy("time").collect()]
    assert get(utility.normalise_vars(cube), "a_norm") == pytest.approx([0, 1 / 3, 2 / 3, 1]) and get(utility.normalise_vars(cube), "b_norm") == [None] * 4
    assert get(utility.standardise_vars(cube), "b_stand") == [None] * 4 and sum(get(utility.standardise_vars(cube), "a_stand")) == pytest.approx(0)
    assert get(arithmetics.arithmetics(cube, "log, +1"), "a")[0] is None and get(arithmetics.arithmetics(cube, "/0"), "a") == [None] * 4
    with pytest.raises(ValidationError):
        arithmetics.arithmetics(cube, "sqrt")
    zero = arithmetics.diff(cube, cube)
    assert get(zero, "a") == [0.0] * 4
    assert sorted(get(arithmetics.diff(cube, Cube.of(t.where("time = 1"), ("time", "lat"))), "a")) == [-1, 0, 1, 2]
    assert list(select.select_var(cube, "z*").vars) == [] and list(select.select_var(cube, "").vars) == ["a", "b"]
    assert outliers.detect_outliers(cube, "a", 0.0, 0.9).df.where("a IS NULL").count() == 2
    mask = outliers.detect_outliers(cube, "a", mask=True)
    assert mask.vars["a"]["ancillary_variables"] == "a_outlier_mask" and [r[0] for r in mask.df.orderBy("time").select("a_outlier_mask").collect()] == [1, 0, 0, 1]
    with pytest.raises(ValidationError):
        utility.merge(cube, cube.on(t.withColumn("a", F.col("a") + 1)))
    with pytest.raises(ValidationError):
        utility.merge(cube, cube.on(t.where("time > 0")), join="exact")
    assert anomaly.anomaly_internal(cube).df.agg(F.sum("a")).first()[0] == pytest.approx(0)
    spec = timeseries.fourier_analysis(cube.select(["a"])).df.orderBy("k").collect()
    assert sum(r["a_ampl"] ** 2 for r in spec) == pytest.approx(sum(x * x for x in range(4)) / 4)
    corr = correlation.pairwise_var_correlation(cube, cube).df.first()
    assert corr["corr_a_a"] == pytest.approx(1) and corr["corr_a_b"] is None


def test_normal_form(spark):
    df = spark.createDataFrame([(350.0, 10.0, 1.0), (10.0, 10.0, 2.0), (10.0, 20.0, 2.0)], "longitude double, latitude double, v double")
    cube = normalize.normalize(Cube.of(df, ("longitude", "latitude"), attrs={"time_coverage_start": "2000-01-01", "time_coverage_end": "2000-01-03"}))
    assert cube.dims == ("time", "lat", "lon") and cube.labels("lon") == [-10.0, 10.0] and cube.labels("time") == [datetime(2000, 1, 2)]
    julian = Cube.of(spark.createDataFrame([(2451544.5, 0.0, 1.0)], "time double, lat double, v double"), ("time", "lat"))
    assert normalize.normalize(julian).labels("time") == [datetime(2000, 1, 1)]
    months = Cube.of(spark.createDataFrame([(datetime(2000, m, 1), 1.0) for m in range(1, 13)], "time timestamp_ntz, v double"), ("time",))
    attrs = normalize.adjust_temporal_attrs(months).attrs
    assert attrs["time_coverage_resolution"] == "P1M" and attrs["time_coverage_duration"] == "P336D"


@pytest.mark.parametrize("alias", ["W", "MS", "QS-DEC", "QS-JUN", "8MS", "8D", "YS", "2W", "h"])
def test_bins_equal_pandas(spark, alias):
    times = pd.date_range("2000-01-05", "2000-12-31", freq="D")
    df = spark.createDataFrame([(t.to_pydatetime(), 1.0) for t in times], "time timestamp_ntz, v double")
    if alias == "h":
        df, times = df.limit(3), times[:3]
    got = {r["time"]: r["v"] for r in aggregate.temporal_aggregation(Cube.of(df, ("time",)), "sum", alias).df.collect()}
    want = pd.Series(1.0, index=times).resample(alias).sum()
    if alias == "2W":  # the number of weeks before the first label differs; sums do not
        assert sum(got.values()) == want.sum()
    else:
        assert got == {k.to_pydatetime(): v for k, v in want.items()}
