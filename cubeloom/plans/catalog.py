"""A query for each operator over the test tables, with SQL that must give the same rows. Doubles are rounded in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import geometry as g
from ..functions.query_parser import parse_query
from ..operators import aggregate, alignment, anomaly, arithmetics, correlation, data_frame, gapfilling, normalize, outliers, plotdata, regions, resampling, select, subset, timeseries, utility
from ..shipping import scratch
from ..sources import zarr
from ..streaming.windows import windowed_statistics
from .chain import execute_operations, new_expression_op
from .registry import query

EV = "(SELECT ts AS time, CAST((user_id % 30) * 6 - 87 AS DOUBLE) AS lat, CAST((event_id % 60) * 6 - 177 AS DOUBLE) AS lon, value FROM events)"
LI = "(SELECT l_shipdate AS time, CAST((l_suppkey % 30) * 6 - 87 AS DOUBLE) AS lat, CAST((l_partkey % 60) * 6 - 177 AS DOUBLE) AS lon, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
GRID = "(SELECT CAST((p_partkey % 2000) // 50 AS INTEGER) AS iy, CAST(p_partkey % 50 AS INTEGER) AS ix, avg(p_retailprice) AS v FROM part GROUP BY 1, 2)"
SIZES = "(SELECT CAST((p_partkey % 2000) // 50 AS INTEGER) AS iy, CAST(p_partkey % 50 AS INTEGER) AS ix, CAST(max(p_size) % 4 AS DOUBLE) AS v FROM part GROUP BY 1, 2)"
PTS = "(SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 53) % 180 - 90 AS DOUBLE) AS lat FROM supplier)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(df: DataFrame, key: str, n: int, step: int, low: int) -> F.Column:
    return ((F.col(key) % n) * step + low).cast("double")


def ev(spark: SparkSession, sf_dir: str) -> Cube:
    e = table(spark, sf_dir, "events")
    df = e.select(F.col("ts").alias("time"), place(e, "user_id", 30, 6, -87).alias("lat"), place(e, "event_id", 60, 6, -177).alias("lon"), "value")
    return Cube.of(df, ("time", "lat", "lon"))


def li(spark: SparkSession, sf_dir: str, *names: str) -> Cube:
    e = table(spark, sf_dir, "lineitem")
    df = e.select(F.col("l_shipdate").alias("time"), place(e, "l_suppkey", 30, 6, -87).alias("lat"), place(e, "l_partkey", 60, 6, -177).alias("lon"), *(names or ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return Cube.of(df, ("time", "lat", "lon"))


def cells(spark: SparkSession, sf_dir: str, value: F.Column) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 2000
    return p.groupBy(F.floor(k / 50).cast("int").alias("iy"), (F.col("p_partkey") % 50).cast("int").alias("ix")).agg(value.alias("v"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, F.avg("p_retailprice"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, (F.max("p_size") % 4).cast("double"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    df = s.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", ((F.col("s_suppkey") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("s_suppkey") * 53) % 180 - 90).cast("double").alias("lat"))
    return data_frame.as_geodataframe(df)


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, range of time, box, month bins, weighted mean: one plan."""
    part = subset.subset_spatial(subset.subset_temporal(ev(spark, sf_dir), "2024-01-02, 2024-01-28"), "-120,-60,120,60")
    return timeseries.tseries_mean(aggregate.temporal_aggregation(part, "mean", "MS")).df


@query(f"""SELECT month AS time, round(sum(v * w) / sum(w), 6) AS value_mean, round(sqrt(greatest(sum(v * v * w) / sum(w) - (sum(v * w) / sum(w)) ^ 2, 0)), 6) AS value_std
FROM (SELECT date_trunc('month', time)::TIMESTAMP AS month, lat, lon, avg(value) AS v, cos(radians(lat)) AS w FROM {EV}
      WHERE time BETWEEN '2024-01-02' AND '2024-01-28 23:59:59' AND lat BETWEEN -63 AND 63 AND lon BETWEEN -123 AND 123 GROUP BY ALL) GROUP BY month""")
def monthly_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(flagship(spark, sf_dir))


@query(f"SELECT time, lat, lon, l_discount, l_tax FROM {LI}")
def select_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_var(li(spark, sf_dir), "l_disc*, l_tax").df


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_features(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100 AND (c_nationkey IN (1, 2, 3) OR NOT c_mktsegment = 'BUILDING') AND c_acctbal / 2 < 4000")
def query_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.query(table(spark, sf_dir, "customer"), "c_acctbal > 100 and (c_nationkey in [1, 2, 3] or not c_mktsegment == 'BUILDING') and c_acctbal / 2 < 4000").select("c_custkey", "c_acctbal")


@query(f"SELECT s_suppkey, lon, lat FROM {PTS} WHERE lat > 0 AND lat < 60 AND lon - lat / 2 > -30 AND lon + lat / 2 < 90 AND s_acctbal > 0")
def query_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.query(pts(spark, sf_dir), "@within('POLYGON ((-30 0, 90 0, 60 60, 0 60, -30 0))') and s_acctbal > 0").select("s_suppkey", "lon", "lat")


@query(f"SELECT s_suppkey FROM {PTS} WHERE lon BETWEEN -50 AND 50 AND lat BETWEEN -40 AND 40")
def query_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.query(pts(spark, sf_dir), "@intersects('-50,-40,50,40')").select("s_suppkey")


@query(f"SELECT s_suppkey FROM {PTS} WHERE NOT (lon BETWEEN -50 AND 50 AND lat BETWEEN -40 AND 40)")
def query_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.query(pts(spark, sf_dir), "@disjoint('-50,-40,50,40')").select("s_suppkey")


@query(f"SELECT s_name, s_acctbal FROM {PTS} WHERE lon BETWEEN 0 AND 100 AND lat BETWEEN -10 AND 80")
def data_frame_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.data_frame_subset(pts(spark, sf_dir), "intersects", "0,-10,100,80", "s_name, s_acct*").drop("geometry")


@query(f"SELECT time, lat, lon, value FROM {EV} WHERE time >= '2024-01-05' AND time <= '2024-01-10 23:59:59'")
def subset_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.subset_temporal(ev(spark, sf_dir), "2024-01-05, 2024-01-10").df


@query(f"SELECT time, lat, lon, l_tax FROM {LI} WHERE time IN (SELECT time FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS k FROM (SELECT DISTINCT time FROM {LI})) WHERE k BETWEEN 10 AND 40)")
def subset_temporal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.subset_temporal_index(li(spark, sf_dir, "l_tax"), 10, 40).df


@query(f"SELECT time, lat, lon, value FROM {EV} WHERE lat BETWEEN -13 AND 13 AND lon BETWEEN -23 AND 23")
def subset_spatial_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.subset_spatial(ev(spark, sf_dir), "-20,-10,20,10").df


@query(f"""SELECT time, lat, lon, CASE WHEN {" OR ".join(f"(lat + {b} >= 0 AND lat + {b} <= 60 AND lon + {a} - (lat + {b}) >= -30 AND lon + {a} + (lat + {b}) <= 90)" for a in (-3, 3) for b in (-3, 3))} THEN value END AS value
FROM {EV} WHERE lat BETWEEN -3 AND 63 AND lon BETWEEN -33 AND 93""")
def subset_spatial_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.subset_spatial(ev(spark, sf_dir), "POLYGON ((-30 0, 90 0, 30 60, -30 0))", True).df


@query(f"SELECT time, lat, lon, value FROM {EV} WHERE lat BETWEEN -13 AND 13 AND (lon >= 147 OR lon <= -147)")
def subset_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.subset_spatial(ev(spark, sf_dir), "150,-10,-150,10").df


@query(f"SELECT time, lat, lon, CASE WHEN value > (SELECT quantile_cont(value, 0.05) FROM events) AND value < (SELECT quantile_cont(value, 0.95) FROM events) THEN value END AS value FROM {EV}")
def detect_outliers_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect_outliers(ev(spark, sf_dir), "value").df


@query(f"SELECT time, lat, lon, CASE WHEN value > 20 AND value < 300 THEN value END AS value FROM {EV}")
def detect_outliers_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect_outliers(ev(spark, sf_dir), "value", 20.0, 300.0, False).df


@query(f"SELECT time, lat, lon, value, CAST(CASE WHEN value > 20 AND value < 300 THEN 0 ELSE 1 END AS TINYINT) AS value_outlier_mask FROM {EV}")
def outlier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect_outliers(ev(spark, sf_dir), "value", 20.0, 300.0, False, True).df


@query(f"SELECT time, lat, lon, CASE WHEN value > 100 THEN value END AS value FROM {EV}")
def where_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.where(ev(spark, sf_dir), "value > 100").df


@query(f"SELECT lat, lon, round(avg(value), 6) AS value FROM {EV} GROUP BY lat, lon")
def reduce_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False).df)


@query(f"""SELECT time, round(avg(l_quantity), 6) AS l_quantity FROM (SELECT time, lon, sum(l_quantity * cos(radians(lat))) / sum(cos(radians(lat))) AS l_quantity FROM {LI} GROUP BY time, lon) GROUP BY time""")
def reduce_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(aggregate.reduce(li(spark, sf_dir, "l_quantity"), dim="lat, lon").df)


@query(f"SELECT lat, median(value) AS value FROM {EV} GROUP BY lat")
def reduce_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.reduce(ev(spark, sf_dir), dim="time, lon", method="median").df


@query(f"SELECT lon, sum(l_quantity) AS l_quantity FROM {LI} GROUP BY lon")
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.reduce(li(spark, sf_dir, "l_quantity"), dim="time, lat", method="sum", apply_spatial_weighting=False).df


@query(f"SELECT lat, min(value) AS value FROM {EV} GROUP BY lat")
def reduce_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.reduce(ev(spark, sf_dir), dim="time, lon", method="min").df


@query(f"SELECT max(value) AS value FROM {EV}")
def reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.reduce(ev(spark, sf_dir), method="max").df


@query(f"""SELECT lat, count(*) FILTER (WHERE l_discount <> 0 OR l_discount IS NULL) AS l_discount_count, round(avg(l_discount), 6) AS l_discount_mean, round(median(l_discount), 6) AS l_discount_median,
round(sum(l_discount), 4) AS l_discount_sum, round(stddev_pop(l_discount), 6) AS l_discount_std, min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max FROM {LI} GROUP BY lat""")
def statistics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate.statistics(li(spark, sf_dir, "l_discount"), dim="time, lon", methods="count, mean, median, sum, std, min, max", apply_spatial_weighting=False).sides[("lat",)]
    return r(df).withColumn("l_discount_sum", F.round("l_discount_sum", 4))


@query(f"""WITH inner_ AS (SELECT time, lon, sum(v * w) / sum(w) AS m, sum(v * w) AS s, sqrt(greatest(sum(v * v * w) / sum(w) - (sum(v * w) / sum(w)) ^ 2, 0)) AS d
  FROM (SELECT time, lon, l_quantity AS v, cos(radians(lat)) AS w FROM {LI}) GROUP BY time, lon)
SELECT round(avg(m), 6) AS l_quantity_mean, round(sum(s), 2) AS l_quantity_sum, round(stddev_pop(d), 6) AS l_quantity_std, (SELECT max(l_quantity) FROM lineitem) AS l_quantity_max FROM inner_""")
def statistics_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = r(aggregate.statistics(li(spark, sf_dir, "l_quantity"), methods="mean, sum, std, max").sides[()])
    return df.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2))


@query("SELECT count(s_acctbal) AS s_acctbal_count, round(avg(s_acctbal), 6) AS s_acctbal_mean, median(s_acctbal) AS s_acctbal_median, round(sum(s_acctbal), 2) AS s_acctbal_sum, round(stddev_samp(s_acctbal), 6) AS s_acctbal_std, min(s_acctbal) AS s_acctbal_min, max(s_acctbal) AS s_acctbal_max FROM supplier")
def aggregate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(data_frame.aggregate_statistics(table(spark, sf_dir, "supplier"), "s_acctbal")).withColumn("s_acctbal_sum", F.round("s_acctbal_sum", 2))


def _resolved(cube: Cube, resolution: str) -> Cube:
    return cube.with_(attrs={**cube.attrs, "time_coverage_resolution": resolution})


@query(f"SELECT make_date((SELECT CAST(year(min(time)) AS INTEGER) FROM {LI}), CAST(month(time) AS INTEGER), 1)::TIMESTAMP AS time, lat, lon, round(avg(l_quantity), 6) AS l_quantity FROM {LI} GROUP BY 1, 2, 3")
def climatology_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(aggregate.climatology(_resolved(li(spark, sf_dir, "l_quantity"), "P1M")).df)


@query(f"SELECT CAST(dayofyear(time) AS INTEGER) AS dayofyear, lat, lon, round(avg(l_quantity), 6) AS l_quantity FROM {LI} GROUP BY 1, 2, 3")
def climatology_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(aggregate.climatology(_resolved(li(spark, sf_dir, "l_quantity"), "P1D")).df)


@query(f"""WITH q AS (SELECT (date_trunc('quarter', time + INTERVAL 1 MONTH) - INTERVAL 1 MONTH)::TIMESTAMP AS time, avg(l_quantity) AS v FROM {LI} GROUP BY 1),
years AS (SELECT year(time) AS y, count(DISTINCT time) AS n FROM q GROUP BY 1 ORDER BY y LIMIT 2),
model AS (SELECT CAST(CASE WHEN max(n) FILTER (WHERE y = (SELECT max(y) FROM years)) > max(n) FILTER (WHERE y = (SELECT min(y) FROM years)) THEN max(y) ELSE min(y) END AS INTEGER) AS y FROM years)
SELECT make_date((SELECT y FROM model), CAST(month(time) AS INTEGER), CAST(day(time) AS INTEGER))::TIMESTAMP AS time, round(avg(v), 6) AS l_quantity FROM q GROUP BY 1""")
def climatology_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = aggregate.temporal_aggregation(Cube.of(li(spark, sf_dir, "l_quantity").df.select("time", "l_quantity"), ("time",)), "mean", "QS-DEC")
    return r(aggregate.climatology(_resolved(seasons, "P3M")).df)


_BIN = {"mean": "avg(v)", "max": "max(v)", "median": "median(v)", "sum": "sum(v)", "std": "stddev_pop(v)", "var": "var_pop(v)", "first": "arg_min(v, time)", "last": "arg_max(v, time)", "min": "min(v)"}
_DAILY = f"(SELECT date_trunc('day', time)::TIMESTAMP AS time, lat, avg(l_quantity) AS v FROM {LI} GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> Cube:
    cube = li(spark, sf_dir, "l_quantity")
    df = cube.df.groupBy(F.date_trunc("DAY", "time").cast("timestamp_ntz").alias("time"), "lat").agg(F.avg("l_quantity").alias("v"))
    return Cube.of(df, ("time", "lat"))


def _binned(method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return r(aggregate.temporal_aggregation(daily(spark, sf_dir), method, "MS").df)

    run.__name__ = f"temporal_agg_MS_{method}"
    # months without data, of which there are none at the tested sizes, would have a row for each latitude
    query(f"SELECT date_trunc('month', time)::TIMESTAMP AS time, lat, round({_BIN[method]}, 6) AS v FROM {_DAILY} GROUP BY 1, 2")(run)


for _m in _BIN:
    _binned(_m)


@query(f"SELECT date_trunc('month', time)::TIMESTAMP AS time, lat, round(exp(sum(ln(1 + v / 1000))), 6) AS v FROM {_DAILY} GROUP BY 1, 2")
def temporal_agg_MS_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(aggregate.temporal_aggregation(arithmetics.arithmetics(daily(spark, sf_dir), "/1000, +1"), "prod", "MS").df)


def _arg(best: str) -> str:
    return f"""WITH axis AS (SELECT time, row_number() OVER (PARTITION BY date_trunc('month', time) ORDER BY time) - 1 AS k FROM (SELECT DISTINCT time FROM {_DAILY})),
ranked AS (SELECT d.*, a.k, row_number() OVER (PARTITION BY date_trunc('month', d.time), lat ORDER BY v {best}, d.time) AS r FROM {_DAILY} d JOIN axis a ON d.time = a.time)
SELECT date_trunc('month', time)::TIMESTAMP AS time, lat, k AS v FROM ranked WHERE r = 1"""


@query(_arg("DESC"))
def temporal_agg_MS_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.temporal_aggregation(daily(spark, sf_dir), "argmax", "MS").df


@query(_arg("ASC"))
def temporal_agg_MS_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.temporal_aggregation(daily(spark, sf_dir), "argmin", "MS").df


def _periods(period: str, label: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return r(aggregate.temporal_aggregation(daily(spark, sf_dir), "mean", period).df)

    run.__name__ = f"temporal_agg_{period.replace('-', '_')}"
    query(f"WITH d AS {_DAILY}, t AS (SELECT min(time) AS t0 FROM d) SELECT {label} AS time, lat, round(avg(v), 6) AS v FROM d, t GROUP BY 1, 2")(run)


_K = "(year(time) * 12 + month(time) - 1)"
_periods("QS-DEC", "(date_trunc('quarter', time + INTERVAL 1 MONTH) - INTERVAL 1 MONTH)::TIMESTAMP")
_periods("QS-JUN", "(date_trunc('quarter', time + INTERVAL 1 MONTH) - INTERVAL 1 MONTH)::TIMESTAMP")
_periods("8D", "(t0::DATE + CAST((time::DATE - t0::DATE) // 8 * 8 AS INTEGER))::TIMESTAMP")
_periods("W", "(time::DATE + CAST((7 - isodow(time)) AS INTEGER))::TIMESTAMP")
_periods("YS", "date_trunc('year', time)::TIMESTAMP")
_periods("8MS", "make_date(CAST(((year(t0) * 12 + month(t0) - 1) + (" + _K + " - (year(t0) * 12 + month(t0) - 1)) // 8 * 8) // 12 AS INTEGER), CAST(((year(t0) * 12 + month(t0) - 1) + (" + _K + " - (year(t0) * 12 + month(t0) - 1)) // 8 * 8) % 12 + 1 AS INTEGER), 1)::TIMESTAMP")


@query(f"""SELECT time, round(sum(value * w) / sum(w), 6) AS value_mean, round(sqrt(greatest(sum(value * value * w) / sum(w) - (sum(value * w) / sum(w)) ^ 2, 0)), 4) AS value_std
FROM (SELECT date_trunc('day', time)::TIMESTAMP AS time, value, cos(radians(lat)) AS w FROM {EV}) GROUP BY time""")
def tseries_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ev(spark, sf_dir)
    cube = cube.on(cube.df.withColumn("time", F.date_trunc("DAY", "time").cast("timestamp_ntz")))
    df = timeseries.tseries_mean(cube).df
    return df.select("time", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 4).alias("value_std"))


@query(f"SELECT time, value FROM {EV} WHERE lat = 9 AND lon = -39")
def tseries_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.tseries_point(ev(spark, sf_dir), "-40.5, 10.2").df


@query(f"SELECT round(avg(value), 3) AS value, CAST(9 AS DOUBLE) AS lat, CAST(-39 AS DOUBLE) AS lon FROM {EV} WHERE lat = 9 AND lon = -39 GROUP BY lat, lon")
def extract_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False)
    found = subset.extract_point(cube, (-40.5, 10.2))
    rows = [(found["value"], found["lat"], found["lon"])] if found else []
    return r(spark.createDataFrame(rows, "value double, lat double, lon double"), 3)


_LIAVG = f"(SELECT time, lat, lon, avg(l_quantity) AS v FROM {LI} GROUP BY 1, 2, 3)"


def averaged(spark: SparkSession, sf_dir: str) -> Cube:
    cube = li(spark, sf_dir, "l_quantity")
    return Cube.of(cube.df.groupBy("time", "lat", "lon").agg(F.avg("l_quantity").alias("v")), cube.dims)


@query(f"SELECT a.time, a.lat, a.lon, round(a.v - b.v, 6) AS v FROM {_LIAVG} a JOIN (SELECT * FROM {_LIAVG} WHERE lat > 0) b USING (time, lat, lon)")
def diff_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = averaged(spark, sf_dir)
    return r(arithmetics.diff(a, a.on(a.df.where("lat > 0"))).df)


@query(f"SELECT a.time, a.lat, a.lon, round(a.v - b.v, 6) AS v FROM {_LIAVG} a JOIN (SELECT lat, lon, avg(v) AS v FROM {_LIAVG} GROUP BY 1, 2) b USING (lat, lon)")
def diff_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = averaged(spark, sf_dir)
    return r(arithmetics.diff(a, aggregate.reduce(a, dim="time", apply_spatial_weighting=False)).df)


@query(f"""WITH d AS (SELECT *, dense_rank() OVER (ORDER BY time) AS k FROM {_DAILY})
SELECT CAST(a.k AS INTEGER) AS time_index, a.lat, round(a.v - b.v * 2, 6) AS v FROM d a JOIN d b ON a.k = b.k AND a.lat = b.lat""")
def diff_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = daily(spark, sf_dir)
    b = a.on(a.df.select((F.col("time") + F.expr("INTERVAL 20 YEARS")).alias("time"), "lat", (F.col("v") * 2).alias("v")))
    return r(arithmetics.diff(a, b).df)


def _merged(kind: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = averaged(spark, sf_dir)
        b = Cube.of(a.df.where("lat > -30").select("time", "lat", "lon", (F.col("v") + 1).alias("w")), a.dims)
        return r(utility.merge(a.on(a.df.where("lat < 30")), b, join=kind).df)

    run.__name__ = f"merge_{kind}"
    query(f"SELECT time, lat, lon, round(v, 6) AS v, round(w, 6) AS w FROM (SELECT * FROM {_LIAVG} WHERE lat < 30) a {sql} JOIN (SELECT time, lat, lon, v + 1 AS w FROM {_LIAVG} WHERE lat > -30) b USING (time, lat, lon)")(run)


for _k, _s in (("outer", "FULL"), ("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT")):
    _merged(_k, _s)


@query(f"SELECT time, lat, lon, round(value - (SELECT avg(m) FROM (SELECT time, lon, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS m FROM {EV} GROUP BY 1, 2)), 5) AS value FROM {EV}")
def anomaly_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(anomaly.anomaly_internal(ev(spark, sf_dir)).df, 5)


@query(f"WITH m AS (SELECT date_trunc('month', time)::TIMESTAMP AS time, lat, avg(v) AS v FROM {_DAILY} GROUP BY 1, 2), c AS (SELECT month(time) AS k, lat, avg(v) AS v FROM m GROUP BY 1, 2) SELECT m.time, m.lat, round(m.v - c.v, 6) AS v FROM m JOIN c ON month(m.time) = c.k AND m.lat = c.lat")
def anomaly_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _resolved(aggregate.temporal_aggregation(daily(spark, sf_dir), "mean", "MS"), "P1M")
    return r(anomaly.anomaly_external(months, aggregate.climatology(months)).df)


@query(f"SELECT time, lat, lon, round(exp(CASE WHEN value + 1 > 0 THEN log10(value + 1) END * 2) / 3 - 4, 6) AS value FROM {EV}")
def arithmetics_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(arithmetics.arithmetics(ev(spark, sf_dir), "+1, log10, *2, exp, /3, -4").df)


_RANGE = "OVER (PARTITION BY lat)"


@query(f"SELECT time, lat, v, round((v - (SELECT min(v) FROM {_DAILY})) / nullif(max(v) {_RANGE} - min(v) {_RANGE}, 0), 6) AS v_norm FROM {_DAILY}")
def normalise_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = utility.normalise_vars(daily(spark, sf_dir)).df
    return df.withColumn("v_norm", F.round("v_norm", 6))


@query(f"SELECT time, lat, v, round((v - avg(v) {_RANGE}) / nullif(stddev_pop(v) {_RANGE}, 0), 6) AS v_stand FROM {_DAILY}")
def standardise_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = utility.standardise_vars(daily(spark, sf_dir)).df
    return df.withColumn("v_stand", F.round("v_stand", 6))


@query(f"""WITH a AS (SELECT time, lat, lon, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM {LI} GROUP BY 1, 2, 3), b AS (SELECT time, lat, lon, avg(l_tax) AS t FROM {LI} GROUP BY 1, 2, 3)
SELECT lat, lon, round(covar_pop(q, t) / nullif(stddev_pop(q) * stddev_pop(t), 0), 6) AS corr_q_t, round(covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0), 6) AS corr_p_t FROM a JOIN b USING (time, lat, lon) GROUP BY lat, lon""")
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = li(spark, sf_dir).df
    by = df.groupBy("time", "lat", "lon")
    a = Cube.of(by.agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p")), ("time", "lat", "lon"))
    b = Cube.of(by.agg(F.avg("l_tax").alias("t")), ("time", "lat", "lon"))
    return r(correlation.pairwise_var_correlation(a, b).df)


@query(f"""WITH s AS (SELECT lat, row_number() OVER (PARTITION BY lat ORDER BY time) - 1 AS n, count(*) OVER (PARTITION BY lat) AS size, v FROM (SELECT date_trunc('day', time) AS time, lat, avg(value) AS v FROM {EV} GROUP BY 1, 2)),
k AS (SELECT lat, n AS k FROM s)
SELECT lat, k, round(sqrt(sum(v * cos(2 * pi() * k * n / size)) ^ 2 + sum(v * sin(2 * pi() * k * n / size)) ^ 2) / any_value(size), 5) AS v_ampl FROM s JOIN k USING (lat) GROUP BY lat, k""")
def fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ev(spark, sf_dir)
    df = cube.df.groupBy(F.date_trunc("DAY", "time").cast("timestamp_ntz").alias("time"), "lat").agg(F.avg("value").alias("v"))
    return r(timeseries.fourier_analysis(Cube.of(df, ("time", "lat")), compute_frequencies=False).df.select("lat", "k", "v_ampl"), 5)


def _axis(name: str, source: int, out: int) -> str:
    scale = source / out
    return f"{name} AS (SELECT CAST(o AS INTEGER) AS o, CAST(s AS INTEGER) AS s, least(s + 1, (o + 1) * {scale}) - greatest(s, o * {scale}) AS w FROM range({out}) a(o), range({source}) b(s) WHERE least(s + 1, (o + 1) * {scale}) - greatest(s, o * {scale}) > 1e-9)"


def _down(method: str, value: str, out: tuple[int, int] = (16, 20), grid: str = GRID) -> str:
    return f"WITH {_axis('y', 40, out[0])}, {_axis('x', 50, out[1])}, m AS (SELECT y.o AS iy, x.o AS ix, v, y.w * x.w AS w, g.iy * 50 + g.ix AS k FROM {grid} g JOIN y ON g.iy = y.s JOIN x ON g.ix = x.s) SELECT iy, ix, {value} AS v FROM m GROUP BY iy, ix"


@query(_down("mean", "round(sum(w * v) / sum(w), 6)"))
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(resampling.downsample_2d(prices(spark, sf_dir), (40, 50), (16, 20), "mean"))


@query(_down("var", "round(greatest((sum(w * v * v) * sum(w) - sum(w * v) ^ 2) / sum(w) ^ 2, 0), 3)"))
def downsample_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(resampling.downsample_2d(prices(spark, sf_dir), (40, 50), (16, 20), "var"), 3)


@query(_down("std", "round(sqrt(greatest((sum(w * v * v) * sum(w) - sum(w * v) ^ 2) / sum(w) ^ 2, 0)), 3)"))
def downsample_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(resampling.downsample_2d(prices(spark, sf_dir), (40, 50), (16, 20), "std"), 3)


@query(_down("first", "arg_min(v, k)"))
def downsample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.downsample_2d(prices(spark, sf_dir), (40, 50), (16, 20), "first")


@query(_down("last", "arg_max(v, k)"))
def downsample_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.downsample_2d(prices(spark, sf_dir), (40, 50), (16, 20), "last")


@query(f"WITH {_axis('y', 40, 16)}, {_axis('x', 50, 20)}, m AS (SELECT y.o AS iy, x.o AS ix, v, sum(y.w * x.w) AS n, min(g.iy * 50 + g.ix) AS k FROM {SIZES} g JOIN y ON g.iy = y.s JOIN x ON g.ix = x.s GROUP BY 1, 2, 3) SELECT iy, ix, v FROM m QUALIFY row_number() OVER (PARTITION BY iy, ix ORDER BY round(n, 9) DESC, k) = 1")
def downsample_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.downsample_2d(sizes(spark, sf_dir), (40, 50), (16, 20), "mode")


@query(f"SELECT CAST(a.o AS INTEGER) AS iy, CAST(b.o AS INTEGER) AS ix, v FROM {GRID} g, range(100) a(o), range(80) b(o) WHERE g.iy = floor(40 / 100.0 * a.o) AND g.ix = floor(50 / 80.0 * b.o)")
def upsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.upsample_2d(prices(spark, sf_dir), (40, 50), (100, 80), "nearest")


@query(f"""WITH g AS (SELECT iy, ix, coalesce(v, 0) AS v FROM (SELECT CAST(a.i AS INTEGER) AS iy, CAST(b.i AS INTEGER) AS ix FROM range(40) a(i), range(50) b(i)) LEFT JOIN {GRID} USING (iy, ix)),
y AS (SELECT o, CAST(floor(39 / 99.0 * o) AS INTEGER) AS i, 39 / 99.0 * o - floor(39 / 99.0 * o) AS t FROM range(99) a(o)), x AS (SELECT o, CAST(floor(49 / 79.0 * o) AS INTEGER) AS i, 49 / 79.0 * o - floor(49 / 79.0 * o) AS t FROM range(79) a(o))
SELECT CAST(y.o AS INTEGER) AS iy, CAST(x.o AS INTEGER) AS ix, round((1 - y.t) * ((1 - x.t) * a.v + x.t * b.v) + y.t * ((1 - x.t) * c.v + x.t * d.v), 6) AS v
FROM y, x, g a, g b, g c, g d WHERE a.iy = y.i AND a.ix = x.i AND b.iy = y.i AND b.ix = x.i + 1 AND c.iy = y.i + 1 AND c.ix = x.i AND d.iy = y.i + 1 AND d.ix = x.i + 1""")
def upsample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.range(2000).select(F.floor(F.col("id") / 50).cast("int").alias("iy"), (F.col("id") % 50).cast("int").alias("ix"))
    full = every.join(prices(spark, sf_dir), ["iy", "ix"], "left").fillna(0.0, ["v"])
    return r(resampling.upsample_2d(full, (40, 50), (100, 80), "linear").where("iy < 99 AND ix < 79"))


_GLOBE = f"(SELECT lat, lon, avg(value) AS value FROM {EV} GROUP BY 1, 2)"


@query(f"SELECT floor((lat + 90) / 12) * 12 - 84 AS lat, floor((lon + 180) / 12) * 12 - 174 AS lon, round(avg(value), 6) AS value FROM {_GLOBE} GROUP BY 1, 2")
def coregister(spark: SparkSession, sf_dir: str) -> DataFrame:
    replica = aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False)
    lat, lon = resampling.centres(-90, 90, 15), resampling.centres(-180, 180, 30)
    primary = Cube.of(spark.createDataFrame([(a, b, 0.0) for a in lat for b in lon], "lat double, lon double, p double"), ("lat", "lon"))
    return r(resampling.coregister(primary, replica).df)


@query(f"SELECT floor((lat + 90) / 12) * 12 - 84 AS lat, floor((lon + 180) / 12) * 12 - 174 AS lon, max(value) AS value FROM {_GLOBE} GROUP BY 1, 2")
def resample_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False)
    return resampling.resample(cube, 12.0, 12.0, downsampling_float="max").df


def _steps(spark: SparkSession, first: str, last: str, step: str, shift: str) -> Cube:
    df = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval {step})")).alias("t"))
    return Cube.of(df.select((F.col("t") + F.expr(f"interval {shift}")).alias("time"), F.lit(0.0).alias("p")), ("time",))


_MIDDAY = f"(SELECT date_trunc('day', time)::TIMESTAMP + INTERVAL 12 HOUR AS time, lat, avg(value) AS v FROM {EV} GROUP BY 1, 2)"


def midday(spark: SparkSession, sf_dir: str) -> Cube:
    cube = ev(spark, sf_dir)
    df = cube.df.groupBy((F.date_trunc("DAY", "time").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("time"), "lat").agg(F.avg("value").alias("v"))
    return Cube.of(df, ("time", "lat"))


@query(f"""WITH d AS (SELECT time + INTERVAL 12 HOUR AS time, lat, v FROM {_DAILY}), m AS (SELECT date_trunc('month', time)::TIMESTAMP AS month, lat, avg(v) AS v FROM d GROUP BY 1, 2),
steps AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month)
SELECT month + INTERVAL 15 DAY AS time, lat, round(v, 6) AS v FROM steps CROSS JOIN (SELECT DISTINCT lat FROM d) LEFT JOIN m USING (month, lat)""")
def temporal_alignment_down_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir)
    replica = days.on(days.df.withColumn("time", F.col("time") + F.expr("interval 12 hours")))
    first, last = (f"{t:%Y-%m}-01" for t in replica.extent("time"))
    return r(alignment.temporal_alignment(_steps(spark, first, last, "1 month", "15 days"), replica).df)


@query(f"SELECT TIMESTAMP '2024-01-03 12:00:00' + INTERVAL 5 DAY * CAST(floor(epoch(time - TIMESTAMP '2024-01-01 12:00:00') / 432000) AS INTEGER) AS time, lat, round(avg(v), 6) AS v FROM {_MIDDAY} WHERE time < '2024-01-26' GROUP BY 1, 2")
def temporal_alignment_down_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(alignment.temporal_alignment(_steps(spark, "2024-01-01", "2024-01-21", "5 days", "60 hours"), midday(spark, sf_dir)).df)


@query(f"SELECT t AS time, lat, round(v, 6) AS v FROM {_MIDDAY} d JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 03:00:00', TIMESTAMP '2024-01-28 21:00:00', INTERVAL 6 HOUR)) AS t) s ON date_trunc('day', t) = date_trunc('day', d.time)")
def temporal_alignment_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.temporal_alignment(_steps(spark, "2024-01-02", "2024-01-28 18:00:00", "6 hours", "3 hours"), midday(spark, sf_dir), "nearest").df
    return r(found.where("v IS NOT NULL"))


_FROM = "acos(least(1, greatest(-1, sin(radians(48.0)) * sin(radians(lat)) + cos(radians(48.0)) * cos(radians(lat)) * cos(radians(lon - 11.5)))))"


@query(f"SELECT s_suppkey, round(degrees({_FROM}), 4) AS distance FROM {PTS} WHERE degrees({_FROM}) <= 120 ORDER BY degrees({_FROM}), s_suppkey LIMIT 10")
def find_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(data_frame.find_closest(pts(spark, sf_dir), "11.5, 48.0", 10, 120.0).select("s_suppkey", "distance"), 4)


@query(f"SELECT s_suppkey, round(degrees({_FROM}), 4) AS distance FROM {PTS}")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(pts(spark, sf_dir).select("s_suppkey", g.great_circle(F.lit(11.5), F.lit(48.0), F.col("lon"), F.col("lat")).alias("distance")), 4)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1")
def data_frame_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.data_frame_min(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def data_frame_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_frame.data_frame_max(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query(f"SELECT s_suppkey, round(value, 6) AS cube_value FROM {PTS} p LEFT JOIN {_GLOBE} g ON round((p.lat + 87) / 6) * 6 - 87 = g.lat AND round((p.lon + 177) / 6) * 6 - 177 = g.lon")
def add_values_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False)
    return r(data_frame.add_dataset_values_to_geodataframe(pts(spark, sf_dir), cube, var_prefix="cube_").select("s_suppkey", "cube_value"))


@query(f"""WITH g AS (SELECT iy, ix, CASE WHEN (iy * 7 + ix) % 5 <> 0 THEN v END AS v FROM {GRID}),
n AS (SELECT a.iy, a.ix, sum(k * b.v) AS s, sum(k) AS w FROM g a JOIN (VALUES (-1, -1, 0.5), (-1, 0, 0.7), (-1, 1, 0.5), (0, -1, 0.7), (0, 1, 0.7), (1, -1, 0.5), (1, 0, 0.7), (1, 1, 0.5)) o(dy, dx, k) ON true JOIN g b ON b.iy = a.iy + dy AND b.ix = a.ix + dx AND b.v IS NOT NULL GROUP BY 1, 2)
SELECT iy, ix, round(coalesce(v, CASE WHEN w >= 1 THEN s / w END), 6) AS v FROM g LEFT JOIN n USING (iy, ix)""")
def gapfill_1step(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = prices(spark, sf_dir).withColumn("v", F.when((F.col("iy") * 7 + F.col("ix")) % 5 != 0, F.col("v")))
    return r(gapfilling.fill_step(holes, []))


_ROUND = """(SELECT g.iy, g.ix, coalesce(g.v, CASE WHEN n.w >= 1 THEN n.s / n.w END) AS v FROM {0} g LEFT JOIN (
  SELECT a.iy, a.ix, sum(k * b.v) AS s, sum(k) AS w FROM {0} a
  JOIN (VALUES (-1, -1, 0.5), (-1, 0, 0.7), (-1, 1, 0.5), (0, -1, 0.7), (0, 1, 0.7), (1, -1, 0.5), (1, 0, 0.7), (1, 1, 0.5)) o(dy, dx, k) ON true
  JOIN {0} b ON b.iy = a.iy + dy AND b.ix = a.ix + dx AND b.v IS NOT NULL GROUP BY 1, 2) n USING (iy, ix))"""
_ROUNDS = 12  # more than the gaps of the queries need; a round after the last one changes nothing
_FILLED = f"WITH r0 AS (SELECT iy, ix, CASE WHEN (iy * 7 + ix * 3) % 31 < 7 THEN v END AS v FROM {GRID}), " + ", ".join(f"r{k + 1} AS {_ROUND.format(f'r{k}')}" for k in range(_ROUNDS)) + f" SELECT CAST(iy AS DOUBLE) AS lat, CAST(ix AS DOUBLE) AS lon, round(v, 6) AS v FROM r{_ROUNDS}"


def _gaps(spark: SparkSession, sf_dir: str) -> Cube:
    """Most cells are gaps, in clusters, so that filling takes several rounds."""
    holes = prices(spark, sf_dir).select(F.col("iy").cast("double").alias("lat"), F.col("ix").cast("double").alias("lon"), F.when((F.col("iy") * 7 + F.col("ix") * 3) % 31 < 7, F.col("v")).alias("v"))
    return Cube.of(holes, ("lat", "lon"))


@query(_FILLED)
def gapfill_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(gapfilling.gapfill(_gaps(spark, sf_dir)).df)


@query(_FILLED)
def gapfill_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(gapfilling.gapfill(_gaps(spark, sf_dir), tile=16, steps=2).df)


@query(f"SELECT date_trunc('day', time)::TIMESTAMP AS time, lat, lon, round(avg(value), 6) AS value FROM {EV} WHERE lat BETWEEN -30 AND 45 AND lon BETWEEN -100 AND 20 AND time >= '2024-01-05' AND time < '2024-01-20' GROUP BY 1, 2, 3")
def zarr_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a group of chunks, read back with a range of time and a box in the scan."""
    cube = ev(spark, sf_dir)
    days = Cube.of(cube.df.groupBy(F.date_trunc("DAY", "time").cast("timestamp_ntz").alias("time"), "lat", "lon").agg(F.avg("value").alias("value")), ("time", "lat", "lon"))
    path = zarr.write_zarr(days, f"{scratch(spark, 'cube')}.zarr", {"lat": 10, "lon": 20})
    df = zarr.read_zarr(spark, path, ["value"]).df
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return r(df.where((F.col("time") >= at("2024-01-05")) & (F.col("time") < at("2024-01-20")) & F.col("lat").between(-30.0, 45.0) & F.col("lon").between(-100.0, 20.0) & F.col("value").isNotNull()))


_RECT = "(SELECT c_custkey, (c_custkey * 37) % 200 - 100 AS x0, (c_custkey * 53) % 160 - 80 AS y0, (c_custkey * 37) % 200 - 100 + 10 * (1 + c_custkey % 13) AS x1, (c_custkey * 53) % 160 - 80 + 10 * (1 + c_custkey % 11) AS y1 FROM customer)"
_MEET, _INNER = "x0 <= 50 AND x1 >= -50 AND y0 <= 40 AND y1 >= -40", "x0 < 50 AND x1 > -50 AND y0 < 40 AND y1 > -40"
_TESTS = ("intersects", "disjoint", "within", "contains", "touches", "crosses")


def _placed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A rectangle or its diagonal for each customer."""
    k = F.col("c_custkey")
    x0, y0 = (k * 37) % 200 - 100, (k * 53) % 160 - 80
    x1, y1 = x0 + 10 * (1 + k % 13), y0 + 10 * (1 + k % 11)
    points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)] if kind == "Polygon" else [(x0, y0), (x1, y1)]
    coords = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))
    # keys take few bytes and few splits, and shapes much time: all cores share them
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return keys.select("c_custkey", F.struct(F.lit(kind).alias("type"), coords.alias("coords"), F.lit(None).alias("ends")).cast(g.COLUMN).alias("geometry"))


@query(f"SELECT c_custkey, {_MEET} AS intersects, NOT ({_MEET}) AS disjoint, x0 >= -50 AND x1 <= 50 AND y0 >= -40 AND y1 <= 40 AS within, x0 <= -50 AND x1 >= 50 AND y0 <= -40 AND y1 >= 40 AS contains, ({_MEET}) AND NOT ({_INNER}) AS touches, false AS crosses FROM {_RECT}")
def query_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _placed(spark, sf_dir, "Polygon")
    return df.select("c_custkey", *(parse_query(f"@{t}('POLYGON ((-50 -40, 50 -40, 50 40, -50 40, -50 -40))')", df).alias(t) for t in _TESTS))


@query(f"""WITH d AS (SELECT *, [y0 + 40, -5 * x0 - 3 * y0 + 180, 5 * x0 - 3 * y0 + 180] AS p, [y1 + 40, -5 * x1 - 3 * y1 + 180, 5 * x1 - 3 * y1 + 180] AS q FROM {_RECT}),
e AS (SELECT c_custkey,
  greatest(CASE WHEN p[1] < 0 AND q[1] >= 0 THEN p[1] / (p[1] - q[1]) ELSE 0 END, CASE WHEN p[2] < 0 AND q[2] >= 0 THEN p[2] / (p[2] - q[2]) ELSE 0 END, CASE WHEN p[3] < 0 AND q[3] >= 0 THEN p[3] / (p[3] - q[3]) ELSE 0 END) AS low,
  least(CASE WHEN q[1] < 0 AND p[1] >= 0 THEN p[1] / (p[1] - q[1]) ELSE 1 END, CASE WHEN q[2] < 0 AND p[2] >= 0 THEN p[2] / (p[2] - q[2]) ELSE 1 END, CASE WHEN q[3] < 0 AND p[3] >= 0 THEN p[3] / (p[3] - q[3]) ELSE 1 END) AS high,
  (p[1] < 0 AND q[1] < 0) OR (p[2] < 0 AND q[2] < 0) OR (p[3] < 0 AND q[3] < 0) AS off,
  (p[1] <= 0 AND q[1] <= 0) OR (p[2] <= 0 AND q[2] <= 0) OR (p[3] <= 0 AND q[3] <= 0) AS beside,
  least(p[1], q[1], p[2], q[2], p[3], q[3]) < 0 AS leaves FROM d),
t AS (SELECT *, NOT off AND low <= high AS meet, NOT beside AND low < high AS inner_ FROM e)
SELECT c_custkey, meet AS intersects, NOT meet AS disjoint, inner_ AND NOT leaves AS within, false AS contains, meet AND NOT inner_ AS touches, inner_ AND leaves AS crosses FROM t""")
def query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _placed(spark, sf_dir, "LineString")
    return df.select("c_custkey", *(parse_query(f"@{t}('POLYGON ((-60 -40, 60 -40, 0 60, -60 -40))')", df).alias(t) for t in _TESTS))


_VISITS = "(SELECT o_orderkey, o_orderdate + to_seconds(CAST((o_orderkey * 7919) % 172800 AS BIGINT)) AS seen, CAST((o_orderkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((o_custkey * 53) % 180 - 90 AS DOUBLE) AS lat FROM orders)"


@query(f"""WITH s AS (SELECT DISTINCT time AS t FROM {LI}), n AS (
  SELECT v.*, b.t AS low, a.t AS high FROM {_VISITS} v ASOF LEFT JOIN s b ON v.seen >= b.t ASOF LEFT JOIN s a ON v.seen <= a.t),
k AS (SELECT *, CASE WHEN low IS NULL OR high - seen < seen - low THEN high ELSE low END AS t FROM n)
SELECT o_orderkey, round(c.q, 6) AS l_quantity FROM k LEFT JOIN (SELECT time, lat, lon, avg(l_quantity) AS q FROM {LI} GROUP BY ALL) c
ON k.t = c.time AND round((k.lat + 87) / 6) * 6 - 87 = c.lat AND round((k.lon + 177) / 6) * 6 - 177 = c.lon""")
def add_values_nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the nearest cell and, as of each row's time, of the nearest step."""
    o = table(spark, sf_dir, "orders")
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 7919) % 172800 * 1_000_000).cast("timestamp_ntz")
    visits = o.select("o_orderkey", at.alias("at"), ((F.col("o_orderkey") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("o_custkey") * 53) % 180 - 90).cast("double").alias("lat"))
    cube = li(spark, sf_dir, "l_quantity")
    cells = Cube.of(cube.df.groupBy("time", "lat", "lon").agg(F.avg("l_quantity").alias("l_quantity")), cube.dims)
    return r(data_frame.add_dataset_values_to_geodataframe(data_frame.as_geodataframe(visits), cells, time_name="at").select("o_orderkey", "l_quantity"))


@query(f"""WITH c AS (SELECT lat, lon, avg(value) AS v FROM {EV} GROUP BY 1, 2), p AS (SELECT s_suppkey, (lat + 87) / 6 AS fy, (lon + 177) / 6 AS fx FROM {PTS}),
q AS (SELECT s_suppkey, fy BETWEEN -0.5 AND 29.5 AND fx BETWEEN -0.5 AND 59.5 AS inside, least(greatest(fy, 0), 29) AS y, least(greatest(fx, 0), 59) AS x FROM p),
w AS (SELECT s_suppkey, inside, floor(y) + a AS iy, floor(x) + b AS ix, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM q, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b)),
j AS (SELECT s_suppkey, inside, w, v FROM w LEFT JOIN c ON c.lat = iy * 6 - 87 AND c.lon = ix * 6 - 177 WHERE w > 0)
SELECT s_suppkey, CASE WHEN bool_and(inside) AND count(*) = count(v) THEN round(sum(v * w), 6) END AS value FROM j GROUP BY 1""")
def add_values_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False)
    return r(data_frame.add_dataset_values_to_geodataframe(pts(spark, sf_dir), cube, interpolation="linear").select("s_suppkey", "value"))


_MONTHS = f"(SELECT date_trunc('month', time) AS month, lat, lon, avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS x, avg(l_tax) AS y FROM {LI} GROUP BY 1, 2, 3)"


@query(f"""WITH s AS (SELECT lat, lon, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy,
  covar_pop(a, x) AS ax, covar_pop(a, y) AS ay, covar_pop(b, x) AS bx, covar_pop(b, y) AS b_y FROM {_MONTHS} GROUP BY 1, 2),
i AS (SELECT *, aa * bb - ab * ab AS d, xx * yy - xy * xy AS e FROM s),
k AS (SELECT *, (bb * ax - ab * bx) / d AS k1, (bb * ay - ab * b_y) / d AS k2, (aa * bx - ab * ax) / d AS k3, (aa * b_y - ab * ay) / d AS k4,
  (yy * ax - xy * ay) / e AS l1, (xx * ay - xy * ax) / e AS l2, (yy * bx - xy * b_y) / e AS l3, (xx * b_y - xy * bx) / e AS l4 FROM i),
m AS (SELECT *, k1 * l1 + k2 * l2 AS m1, k1 * l3 + k2 * l4 AS m2, k3 * l1 + k4 * l2 AS m3, k3 * l3 + k4 * l4 AS m4 FROM k)
SELECT lat, lon, CASE WHEN n < 2 THEN NULL WHEN n <= 3 THEN 1.0 ELSE round(sqrt(least(1, ((m1 + m4) + sqrt(greatest(0, (m1 + m4) ^ 2 - 4 * (m1 * m4 - m2 * m3)))) / 2)), 4) END AS correlation FROM m""")
def cca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means of two pairs of variables in each pixel; the SQL has the closed form of two by two."""
    df = li(spark, sf_dir).df.groupBy(F.date_trunc("MONTH", "time").cast("timestamp_ntz").alias("time"), "lat", "lon").agg(F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"), F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    cube = Cube.of(df, ("time", "lat", "lon"))
    return r(correlation.pixelwise_group_correlation(cube.select(["a", "b"]), cube.select(["x", "y"])).df, 4)


@query("WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(k AS INTEGER) AS bin, round(a + k * (b - a) / 10, 6) AS low, round(a + (k + 1) * (b - a) / 10, 6) AS high, count(value) AS count FROM e CROSS JOIN range(10) r(k) LEFT JOIN events ON least(floor((value - a) / ((b - a) / 10)), 9) = k GROUP BY k, a, b")
def hist_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(plotdata.plot_hist(ev(spark, sf_dir), "value"))


@query(f"""WITH p AS (SELECT avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM {LI} GROUP BY time, lat, lon), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 16)), 15) AS INTEGER) AS bx, CAST(least(floor((y - y0) / ((y1 - y0) / 16)), 15) AS INTEGER) AS by, count(*) AS count FROM p, e GROUP BY 1, 2""")
def hist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = li(spark, sf_dir).df.groupBy("time", "lat", "lon").agg(F.avg("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y"))
    cube = Cube.of(df, ("time", "lat", "lon"))
    return plotdata.plot_scatter(cube.select(["x"]), cube.select(["y"]), "x", "y", bins=16)


_REGIONS = [("West", "Left", "POLYGON ((-180 -60, 0 -60, 0 60, -180 60, -180 -60))"), ("East", "Right", "POLYGON ((0 -60, 170 -60, 100 60, 0 60, 0 -60))")]


@query(f"SELECT lat, lon, CASE WHEN lat BETWEEN -60 AND 60 AND lon < 0 THEN 1 WHEN lat BETWEEN -60 AND 60 AND lon < 170 - (lat + 60) * 70 / 120 THEN 2 ELSE -1 END AS country_code, CASE WHEN lat BETWEEN -60 AND 60 AND lon < 0 THEN 1 WHEN lat BETWEEN -60 AND 60 AND lon < 170 - (lat + 60) * 70 / 120 THEN 2 ELSE -1 END AS continent_code FROM (SELECT DISTINCT lat, lon FROM {EV})")
def regions_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.make_regions_dataset(ev(spark, sf_dir), regions.Regions(_REGIONS)).df


@query(f"SELECT time, lat, lon, CASE WHEN lat BETWEEN -60 AND 60 AND lon < 0 THEN value END AS value FROM {EV}")
def regions_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.mask_dataset_by_regions(ev(spark, sf_dir), regions.Regions(_REGIONS), "Left").df


@query(f"SELECT time, lat, CASE WHEN lon + 180 > 180 THEN lon - 180 ELSE lon + 180 END AS lon, value FROM {EV}")
def normalize_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ev(spark, sf_dir)
    wide = Cube.of(cube.df.select("lon", "lat", "time", "value").withColumn("lon", F.col("lon") + 180).withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), ("longitude", "latitude", "time"))
    return normalize.normalize(wide).df


@query(f"SELECT lat, lon, round(avg(value), 6) AS value, round(avg(value), 6) * 2 + 1 AS twice FROM (SELECT * FROM {EV} WHERE time BETWEEN '2024-01-05' AND '2024-01-10 23:59:59') GROUP BY lat, lon")
def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = new_expression_op("twice", "round(value, 6) * 2 + 1", "twice")
    steps = [("subset_temporal", {"time_range": "2024-01-05, 2024-01-10"}), ("reduce", {"dim": "time", "apply_spatial_weighting": False}), (twice, {})]
    return r(execute_operations(ev(spark, sf_dir), steps)[0].df)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS time, event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windowed_statistics(table(spark, sf_dir, "events"), by=["event_type"])
    return r(df.withColumn("time", F.col("time").cast("timestamp_ntz")))


@query(f"SELECT lat, lon, value FROM {_GLOBE} WHERE lat BETWEEN -40 AND 40 AND lon BETWEEN -100 AND 100")
def map_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = aggregate.reduce(ev(spark, sf_dir), dim="time", apply_spatial_weighting=False)
    return plotdata.plot_map(cube, "value", region="-100,-40,100,40")
