"""Aggregation over dimensions, calendar fields and periods."""

from __future__ import annotations

from datetime import datetime
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, cos_lat, small
from ..functions.quantiles import aggregated
from ..functions.temporal import bin_labels, bin_start, parse_period
from ..likes import DimNamesLike, VarNamesLike
from ..op import op

PLAIN = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median}
STATISTICS = ("count", "mean", "median", "sum", "std", "min", "max")


def _weight(v: str) -> Column:
    return F.when(F.col(v).isNotNull(), cos_lat())


def weighted_mean(v: str) -> Column:
    return F.sum(F.col(v) * cos_lat()) / F.nullif(F.sum(_weight(v)), F.lit(0.0))


def weighted_sum(v: str) -> Column:
    return F.sum(F.col(v) * cos_lat())


def _lat_weighted(ds: Cube, names: list[str], dims: list[str], first: Any, rest: Any) -> DataFrame:
    """By the other dimensions a weighted figure over lat, then a plain one over what is left of dims."""
    left = [d for d in ds.dims if d != "lat"]
    keep = [d for d in ds.dims if d not in dims]
    inner = ds.df.groupBy(*left).agg(*(first(v).alias(v) for v in names))
    return inner if keep == left else inner.groupBy(*keep).agg(*(rest(v).alias(v) for v in names))


@op(version="1.1", tags=("aggregate",), var=dict(data_type=VarNamesLike, nullable=True), dim=dict(data_type=DimNamesLike, nullable=True), method=dict(value_set=list(PLAIN)), apply_spatial_weighting=dict(data_type=bool))
def reduce(ds: Cube, var: Any = None, dim: Any = None, method: str = "mean", apply_spatial_weighting: bool = True) -> Cube:
    """Reduce dimensions (all by default; unknown ones are ignored), leaving out missing values.

    Mean and sum over lat are weighted by cos(lat): first over lat, then plainly over the rest.
    """
    names = VarNamesLike.pick(var, list(ds.vars))
    dims = [d for d in (dim or ds.dims) if d in ds.dims]
    keep = [d for d in ds.dims if d not in dims]
    if not dims:
        return ds.select(names)
    if apply_spatial_weighting and method in ("mean", "sum") and "lat" not in ds.dims and (dim is None or "lat" in dim):
        raise ValidationError("Cannot apply spatial weighting: the dataset has no lat coordinate.")
    if apply_spatial_weighting and method in ("mean", "sum") and "lat" in dims:
        df = _lat_weighted(ds, names, dims, weighted_mean if method == "mean" else weighted_sum, F.avg if method == "mean" else F.sum)
    elif method == "median":
        df = aggregated(ds.df, keep, [], {v: F.col(v) for v in names})
    else:
        df = ds.df.groupBy(*keep).agg(*(PLAIN[method](v).alias(v) for v in names))
    return ds.on(df, names, tuple(keep))


def _spread(v: str) -> Column:
    """The weighted population deviation over a group, from its moments about the plain mean's scale."""
    w, x = _weight(v), F.col(v)
    m = F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))
    return F.sqrt(F.greatest(F.sum(w * x * x) / F.nullif(F.sum(w), F.lit(0.0)) - m * m, F.lit(0.0)))


@op(version="1.1", tags=("aggregate", "statistics"), var=dict(data_type=VarNamesLike, nullable=True), dim=dict(data_type=DimNamesLike, nullable=True), methods=dict(data_type=VarNamesLike, any_of=list(STATISTICS)), apply_spatial_weighting=dict(data_type=bool))
def statistics(ds: Cube, var: Any = None, apply_spatial_weighting: bool = True, dim: Any = None, methods: Any = "mean") -> Cube:
    """Add <var>_<method> beside the variables: of (count, mean, median, sum, std, min, max), in this order.

    count: cells that are not zero (missing ones count). mean, sum and std over lat are weighted like those of reduce().
    """
    names = VarNamesLike.pick(var, list(ds.vars))
    dims = [d for d in (dim or ds.dims) if d in ds.dims]
    keep = [d for d in ds.dims if d not in dims]
    asked = [m for m in STATISTICS if m in methods]
    nested = apply_spatial_weighting and "lat" in dims
    if apply_spatial_weighting and dim is None and "lat" not in ds.dims:
        raise ValidationError("Cannot apply spatial weighting: the dataset has no lat coordinate.")
    made = {"count": lambda v: F.count(F.when(F.col(v).isNull() | (F.col(v) != 0), 1)), "mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "min": F.min, "max": F.max}
    plain = [m for m in asked if not (nested and m in ("mean", "sum", "std"))]
    frames = []
    if plain:
        middles = {f"{v}_median": F.col(v) for v in names if "median" in plain}
        frames.append(aggregated(ds.df, keep, [made[m](v).alias(f"{v}_{m}") for v in names for m in plain if m != "median"], middles))
    heavy = [m for m in asked if m not in plain]
    if heavy:
        first = {"mean": weighted_mean, "sum": weighted_sum, "std": _spread}
        left = [d for d in ds.dims if d != "lat"]
        inner = ds.df.groupBy(*left).agg(*(first[m](v).alias(f"{v}_{m}") for v in names for m in heavy))
        frames.append(inner if keep == left else inner.groupBy(*keep).agg(*(made[m](f"{v}_{m}").alias(f"{v}_{m}") for v in names for m in heavy)))
    df = fold(lambda a, b: a.join(b, keep) if keep else a.crossJoin(b), frames)  # without dims left, one row each
    df = df.select(*keep, *(f"{v}_{m}" for v in names for m in asked))
    return ds.with_(sides={**ds.sides, tuple(keep): df})


@op(version="1.5", tags=("climatology", "temporal", "aggregate"), var=dict(data_type=VarNamesLike, nullable=True))
def climatology(ds: Cube, var: Any = None) -> Cube:
    """Mean over the years of each month, day of year or season, by the time_coverage_resolution (P1M, P1D, other)."""
    ds.require("time")
    if not dict(ds.df.dtypes)["time"].startswith(("timestamp", "date")):
        raise ValidationError("Long term average operation expects a time coordinate of type datetime64.")
    resolution = ds.attrs.get("time_coverage_resolution")
    if not resolution:
        raise ValidationError("Could not determine temporal resolution: time_coverage_resolution is missing.")
    names, rest, t = VarNamesLike.pick(var, list(ds.vars)), ds.others("time"), F.col("time")
    mean = [F.avg(v).alias(v) for v in names]
    attrs = {**ds.attrs, "climatology": "climatology_bounds"}
    if resolution == "P1D":
        df = ds.df.groupBy(F.dayofyear(t).alias("dayofyear"), *rest).agg(*mean)
        return ds.on(df, names, ("dayofyear", *rest)).with_(attrs=attrs)
    low, high = ds.extent("time")
    if resolution == "P1M":
        by = ds.df.groupBy(F.month(t).alias("_month"), *rest).agg(*mean)
        df = by.select(F.make_date(F.lit(low.year), "_month", F.lit(1)).cast("timestamp_ntz").alias("time"), *rest, *names)
        months = {"time": [datetime(low.year, m, 1) for m in sorted({t.month for t in ds.axes["time"]})]} if ds.axes.get("time") else {}
        return ds.on(df, names).with_(attrs={**attrs, "climatology_bounds": (low, high)}, axes=months)
    steps = ds.coord("time").groupBy(F.year(t).alias("y")).agg(F.sort_array(F.collect_set(F.struct(F.month(t).alias("m"), F.day(t).alias("d")))).alias("s")).orderBy("y").collect()
    sets = {r["y"]: {tuple(x) for x in r["s"]} for r in steps}
    years = sorted(sets)
    model = years[1] if len(years) > 1 and len(sets[years[1]]) > len(sets[years[0]]) else years[0]
    if any(not s <= sets[model] for s in sets.values()):
        raise ValidationError("Long-term average operation found inconsistent seasons.")
    by = ds.df.groupBy(F.month(t).alias("_m"), F.day(t).alias("_d"), *rest).agg(*mean)
    df = by.select(F.make_date(F.lit(model), "_m", "_d").cast("timestamp_ntz").alias("time"), *rest, *names)
    found = ds.on(df, names).with_(attrs={**attrs, "climatology_bounds": (low, high)})
    return found.with_(vars={n: {**found.vars[n], "cell_methods": "time: mean over years"} for n in names})


def _in_bin(names: list[str], method: str) -> list[Column]:
    t = F.col("time")
    simple = {"mean": F.avg, "max": F.max, "min": F.min, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "std": F.stddev_pop, "var": F.var_pop, "prod": lambda v: F.coalesce(F.product(v), F.lit(1.0)), "count": F.count}
    if method in simple:
        return [simple[method](v).alias(v) for v in names]
    if method in ("first", "last"):
        pick = F.min_by if method == "first" else F.max_by
        return [pick(v, F.when(F.col(v).isNotNull(), t)).alias(v) for v in names]
    # the place in a bin is the number of the bin's steps before the best one
    sign = -1 if method == "argmax" else 1
    best = lambda v: F.min(F.when(F.col(v).isNotNull(), F.struct((F.col(v) * sign).alias("x"), t.alias("t"))))["t"]
    return [best(v).alias(v) for v in names]


@op(version="2.0", tags=("aggregate", "temporal"), method=dict(value_set=["mean", "max", "median", "prod", "sum", "std", "var", "argmax", "argmin", "first", "last", "min", "count"]), period=dict(data_type=str))
def temporal_aggregation(ds: Cube, method: str = "mean", period: str = "MS") -> Cube:
    """Aggregate to periods of time: MS, QS-DEC, 8MS, 8D, W, YS, h and the like. Periods without data are there too."""
    if "time" not in ds.dims:
        raise ValidationError("Cannot apply temporal aggregation because dataset does not have a time dimension.")
    p, names, rest = parse_period(period), list(ds.vars), ds.others("time")
    first, last = ds.extent("time")
    if first is None:
        return ds
    label = bin_start(F.col("time"), p, first)
    binned = ds.df.withColumn("_bin", label)
    if method == "median":
        df = aggregated(binned, ["_bin", *rest], [], {v: F.col(v) for v in names})
    else:
        df = binned.groupBy("_bin", *rest).agg(*_in_bin(names, method))
    if method in ("argmax", "argmin"):
        place = F.row_number().over(Window.partitionBy("_bin").orderBy("time")) - 1  # over the steps of a bin, not its cells
        places = small(ds.coord("time").withColumn("_bin", label).select("time", place.cast("long").alias("place")))
        for v in names:
            df = df.join(places.select(F.col("time").alias(v), F.col("place").alias(f"_{v}")), v, "left").drop(v).withColumnRenamed(f"_{v}", v)
    df = df.withColumnRenamed("_bin", "time").select("time", *rest, *names)
    ends = ds.df.sparkSession.range(1).select(*(bin_start(F.lit(x).cast("timestamp_ntz"), p, first) for x in (first, last))).first()
    expected = bin_labels(ends[0], ends[1], p)
    present = {r[0] for r in ds.coord("time").select(label).distinct().collect()}
    missing = [x for x in expected if x not in present]
    if missing:
        gaps = ds.df.sparkSession.createDataFrame([(x,) for x in missing], "time timestamp_ntz")
        empty = {"sum": F.lit(0.0), "prod": F.lit(1.0), "count": F.lit(0)}.get(method, F.lit(None))
        cells = ds.df.select(*rest).distinct() if rest else None
        grid = F.broadcast(gaps).crossJoin(cells) if cells is not None else gaps  # few labels, each for every cell
        df = df.unionByName(grid.select("time", *rest, *(empty.cast(df.schema[v].dataType).alias(v) for v in names)))
    return ds.on(df).with_(attrs={**ds.attrs, "time_coverage_resolution": f"P{period}"}, axes={"time": expected})
