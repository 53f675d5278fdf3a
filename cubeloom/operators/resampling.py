"""Resampling of grids: cells are numbered, axes overlap by small tables, and the rest is join and aggregation."""

from __future__ import annotations

from collections import Counter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, small
from ..functions.splines import stretched
from ..functions.weights import neighbours, overlap, table
from ..op import op

DOWN = ("first", "last", "mean", "mode", "var", "std", "min", "max")
UP = ("nearest", "linear")


def downsample_2d(cells: DataFrame, shape: tuple[int, int], out: tuple[int, int], method: str = "mean", mode_rank: int = 1, group: list[str] | None = None) -> DataFrame:
    """Cells (group, iy, ix, v; gaps null) of height and width `shape` on a grid no finer; a cell without any value is null.

    mean, var and std weigh by overlap; mode takes the value of the mode_rank-th greatest weight; first and last go by rows.
    """
    group = group or []
    if method not in DOWN:
        raise ValidationError(f"invalid downsampling method {method!r}")
    if out[0] > shape[0] or out[1] > shape[1]:
        raise ValidationError("the output must not be finer than the input")
    spark = cells.sparkSession
    wy, wx = table(spark, overlap(shape[0], out[0]), ["oy", "iy", "wy", "my"]), table(spark, overlap(shape[1], out[1]), ["ox", "ix", "wx", "mx"])
    met = cells.join(wy, "iy").join(wx, "ix").withColumn("w", F.col("wy") * F.col("wx"))
    key = [*group, F.col("oy").alias("iy"), F.col("ox").alias("ix")]
    v, w = F.col("v"), F.when(F.col("v").isNotNull(), F.col("w"))
    total = F.nullif(F.sum(w), F.lit(0.0))
    if method in ("mean", "var", "std"):
        mean = F.sum(w * v) / total
        var = F.greatest((F.sum(w * v * v) * F.sum(w) - F.sum(w * v) * F.sum(w * v)) / (total * total), F.lit(0.0))
        return met.groupBy(*key).agg({"mean": mean, "var": var, "std": F.sqrt(var)}[method].alias("v"))
    if method in ("min", "max"):
        return met.groupBy(*key).agg((F.min if method == "min" else F.max)("v").alias("v"))
    place = F.col("iy") * shape[1] + F.col("ix")
    if method in ("first", "last"):
        pick = F.min_by if method == "first" else F.max_by
        return met.groupBy(*key).agg(pick("v", F.when(v.isNotNull() & F.col("my") & F.col("mx"), place)).alias("v"))
    by = met.where(v.isNotNull()).groupBy(*group, "oy", "ox", "v").agg(F.sum("w").alias("n"), F.min(place).alias("seen"))
    ranked = by.withColumn("r", F.row_number().over(Window.partitionBy(*group, "oy", "ox").orderBy(F.desc(F.round("n", 9)), "seen"))).where(F.col("r") == mode_rank)
    grid = met.select(*group, "oy", "ox").distinct()
    return grid.join(ranked.select(*group, "oy", "ox", "v"), [*group, "oy", "ox"], "left").select(*key, "v")


def upsample_2d(cells: DataFrame, shape: tuple[int, int], out: tuple[int, int], method: str = "linear", group: list[str] | None = None) -> DataFrame:
    """Cells on a grid no coarser, by the nearest cell or linearly; where a linear neighbour is missing, the value of the
    neighbour of the greatest weight counts (of equal ones the last), null if that is missing."""
    group = group or []
    if method not in UP:
        raise ValidationError(f"invalid upsampling method {method!r}")
    if out[0] < shape[0] or out[1] < shape[1]:
        raise ValidationError("the output must not be coarser than the input")
    spark, linear = cells.sparkSession, method == "linear"
    # a neighbour counts even where its weight is zero; n is the number of neighbours that a full grid has
    axes = []
    for source, o in zip(shape, out):
        rows = neighbours(source, o, linear)
        many = Counter(r[0] for r in rows)
        axes.append([(*r, many[r[0]]) for r in rows])
    wy, wx = table(spark, axes[0], ["oy", "iy", "wy", "ny"]), table(spark, axes[1], ["ox", "ix", "wx", "nx"])
    met = cells.join(wy, "iy").join(wx, "ix").withColumn("w", F.round(F.col("wy") * F.col("wx"), 12))
    complete = F.count("v") == F.max(F.col("ny") * F.col("nx"))
    heaviest = F.max(F.struct("w", "iy", "ix", "v"))["v"]
    value = F.when(complete, F.sum(F.col("wy") * F.col("wx") * F.col("v"))).otherwise(heaviest)
    return met.groupBy(*group, F.col("oy").alias("iy"), F.col("ox").alias("ix")).agg(value.alias("v"))


def resample_2d(cells: DataFrame, shape: tuple[int, int], out: tuple[int, int], down: str = "mean", up: str = "linear", mode_rank: int = 1, group: list[str] | None = None) -> DataFrame:
    """Each axis goes its own way; where they differ, the axis that gets coarser goes first."""
    (h, w), (oh, ow) = shape, out
    if (h, w) == (oh, ow):
        return cells
    if oh <= h and ow <= w:
        return downsample_2d(cells, shape, out, down, mode_rank, group)
    if oh >= h and ow >= w:
        return upsample_2d(cells, shape, out, up, group)
    mid = (min(h, oh), min(w, ow))
    return upsample_2d(downsample_2d(cells, shape, mid, down, mode_rank, group), mid, out, up, group)


def numbered(ds: Cube, names: list[str]) -> tuple[DataFrame, list, list]:
    """The cube with rows and columns numbered from the least latitude and longitude; the axes alone go to the driver."""
    lat, lon = ds.labels("lat"), ds.labels("lon")
    spark = ds.df.sparkSession
    ty, tx = table(spark, [(float(v), i) for i, v in enumerate(lat)], ["lat", "iy"]), table(spark, [(float(v), i) for i, v in enumerate(lon)], ["lon", "ix"])
    return ds.df.join(ty, "lat").join(tx, "lon").select(*ds.others("lat", "lon"), "iy", "ix", *names), lat, lon


def on_grid(ds: Cube, lat: list[float], lon: list[float], names: list[str], resample: Any) -> Cube:
    """resample(cells, group) for each variable, then coordinates for the numbers; missing combinations are filled in as gaps."""
    cells, *_ = numbered(ds, names)
    rest, spark = ds.others("lat", "lon"), ds.df.sparkSession
    out = None
    for v in names:
        one = resample(cells.select(*rest, "iy", "ix", F.col(v).cast("double").alias("v")), rest).withColumnRenamed("v", v)
        out = one if out is None else out.join(one, [*rest, "iy", "ix"], "full_outer")
    ty, tx = table(spark, [(float(v), i) for i, v in enumerate(lat)], ["lat", "iy"]), table(spark, [(float(v), i) for i, v in enumerate(lon)], ["lon", "ix"])
    return ds.on(out.join(ty, "iy").join(tx, "ix").select(*rest, "lat", "lon", *names), names, (*rest, "lat", "lon"))


def centres(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / n
    return [low + (i + 0.5) * step for i in range(n)]


@op(tags=("resampling", "geometric"), x_res=dict(data_type=float), y_res=dict(data_type=float))
def resample(ds: Cube, x_res: float, y_res: float, upsampling_float: Any = "bilinear", upsampling_int: Any = "nearest_neighbor", downsampling_float: str = "mean", downsampling_int: str = "nearest_neighbor") -> Cube:
    """The cube at another resolution in degrees: finer by nearest_neighbor, bilinear or splines of order 2 to 5, coarser by
    nearest_neighbor (the first cell), mean, min or max; whole numbers and flags go their own way."""
    lat, lon = ds.labels("lat"), ds.labels("lon")
    dy, dx = lat[1] - lat[0], lon[1] - lon[0]
    y0, y1, x0, x1 = lat[0] - dy / 2, lat[-1] + dy / 2, lon[0] - dx / 2, lon[-1] + dx / 2
    out = max(1, round((y1 - y0) / y_res)), max(1, round((x1 - x0) / x_res))
    shape = len(lat), len(lon)
    names = list(ds.vars)
    types = dict(ds.df.dtypes)
    whole = [v for v in names if types[v] not in ("double", "float")]
    down_of = {"nearest_neighbor": "first", 0: "first", "first": "first", "mean": "mean", "min": "min", "max": "max"}
    up_of = {"nearest_neighbor": "nearest", 0: "nearest", "bilinear": "linear", 1: "linear", "2nd-order spline": 2, "cubic": 3, "4th-order spline": 4, "5th-order spline": 5, 2: 2, 3: 3, 4: 4, 5: 5}

    def one(up: Any, down: str) -> Any:
        if up not in up_of or down not in down_of:
            raise ValidationError(f"invalid method {up!r} or {down!r}")
        if isinstance(up_of[up], str):
            return lambda c, g: resample_2d(c, shape, out, down_of[down], up_of[up], 1, g)
        return lambda c, g: _spline(c, shape, out, up_of[up], down_of[down], g)

    new_lat, new_lon = centres(y0, y1, out[0]), centres(x0, x1, out[1])
    parts = [on_grid(ds, new_lat, new_lon, group, one(*how)) for group, how in (([v for v in names if v not in whole], (upsampling_float, downsampling_float)), (whole, (upsampling_int, downsampling_int))) if group]
    found = parts[0]
    for p in parts[1:]:
        found = found.with_(df=found.df.join(p.df, list(found.dims), "full_outer"), vars={**found.vars, **p.vars})
    attrs = {**ds.attrs, "geospatial_lat_resolution": (y1 - y0) / out[0], "geospatial_lon_resolution": (x1 - x0) / out[1]}
    return found.on(found.df.select(*found.dims, *(F.col(v).cast(types[v]).alias(v) for v in names)), names).with_(attrs=attrs)


def _spline(cells: DataFrame, shape: tuple[int, int], out: tuple[int, int], order: int, down: str, group: list[str]) -> DataFrame:
    mid = (min(shape[0], out[0]), min(shape[1], out[1]))
    cells = downsample_2d(cells, shape, mid, down, 1, group) if mid != shape else cells
    spark = cells.sparkSession
    along = lambda axis, n, m, df: _weighted(df, axis, table(spark, stretched(n, m, order), [f"_o{axis}", axis, "_w"]), [*group, {"iy": "ix", "ix": "iy"}[axis]])
    return along("ix", mid[1], out[1], along("iy", mid[0], out[0], cells)).select(*group, "iy", "ix", "v")


def _weighted(cells: DataFrame, axis: str, weights: DataFrame, keep: list[str]) -> DataFrame:
    """Sums of v along one axis by a table of weights; missing where a cell with a weight is."""
    needed = weights.groupBy(f"_o{axis}").agg(F.count("*").alias("_n"))
    met = cells.join(weights.join(needed, f"_o{axis}"), axis)
    value = F.when(F.count("v") == F.max("_n"), F.sum(F.col("v") * F.col("_w")))
    return met.groupBy(*keep, f"_o{axis}").agg(value.alias("v")).withColumnRenamed(f"_o{axis}", axis)


def check_grid(labels: list[float], dim: str) -> float:
    """The step of an evenly spaced axis of pixels that fits the globe; else an error."""
    if len(labels) < 2:
        raise ValidationError(f"The axis {dim} needs at least two labels.")
    steps = np.diff(labels)
    step = float(steps.mean())
    if np.abs(steps - step).max() > 0.01 * abs(step):
        raise ValidationError(f"The {dim} axis is not equidistant.")
    limit = 90 if dim == "lat" else 180
    if labels[0] - step / 2 < -limit - 1e-6 * limit or labels[-1] + step / 2 > limit + 1e-6 * limit:
        raise ValidationError(f"The {dim} axis is outside of the globe.")
    return step


def find_intersection(a: tuple[float, float, float], b: tuple[float, float, float], limit: float) -> tuple[float, float]:
    """The common range of two axes (low, high, step), moved inwards to boundaries of pixels of both, in at most 100 steps."""
    low, high = max(a[0], b[0]), min(a[1], b[1])
    if low >= high:
        raise ValidationError("Could not find a common region of the datasets.")
    wide = max(a[2], b[2])
    at = lambda v, g: abs((v - g[0]) / g[2] - round((v - g[0]) / g[2])) < 1e-6
    coarse = a if a[2] >= b[2] else b
    low = coarse[0] + np.ceil(round((low - coarse[0]) / coarse[2], 9)) * coarse[2]
    high = coarse[0] + np.floor(round((high - coarse[0]) / coarse[2], 9)) * coarse[2]
    for _ in range(100):
        if at(low, a) and at(low, b):
            break
        low += wide
    else:
        raise ValidationError("Could not find a common region of the datasets.")
    for _ in range(100):
        if at(high, a) and at(high, b):
            break
        high -= wide
    if low >= high or low < -limit - 1e-9 or high > limit + 1e-9:
        raise ValidationError("Could not find a common region of the datasets.")
    return float(low), float(high)


@op(version="1.1", tags=("geometric", "coregistration", "resampling"), method_us=dict(value_set=["nearest", "linear"]), method_ds=dict(value_set=["first", "last", "mean", "mode", "var", "std"]))
def coregister(ds_primary: Cube, ds_replica: Cube, method_us: str = "linear", method_ds: str = "mean") -> Cube:
    """The replica on the primary's grid, where both are."""
    for c in (ds_primary, ds_replica):
        c.require("lat", "lon")
    axes = {d: (ds_primary.labels(d), ds_replica.labels(d)) for d in ("lat", "lon")}
    if all(len(p) == len(r) and np.allclose(p, r) for p, r in axes.values()):
        return ds_replica
    new, cut, ranges = {}, {}, {}
    for d, (p, r) in axes.items():
        sp, sr = check_grid(p, d), check_grid(r, d)
        low, high = find_intersection((p[0] - sp / 2, p[-1] + sp / 2, sp), (r[0] - sr / 2, r[-1] + sr / 2, sr), 90 if d == "lat" else 180)
        new[d] = [float(v) for v in p if low <= v <= high]
        cut[d] = [float(v) for v in r if low <= v <= high]
        ranges[d] = (low, high)
    names = list(ds_replica.vars)
    part = ds_replica.on(ds_replica.df.where(F.col("lat").between(*ranges["lat"]) & F.col("lon").between(*ranges["lon"])))
    shape, out = (len(cut["lat"]), len(cut["lon"])), (len(new["lat"]), len(new["lon"]))
    return on_grid(part, new["lat"], new["lon"], names, lambda c, g: resample_2d(c, shape, out, method_ds, method_us, 1, g))
