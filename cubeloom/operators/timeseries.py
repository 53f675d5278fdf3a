"""Series in time: at a point, means over space, spectra."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..cube import Cube, cos_lat
from ..likes import PointLike, VarNamesLike
from ..op import op
from .subset import nearest_label


@op(tags=("timeseries", "temporal", "filter", "point"), point=dict(data_type=PointLike), var=dict(data_type=VarNamesLike, nullable=True), method=dict(value_set=["nearest", "ffill", "bfill", None]))
def tseries_point(ds: Cube, point: Any, var: Any = None, method: str | None = "nearest") -> Cube:
    """The series at the pixel that a point belongs to."""
    names = VarNamesLike.pick(var, list(ds.vars))
    (x, y), = point.parts[0]
    lat, lon = nearest_label(ds, "lat", y, method or "nearest"), nearest_label(ds, "lon", x, method or "nearest")
    df = ds.df.where((F.col("lat") == F.lit(lat)) & (F.col("lon") == F.lit(lon))) if lat is not None and lon is not None else ds.df.where(F.lit(False))
    dims = tuple(ds.others("lat", "lon"))
    attrs = {k: v for k, v in ds.attrs.items() if not k.startswith("geospatial_")}
    return ds.on(df.select(*dims, *names), names, dims).with_(attrs=attrs)


@op(version="1.1", tags=("timeseries", "temporal", "aggregate", "mean"), var=dict(data_type=VarNamesLike, nullable=True), apply_spatial_weighting=dict(data_type=bool))
def tseries_mean(ds: Cube, var: Any = None, apply_spatial_weighting: bool = True, mean_suffix: str = "_mean", std_suffix: str = "_std") -> Cube:
    """The mean and population deviation of each time step over all other dimensions, weighted by cos(lat) if asked for."""
    names = VarNamesLike.pick(var, list(ds.vars))
    weighted = apply_spatial_weighting and "lat" in ds.dims
    made = []
    for v in names:
        x = F.col(v)
        w = F.when(x.isNotNull(), cos_lat() if weighted else F.lit(1.0))
        total = F.nullif(F.sum(w), F.lit(0.0))
        mean = F.sum(x * w) / total
        spread = F.stddev_pop(v) if not weighted else F.sqrt(F.greatest(F.sum(x * x * w) / total - mean * mean, F.lit(0.0)))
        made += [mean.alias(v + mean_suffix), spread.alias(v + std_suffix)]
    return ds.with_(df=ds.df.groupBy("time").agg(*made), dims=("time",), vars={v + s: {} for v in names for s in (mean_suffix, std_suffix)})


@op(tags=("timeseries", "fourier"), var=dict(data_type=VarNamesLike, nullable=True), compute_frequencies=dict(data_type=bool))
def fourier_analysis(ds: Cube, var: Any = None, compute_frequencies: bool = True) -> Cube:
    """The discrete Fourier transform along time: <v>_ampl = |F| / N, <v>_phase, and frequencies in 1/s, by index k.

    Series are one for each other cell; a series with a missing value has no spectrum.
    """
    ds.require("time")
    names, rest = VarNamesLike.pick(var, list(ds.vars)), ds.others("time")
    types = {f.name: f.dataType.simpleString() for f in ds.df.schema}
    timed = types["time"].startswith("timestamp")

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("time", kind="stable")
        n = len(series)
        out = {d: [series[d].iloc[0]] * n for d in rest} | {"k": np.arange(n)}
        if compute_frequencies:
            step = (series["time"].iloc[1] - series["time"].iloc[0]) if n > 1 else 1.0
            out["frequency"] = np.fft.fftfreq(n, step.total_seconds() if timed and n > 1 else float(step))
        for v in names:
            f = np.fft.fft(series[v].to_numpy(float))
            out[f"{v}_ampl"], out[f"{v}_phase"] = np.abs(f) / n, np.angle(f)
        return pd.DataFrame(out)

    fields = [*(f"{d} {types[d]}" for d in rest), "k long", *(["frequency double"] if compute_frequencies else []), *(f"{v}_{x} double" for v in names for x in ("ampl", "phase"))]
    df = ds.df.select("time", *rest, *names)
    found = df.groupBy(*rest).applyInPandas(run, ", ".join(fields))
    return ds.with_(df=found, dims=("k", *rest), vars={f"{v}_{x}": {} for v in names for x in ("ampl", "phase")})


@op(tags=("timeseries", "gapfilling"), var=dict(data_type=VarNamesLike, nullable=True))
def interpolate_time(ds: Cube, var: Any = None) -> Cube:
    """Fill gaps along time by straight lines between the values on either side; ends stay missing."""
    from pyspark.sql import Window

    names = VarNamesLike.pick(var, list(ds.vars))
    back = Window.partitionBy(*ds.others("time")).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*ds.others("time")).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)  # backwards: a frame to the end is read anew for each row
    at = F.unix_micros(F.col("time").cast("timestamp"))
    df = ds.df
    for v in names:
        known = F.when(F.col(v).isNotNull(), F.struct(at.alias("t"), F.col(v).alias("x")))
        a, b = F.last(known, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(ahead)
        share = (at - a["t"]) / F.nullif((b["t"] - a["t"]).cast("double"), F.lit(0.0))
        df = df.withColumn(v, F.coalesce(F.col(v), a["x"] + (b["x"] - a["x"]) * share))
    return ds.on(df.select(*ds.dims, *ds.vars))
