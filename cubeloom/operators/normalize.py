"""Normal forms of cubes and the attributes that describe their extent."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import functions as F

from ..cube import Cube
from ..likes import to_datetime
from ..op import op

NAMES = {"latitude": "lat", "longitude": "lon", "long": "lon"}


def _renamed(ds: Cube, names: dict[str, str]) -> Cube:
    names = {a: b for a, b in names.items() if a in ds.df.columns and b not in ds.df.columns}
    if not names:
        return ds
    new = lambda c: names.get(c, c)
    return ds.with_(df=ds.df.withColumnsRenamed(names), dims=tuple(map(new, ds.dims)), vars={new(v): a for v, a in ds.vars.items()}, coord_attrs={new(k): v for k, v in ds.coord_attrs.items()})


def _flat_grid(ds: Cube) -> Cube:
    """lat and lon given by cell (y, x) become axes if lat depends on y only and lon on x only."""
    rest = [d for d in ds.dims if d not in ("y", "x")]
    if "lat" in ds.dims or not {"lat", "lon"} <= set(ds.vars) or len(ds.dims) - len(rest) != 2:
        return ds
    uneven = ds.df.groupBy("y").agg((F.max("lat") - F.min("lat")).alias("w")).where("w > 1e-9").isEmpty() and ds.df.groupBy("x").agg((F.max("lon") - F.min("lon")).alias("w")).where("w > 1e-9").isEmpty()
    if not uneven:
        return ds
    names = [v for v in ds.vars if v not in ("lat", "lon")]
    return ds.on(ds.df.select(*rest, "lat", "lon", *names), names, (*rest, "lat", "lon"))


@op(tags=("utility",))
def normalize(ds: Cube) -> Cube:
    """Coordinates named lat, lon and time, longitudes from -180 to 180, times as such, a time axis where attributes give one."""
    ds = _flat_grid(_renamed(ds, {**NAMES, **({"t": "time"} if "time" not in ds.df.columns else {})}))
    names = list(ds.vars)
    if "time" not in ds.df.columns:
        start, end = (ds.attrs.get(f"time_coverage_{x}") for x in ("start", "end"))
        if start and "lat" in ds.dims:
            a, b = to_datetime(start), to_datetime(end or start)
            ds = ds.with_(df=ds.df.withColumn("time", F.lit(a + (b - a) / 2).cast("timestamp_ntz")), dims=("time", *ds.dims), coord_attrs={**ds.coord_attrs, "time": {"bounds": (a, b)}})
    types = dict(ds.df.dtypes)
    if "time" in ds.dims and types["time"] in ("double", "float") and str(ds.coord_attrs.get("time", {}).get("long_name", ds.coord_attrs.get("time", {}).get("units", "julian"))).lower().find("julian") >= 0:
        # whole microseconds from days since noon of the first Julian day
        ds = ds.with_(df=ds.df.withColumn("time", F.timestamp_micros(F.round((F.col("time") - 2440587.5) * 86_400_000_000).cast("long")).cast("timestamp_ntz")))
    if "lon" in ds.dims and (ds.attrs.get("geospatial_lon_max") or 181) > 180:
        high = ds.extent("lon")[1]
        if high is not None and high > 180:
            ds = adjust_spatial_attrs(ds.with_(df=ds.df.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))))
    bounds = [v for v in names if v.endswith(("_bnds", "_bounds"))]
    if bounds:
        ds = ds.with_(vars={v: a for v, a in ds.vars.items() if v not in bounds}, coord_attrs={**ds.coord_attrs, **{v: {"bounds": True} for v in bounds}})
    order = [*(d for d in ("time",) if d in ds.dims), *ds.others("time", "lat", "lon"), *(d for d in ("lat", "lon") if d in ds.dims)]
    if tuple(order) != ds.dims:
        ds = ds.with_(df=ds.df.select(*order, *[c for c in ds.df.columns if c not in order]), dims=tuple(order))
    return ds


@op(tags=("utility",), allow_point=dict(data_type=bool))
def adjust_spatial_attrs(ds: Cube, allow_point: bool = False) -> Cube:
    """geospatial_{lat,lon}_{min,max,resolution,units} and geospatial_bounds from the axes, edges half a step beyond the centres."""
    attrs, edges = dict(ds.attrs), {}
    for d in ("lat", "lon"):
        if d not in ds.dims:
            continue
        low, high = ds.extent(d)
        step = ds.step(d)
        if low is None or (step is None and not allow_point):
            continue
        half = abs(step) / 2 if step else 0.0
        edges[d] = (low - half, high + half)
        attrs |= {f"geospatial_{d}_min": low - half, f"geospatial_{d}_max": high + half, f"geospatial_{d}_units": "degrees_north" if d == "lat" else "degrees_east"}
        if step:
            attrs[f"geospatial_{d}_resolution"] = abs(step)
    if len(edges) == 2:
        (y0, y1), (x0, x1) = edges["lat"], edges["lon"]
        attrs["geospatial_bounds"] = f"POLYGON(({x0} {y0}, {x0} {y1}, {x1} {y1}, {x1} {y0}, {x0} {y0}))"
        attrs["geospatial_bounds_crs"] = "CRS84"
    return ds.with_(attrs=attrs)


def resolution_of(a: datetime, b: datetime) -> str:
    days = (b - a) / timedelta(days=1)
    return "P1M" if 27 < days < 32 else f"P{int(days)}D"


@op(tags=("utility",))
def adjust_temporal_attrs(ds: Cube) -> Cube:
    """time_coverage_{start,end,duration,resolution} from the bounds of the time axis if it has them, else from its labels."""
    if "time" not in ds.dims or not dict(ds.df.dtypes)["time"].startswith("timestamp"):
        return ds
    low, high = ds.extent("time")
    if low is None:
        return ds
    bounds: Any = ds.coord_attrs.get("time", {}).get("bounds")
    a, b = bounds if bounds else (low, high)
    two = [r[0] for r in ds.coord("time").orderBy("time").limit(2).collect()]
    attrs = {**ds.attrs, "time_coverage_start": str(a), "time_coverage_end": str(b), "time_coverage_duration": f"P{(b - a).days + 1}D"}
    if len(two) == 2:
        attrs["time_coverage_resolution"] = resolution_of(*two)
    return ds.with_(attrs=attrs)
