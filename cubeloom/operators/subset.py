"""Subsets in space and time, and the values at a point."""

from __future__ import annotations

import math
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, small
from ..functions import geometry as g
from ..likes import PointLike, PolygonLike, TimeRangeLike
from ..op import op


def spatial_step(ds: Cube, dim: str) -> float:
    known = ds.attrs.get(f"geospatial_{dim}_resolution")
    return float(known) if known else abs(ds.step(dim) or 0.0)


def crosses_antimeridian(region: Any) -> bool:
    """A box given by numbers crosses the 180th meridian if its west is beyond its east; a polygon, if it is smaller that way."""
    if isinstance(region, str):
        parts = region.split(",")
        try:
            region = [float(x) for x in parts]
        except ValueError:
            region = PolygonLike.convert(region)
    if isinstance(region, (list, tuple)) and len(region) == 4 and all(isinstance(x, (int, float)) for x in region):
        return region[0] > region[2]
    shape = PolygonLike.convert(region)
    x0, y0, x1, y1 = shape.bounds
    if x1 - x0 <= 180:
        return False
    turned = g.polygon([(x + 360 if x < 0 else x, y) for x, y in shape.parts[0]])
    return turned.bounds[2] - turned.bounds[0] < x1 - x0


@op(tags=("geometric", "spatial", "subset"), mask=dict(data_type=bool))
def subset_spatial(ds: Cube, region: Any, mask: bool = True) -> Cube:
    """Cells in a region. Pixels that the region's bounds cross stay; for a polygon with `mask`, pixels none of whose
    corners is inside the polygon's shell are missing.

    :param region: a polygon, WKT, or a box x1,y1,x2,y2; a box whose x1 is beyond x2 crosses the 180th meridian
    """
    ds.require("lat", "lon")
    anti = crosses_antimeridian(region)
    given = region
    if anti and not isinstance(region, g.Geometry):
        values = [float(x) for x in region.split(",")] if isinstance(region, str) and region[:1] in "-+.0123456789" else region
        given = [min(values[0], values[2]), values[1], max(values[0], values[2]), values[3]] if isinstance(values, (list, tuple)) and not isinstance(values[0], (list, tuple)) else region
    shape = PolygonLike.convert(given)
    x0, y0, x1, y1 = shape.bounds
    if x0 < -180 or x1 > 180 or y0 < -90 or y1 > 90:
        raise ValidationError(f"Provided polygon {shape.wkt} extends outside of the globe")
    dx, dy = spatial_step(ds, "lon"), spatial_step(ds, "lat")
    lat, lon = F.col("lat"), F.col("lon")
    rows = lat.between(max(-90.0, y0 - dy / 2), min(90.0, y1 + dy / 2))
    turned = shape
    if anti:
        if given is region:  # a polygon, whose points tell nothing of the way round
            turned = g.Geometry(shape.kind, [[(x + 360 if x < 0 else x, y) for x, y in r] for r in shape.parts], shape.shells)
            x1, x0 = turned.bounds[0], turned.bounds[2] - 360  # from the west end over the meridian to the east end
        df = ds.df.where(rows & ((lon >= x1 - dx / 2) | (lon <= x0 + dx / 2)))
    else:
        df = ds.df.where(rows & lon.between(max(-180.0, x0 - dx / 2), min(180.0, x1 + dx / 2)))
    if df.isEmpty():
        raise ValidationError("Can not select a region outside dataset boundaries.")
    if mask and not shape.is_box:
        east = F.when(lon < 0, lon + 360).otherwise(lon) if anti else lon  # both sides of the meridian on one plane
        df = df.select(*ds.dims, *(F.when(corner_mask(lat, east, turned, dx, dy), F.col(v)).alias(v) for v in ds.vars))
    return adjust_spatial(ds.on(df), (x1, y0, x0, y1) if anti else (x0, y0, x1, y1))


def corner_mask(lat: Column, lon: Column, shape: g.Geometry, dx: float, dy: float) -> Column:
    shell = g.Geometry("POLYGON", [shape.parts[0]])
    test = F.lit(False)
    for sx in (-0.5, 0.5):
        for sy in (-0.5, 0.5):
            test = test | g.intersects(lon + sx * dx, lat + sy * dy, shell)
    return test


def adjust_spatial(ds: Cube, bounds: tuple[float, float, float, float]) -> Cube:
    x0, y0, x1, y1 = bounds
    return ds.with_(attrs={**ds.attrs, "geospatial_lon_min": x0, "geospatial_lon_max": x1, "geospatial_lat_min": y0, "geospatial_lat_max": y1})


@op(tags=("subset", "temporal", "filter"), time_range=dict(data_type=TimeRangeLike))
def subset_temporal(ds: Cube, time_range: Any) -> Cube:
    """Cells in a range of time, both ends included."""
    if "time" not in ds.dims:
        raise ValidationError("Cannot apply subset_temporal operation because dataset does not have time coordinates.")
    kind = dict(ds.df.dtypes)["time"]
    if not kind.startswith(("timestamp", "date")):
        raise ValidationError(f"Time subset operation expects a time coordinate of type datetime64, but got {kind}")
    low, high = time_range
    between = F.lit(True)
    if low is not None:
        between = between & (F.col("time") >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        between = between & (F.col("time") <= F.lit(high).cast("timestamp_ntz"))
    sides = {d: f.where(between) if "time" in d else f for d, f in ds.sides.items()}
    attrs = {**ds.attrs, **({"time_coverage_start": low.isoformat()} if low else {}), **({"time_coverage_end": high.isoformat()} if high else {})}
    return ds.on(ds.df.where(between)).with_(sides=sides, attrs=attrs)


@op(tags=("subset", "temporal", "filter"), time_ind_min=dict(data_type=int), time_ind_max=dict(data_type=int))
def subset_temporal_index(ds: Cube, time_ind_min: int, time_ind_max: int) -> Cube:
    """Cells of the time steps from one place to another, both included. The steps may be of any type."""
    ds.require("time")
    if time_ind_min < 0 or time_ind_max < time_ind_min:
        raise ValidationError("the indices must not be negative nor end before they start")
    # the axis alone is ranked; two labels bound the scan
    ends = ds.coord("time").orderBy("time").limit(time_ind_max + 1)
    labels = [r[0] for r in ends.collect()]
    if len(labels) <= time_ind_min:
        return ds.on(ds.df.where(F.lit(False)))
    kind = ds.df.schema["time"].dataType
    return ds.on(ds.df.where(F.col("time").between(F.lit(labels[time_ind_min]).cast(kind), F.lit(labels[-1]).cast(kind))))


def nearest_label(ds: Cube, dim: str, at: float | datetime, method: str = "nearest") -> Any:
    """The label nearest to a value, the last not above it (ffill) or the first not below it (bfill); None if there is none."""
    labels = ds.coord(dim)
    value = F.lit(at)
    if method == "ffill":
        return labels.where(F.col(dim) <= value).agg(F.max(dim)).first()[0]
    if method == "bfill":
        return labels.where(F.col(dim) >= value).agg(F.min(dim)).first()[0]
    gap = F.abs(F.col(dim) - value) if not isinstance(at, datetime) else F.abs(F.unix_micros(F.col(dim).cast("timestamp")) - F.unix_micros(value.cast("timestamp")))
    found = labels.agg(F.min(F.struct(gap.alias("gap"), F.col(dim).alias("v")))).first()[0]
    return None if found is None else found["v"]


def sround(value: float, digits: int = 0, int_part: bool = False) -> float:
    """Round to so many digits beside the leading one: of 0.0001234 with 2 to 0.000123; whole parts stay unless asked for."""
    if value == 0 or value is None or not math.isfinite(value):
        return value
    lead = math.floor(math.log10(abs(value)))
    places = digits - lead
    return round(value, places if int_part else max(places, digits if lead >= 0 else places))


def sround_range(low: float, high: float, digits: int = 0) -> tuple[float, float]:
    """Both ends rounded by the finer of the two scales of their distance."""
    if high == low:
        return sround(low, digits), sround(high, digits)
    places = digits - math.floor(math.log10(abs(high - low)))
    return round(low, places), round(high, places)


def extract_point(ds: Cube, point: Any, indexers: dict[str, Any] | None = None, tolerance_default: float = 0.01) -> dict[str, Any]:
    """{variable: value, 'lat': ..., 'lon': ...} at the pixel nearest to a point, {} if none is near enough.

    indexers give exact labels of the further dimensions; of frames with other dimensions nothing is taken.
    """
    where = PointLike.convert(point)
    (x, y), = where.parts[0]
    indexers = indexers or {}
    dx, dy = ds.attrs.get("geospatial_lon_resolution") or ds.step("lon"), ds.attrs.get("geospatial_lat_resolution") or ds.step("lat")
    near = (float(dx) + float(dy)) / 2 if dx and dy else tolerance_default
    lat, lon = nearest_label(ds, "lat", y), nearest_label(ds, "lon", x)
    if lat is None or abs(lat - y) > near or abs(lon - x) > near:
        return {}
    out = {}
    for dims, frame in {ds.dims: ds.df.select(*ds.dims, *ds.vars), **ds.sides}.items():
        if set(dims) != {"lat", "lon"} | (set(dims) & set(indexers)) or "lat" not in dims:
            continue
        test = (F.col("lat") == lat) & (F.col("lon") == lon)
        for d in set(dims) & set(indexers):
            test = test & (F.col(d) == F.lit(indexers[d]))
        row = frame.where(test).first()
        if row is not None:
            out |= {v: sround(row[v], 3) if isinstance(row[v], float) else row[v] for v in frame.columns if v not in dims}
    return out | {"lat": sround(lat, 3), "lon": sround(lon, 3)} if out else out
