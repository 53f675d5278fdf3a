"""What plots show, as tables: slices, lines, pairs, bins and classes. Rendering is left to a plotting library."""

from __future__ import annotations

import math
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError
from ..likes import DictLike, PolygonLike, VarNamesLike, to_datetime
from ..op import op
from .subset import nearest_label

PROJECTIONS = ("PlateCarree", "LambertCylindrical", "Mercator", "Mollweide", "Robinson", "TransverseMercator", "NorthPolarStereo", "SouthPolarStereo", "Miller", "InterruptedGoodeHomolosine")


def check_bounding_box(lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> bool:
    return lat_min < lat_max and lon_min < lon_max and -90 <= lat_min and lat_max <= 90 and -180 <= lon_min and lon_max <= 180


def handle_plot_polygon(region: Any) -> tuple[float, float, float, float] | None:
    if region is None:
        return None
    x0, y0, x1, y1 = PolygonLike.convert(region).bounds
    if not check_bounding_box(y0, y1, x0, x1):
        raise ValidationError("Provided plot extents do not form a valid bounding box within [-180.0,+180.0,-90.0,+90.0]")
    return x0, y0, x1, y1


def get_vars_data(ds: Cube, names: Any = None, indexers: Any = None, remaining_dims: Any = None) -> DataFrame:
    """Variables where dimensions are fixed: a label means the nearest one, a pair a range; dimensions that are neither
    fixed nor to remain are taken at their first label."""
    indexers = dict(DictLike.convert(indexers) or {})
    names = VarNamesLike.pick(names, list(ds.vars))
    remain = VarNamesLike.convert(remaining_dims) or []
    unknown = [d for d in [*indexers, *remain] if d not in ds.dims]
    if unknown:
        raise ValidationError(f"there is no dimension {unknown[0]!r}")
    df, left = ds.df, [d for d in ds.dims if d not in indexers]
    for d, at in indexers.items():
        if isinstance(at, (tuple, list, slice)):
            low, high = (at.start, at.stop) if isinstance(at, slice) else at
            df, left = df.where(F.col(d).between(low, high)), [*left, d]
        else:
            timed = dict(ds.df.dtypes)[d].startswith("timestamp")
            label = nearest_label(ds, d, to_datetime(at) if timed and not isinstance(at, datetime) else at)
            df = df.where(F.col(d) == F.lit(label).cast(ds.df.schema[d].dataType))
    for d in [d for d in left if remain and d not in remain]:
        first = ds.extent(d)[0]
        df, left = df.where(F.col(d) == F.lit(first).cast(ds.df.schema[d].dataType)), [x for x in left if x != d]
    return df.select(*[d for d in ds.dims if d in left], *names)


def get_var_data(ds: Cube, name: str, indexers: Any = None, remaining_dims: Any = None) -> DataFrame:
    return get_vars_data(ds, name, indexers, remaining_dims)


@op(tags=("plot",), projection=dict(value_set=list(PROJECTIONS)))
def plot_map(ds: Cube, var: Any = None, indexers: Any = None, region: Any = None, projection: str = "PlateCarree") -> DataFrame:
    """lat, lon and the value of the first variable in a region."""
    df = get_vars_data(ds, VarNamesLike.pick(var, list(ds.vars))[0], indexers, ["lat", "lon"])
    box = handle_plot_polygon(region)
    df = df if box is None else df.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    n = df.agg(F.count_distinct("lat"), F.count_distinct("lon")).first()
    if min(n) < 2:
        raise ValidationError("a map needs at least two rows and columns")
    return df


@op(tags=("plot",))
def plot_contour(ds: Cube, var: Any, indexers: Any = None) -> DataFrame:
    """The two-dimensional slice of a variable."""
    return _slice(ds, var, indexers, (2,))


@op(tags=("plot",))
def plot(ds: Cube, var: Any, indexers: Any = None) -> DataFrame:
    """The line or image of a variable."""
    return _slice(ds, var, indexers, (1, 2))


def _slice(ds: Cube, var: Any, indexers: Any, sizes: tuple[int, ...]) -> DataFrame:
    df = get_vars_data(ds, var, indexers)
    dims = [c for c in df.columns if c in ds.dims]
    if len(dims) not in sizes:
        raise ValidationError(f"the plot needs {' or '.join(map(str, sizes))} dimensions, not {len(dims)}; fix others by indexers")
    return df.orderBy(*dims)


@op(tags=("plot",))
def plot_line(ds: Cube, var_names: Any, indexers: Any = None) -> DataFrame:
    """Variables along their one dimension left, in order."""
    return _slice(ds, var_names, indexers, (1,))


@op(tags=("plot",))
def plot_categorical(ds: Cube, var: Any, classes: Any, indexers: Any = None) -> DataFrame:
    """A variable with the label and colour of its class: classes is a list of (value, label, colour)."""
    df = get_vars_data(ds, var, indexers)
    v = VarNamesLike.pick(var, list(ds.vars))[0]
    table = ds.df.sparkSession.createDataFrame([(float(a), str(b), str(c)) for a, b, c in classes], "_value double, label string, color string")
    return df.join(F.broadcast(table), F.col(v).cast("double") == F.col("_value"), "left").drop("_value")


@op(tags=("plot",))
def plot_categorical_continuous(ds: Cube, var: Any, classes: Any, indexers: Any = None, value_range: Any = None) -> DataFrame:
    """As plot_categorical; other values have their place from 0 to 1 in a range, by default their own."""
    df = plot_categorical(ds, var, classes, indexers)
    v = VarNamesLike.pick(var, list(ds.vars))[0]
    if value_range is None:
        value_range = df.where(F.col("label").isNull()).agg(F.min(v), F.max(v)).first()
    low, high = value_range
    if low is None or high == low:
        return df.withColumn("scaled", F.lit(None).cast("double"))
    return df.withColumn("scaled", F.when(F.col("label").isNull(), (F.col(v) - low) / (high - low)))


@op(tags=("plot",), month=dict(data_type=int, value_range=(1, 12)))
def plot_fire_jd(ds: Cube, var: Any, year: int, month: int, indexers: Any = None) -> DataFrame:
    """Days of the year of a month, with their place in the month from 0 to 1."""
    v = VarNamesLike.pick(var, list(ds.vars))[0]
    first = datetime(year, month, 1)
    last = datetime(year + month // 12, month % 12 + 1, 1)
    a, b = first.timetuple().tm_yday, first.timetuple().tm_yday + (last - first).days - 1
    return get_vars_data(ds, v, indexers).where(F.col(v).between(a, b)).withColumn("scaled", (F.col(v) - a) / (b - a))


@op(tags=("plot",), type=dict(value_set=["Point", "Hexbin", "2D Histogram"]))
def plot_scatter(ds1: Cube, ds2: Cube, var1: str, var2: str, indexers1: Any = None, indexers2: Any = None, type: str = "2D Histogram", bins: int = 256) -> DataFrame:
    """Pairs of two variables in cells of both, or the count of pairs in bins."""
    a, b = get_vars_data(ds1, var1, indexers1), get_vars_data(ds2, var2, indexers2)
    keys = [c for c in a.columns if c in ds1.dims]
    if set(keys) != {c for c in b.columns if c in ds2.dims}:
        raise ValidationError("both variables need the same dimensions left")
    pairs = a.select(*keys, F.col(var1).alias("x")).join(b.select(*keys, F.col(var2).alias("y")), keys).where("x IS NOT NULL AND y IS NOT NULL")
    return pairs if type == "Point" else histogram_2d(pairs, "x", "y", bins)


def _bin(x: str, low: float, high: float, bins: int) -> Any:
    width = (high - low) / bins
    return F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 256) -> DataFrame:
    x0, x1, y0, y1 = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if x0 is None:
        return df.select(F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(0).cast("long").alias("count")).limit(0)
    return df.groupBy(_bin(x, x0, x1, bins).alias("bx"), _bin(y, y0, y1, bins).alias("by")).agg(F.count("*").alias("count"))


@op(tags=("plot",), bins=dict(data_type=int))
def plot_hist(ds: Cube, var: str, indexers: Any = None, bins: int = 10) -> DataFrame:
    """bin, low, high, count of a variable's values in bins of equal width; the last one is closed."""
    df = get_vars_data(ds, var, indexers).where(F.col(var).isNotNull())
    low, high = df.agg(F.min(var), F.max(var)).first()
    if low is None:
        raise ValidationError("there are no values")
    width = (high - low) / bins
    counted = df.groupBy(_bin(var, low, high, bins).alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


@op(tags=("plot",))
def animate_map(ds: Cube, var: Any = None, animate_dim: str = "time", region: Any = None, indexers: Any = None) -> list:
    """(label, table of lat, lon and value) of each step of a dimension, and (least, greatest) value for one scale."""
    v = VarNamesLike.pick(var, list(ds.vars))[0]
    low, high = ds.df.agg(F.min(v), F.max(v)).first()
    if low is None:
        raise ValidationError("the variable has no values")
    kind = ds.df.schema[animate_dim].dataType
    box = handle_plot_polygon(region)
    cells = ds.df if box is None else ds.df.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return [(t, cells.where(F.col(animate_dim) == F.lit(t).cast(kind)).select("lat", "lon", v), (low, high)) for t in ds.labels(animate_dim, 10_000)]


def determine_cmap_params(low: float, high: float, cmap: str | None = None, center: float | None = None, robust: bool = False, levels: int | None = None, extend: str | None = None) -> dict[str, Any]:
    """Range, colour map, levels and arrows for values from low to high: divergent around a centre or if they change sign."""
    divergent = center is not None or (low < 0 < high)
    if divergent:
        middle = center or 0.0
        reach = max(abs(low - middle), abs(high - middle))
        low_, high_ = middle - reach, middle + reach
    else:
        low_, high_ = low, high
    steps = [low_ + (high_ - low_) * k / levels for k in range(levels + 1)] if levels else None
    arrows = extend or {(True, True): "both", (True, False): "min", (False, True): "max", (False, False): "neither"}[(low < low_, high > high_)]
    return {"vmin": low_, "vmax": high_, "cmap": cmap or ("RdBu_r" if divergent else "viridis"), "levels": steps, "extend": arrows}


def class_bounds(values: list[float]) -> list[float]:
    """Bounds halfway between the values of classes, and as far beyond the ends."""
    v = sorted(values)
    if len(v) == 1:
        return [v[0] - 0.5, v[0] + 0.5]
    mid = [(a + b) / 2 for a, b in zip(v, v[1:])]
    return [v[0] - (mid[0] - v[0]), *mid, v[-1] + (v[-1] - mid[-1])]


def nice_ticks(low: float, high: float, n: int = 5) -> list[float]:
    step = 10 ** math.floor(math.log10((high - low) / n)) if high > low else 1.0
    step *= next(k for k in (1, 2, 5, 10) if (high - low) / (step * k) <= n)
    first = math.ceil(low / step) * step
    return [first + k * step for k in range(int((high - first) / step + 1e-9) + 1)]
