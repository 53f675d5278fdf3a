"""Tables and tables with geometries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, small
from ..functions import geometry as g
from ..functions.quantiles import aggregated
from ..functions.query_parser import geometry_test, parse_query
from ..likes import CubeLike, DataFrameLike, GeometryLike, PointLike, PolygonLike, VarNamesLike
from ..op import op
from .lookup import with_nearest

COUNTED = ("double", "bigint", "boolean")
FIGURES = ("count", "mean", "median", "sum", "std", "min", "max")


@op(tags=("aggregate", "data_frame"), df=dict(data_type=DataFrameLike), var_names=dict(data_type=VarNamesLike, nullable=True), aggregate_geometry=dict(data_type=bool))
def aggregate_statistics(df: DataFrame, var_names: Any = None, aggregate_geometry: bool = False) -> DataFrame:
    """One row with <column>_count, _mean, _median, _sum, _std (of a sample), _min and _max, and the parts of all geometries if asked for."""
    types = dict(df.dtypes)
    if var_names:
        absent = [v for v in var_names if v not in types]
        if absent:
            raise ValidationError(f"Variable {absent[0]} not in data frame!")
        if any(types[v] not in COUNTED for v in var_names):
            raise ValidationError("Var names do not contain any aggregatable columns.")
    names = list(var_names or [c for c, t in types.items() if t in COUNTED])
    if not names:
        raise ValidationError("Var names do not contain any aggregatable columns.")
    made, middles = [], {}
    for v in names:
        x = F.col(v).cast("int") if types[v] == "boolean" else F.col(v)
        middles[f"{v}_median"] = x
        of = {"count": F.count, "mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
        made += [of[m](x).alias(f"{v}_{m}") for m in FIGURES if m != "median"]
    if aggregate_geometry and "geometry" in types:
        parts = F.collect_set("geometry")  # a union of geometries is a value of their size
        made.append(parts.alias("geometry"))
    last = ["geometry"] if aggregate_geometry and "geometry" in types else []
    return aggregated(df, [], made, middles).select(*(f"{v}_{m}" for v in names for m in FIGURES), *last)


def _extreme(df: DataFrame, var: str, least: bool) -> DataFrame:
    if var not in df.columns:
        raise ValidationError(f"Variable {var} not in data frame!")
    row = F.monotonically_increasing_id()
    order = F.col(var).asc() if least else F.col(var).desc()
    return df.where(F.col(var).isNotNull()).withColumn("_row", row).orderBy(order, "_row").limit(1).drop("_row")


@op(tags=("filter", "data_frame"), df=dict(data_type=DataFrameLike))
def data_frame_min(df: DataFrame, var: str) -> DataFrame:
    """The first record with the least value."""
    return _extreme(df, var, True)


@op(tags=("filter", "data_frame"), df=dict(data_type=DataFrameLike))
def data_frame_max(df: DataFrame, var: str) -> DataFrame:
    """The first record with the greatest value."""
    return _extreme(df, var, False)


@op(tags=("filter", "data_frame"), df=dict(data_type=DataFrameLike))
def query(df: DataFrame, query_expr: str, crs: str | None = None) -> DataFrame:
    """Rows for which an expression holds, with tests such as @within('POLYGON (...)') of the column geometry.

    Regions are given in longitude and latitude; crs names the table's system if that is another.
    """
    return df.where(parse_query(query_expr, df, crs=crs))


@op(tags=("filter", "data_frame"), df=dict(data_type=DataFrameLike), region=dict(data_type=GeometryLike, nullable=True), var_names=dict(data_type=VarNamesLike, nullable=True), region_op=dict(value_set=sorted(g.POINT_TESTS)))
def data_frame_subset(df: DataFrame, region_op: str = "intersects", region: Any = None, var_names: Any = None) -> DataFrame:
    """Columns (the geometry stays), and rows whose geometry is so to a region."""
    if region is not None:
        df = df.where(geometry_test(region_op, region))
    if var_names:
        names = VarNamesLike.pick(var_names, df.columns)
        df = df.select(*[c for c in df.columns if c in names or c == "geometry"])
    return df


@op(tags=("conversion",), ds=dict(data_type=CubeLike))
def to_dataframe(ds: Cube) -> DataFrame:
    """The cube's table."""
    return ds.df


@op(tags=("conversion",), df=dict(data_type=DataFrameLike))
def to_dataset(df: DataFrame, dims: Any = ("time", "lat", "lon")) -> Cube:
    """The cube of a table, with those of the named dimensions that it has."""
    return Cube.of(df, [d for d in VarNamesLike.convert(dims) if d in df.columns])


@op(tags=("conversion", "geometric"), df=dict(data_type=DataFrameLike))
def as_geodataframe(df: DataFrame, geometry: str | None = None, spatial_coords: Any = None, crs: str = "EPSG:4326") -> DataFrame:
    """A table with a column geometry: one that is named, points of two columns (x, y), or of lon/lat, longitude/latitude or x/y."""
    if geometry is not None:
        if geometry not in df.columns:
            raise ValidationError(f"column {geometry!r} not in data frame")
        return df.withColumn("geometry", F.col(geometry)) if geometry != "geometry" else df
    if spatial_coords is None:
        if "geometry" in df.columns:
            return df
        spatial_coords = next((p for p in (("lon", "lat"), ("longitude", "latitude"), ("x", "y")) if set(p) <= set(df.columns)), None)
    if spatial_coords is None or not set(spatial_coords) <= set(df.columns):
        raise ValidationError("Cannot create geometry: no coordinates found.")
    return df.withColumn("geometry", g.point_column(F.col(spatial_coords[0]), F.col(spatial_coords[1])))


@op(tags=("geometric", "point", "extraction"), gdf=dict(data_type=DataFrameLike), ds=dict(data_type=CubeLike), var_names=dict(data_type=VarNamesLike, nullable=True), interpolation=dict(value_set=["nearest", "linear"]))
def add_dataset_values_to_geodataframe(gdf: DataFrame, ds: Cube, var_names: Any = None, interpolation: str = "nearest", time_name: str | None = None, var_prefix: str | None = None) -> DataFrame:
    """The values of a cube at the points (or centroids) of a table, at the table's time if it is named."""
    names = VarNamesLike.pick(var_names, list(ds.vars))
    lat, lon = ds.labels("lat"), ds.labels("lon")
    dy, dx = lat[1] - lat[0], lon[1] - lon[0]
    middle = g.centroid_column(F.col("geometry"))
    rows = gdf.withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", middle)
    fy, fx = (F.col("_c.y") - lat[0]) / dy, (F.col("_c.x") - lon[0]) / dx
    inside = fy.between(-0.5, len(lat) - 0.5) & fx.between(-0.5, len(lon) - 0.5)
    number = lambda v, at, step: F.round((F.col(v) - at) / step).cast("int")
    cells = ds.df.select(*([F.col("time").alias("_t")] if "time" in ds.dims and time_name else []), number("lat", lat[0], dy).alias("_iy"), number("lon", lon[0], dx).alias("_ix"), *(F.col(v).alias(f"_v_{v}") for v in names))
    keys = ["_iy", "_ix"]
    if "time" in ds.dims:
        if not time_name:
            raise ValidationError("the cube has times: name the table's column of time")
        rows = with_nearest(rows, F.col(time_name).cast("timestamp_ntz"), ds.coord("time"), "_t")
        keys.append("_t")
    if interpolation == "nearest":
        placed = rows.withColumn("_iy", F.when(inside, F.round(fy).cast("int"))).withColumn("_ix", F.when(inside, F.round(fx).cast("int")))
        out = placed.join(cells, keys, "left")
        made = out.select(*gdf.columns, *(F.col(f"_v_{v}").alias(f"{var_prefix or ''}{v}") for v in names))
        return made
    y0, x0 = F.floor(F.least(F.greatest(fy, F.lit(0.0)), F.lit(len(lat) - 1.0))), F.floor(F.least(F.greatest(fx, F.lit(0.0)), F.lit(len(lon) - 1.0)))
    ty, tx = F.least(F.greatest(fy, F.lit(0.0)), F.lit(len(lat) - 1.0)) - y0, F.least(F.greatest(fx, F.lit(0.0)), F.lit(len(lon) - 1.0)) - x0
    corner = F.array(*(F.struct((y0 + a).cast("int").alias("_iy"), (x0 + b).cast("int").alias("_ix"), ((ty if a else 1 - ty) * (tx if b else 1 - tx)).alias("_w")) for a in (0, 1) for b in (0, 1)))
    each = rows.withColumn("_k", F.explode(F.when(inside, F.filter(corner, lambda c: c["_w"] > 0)).otherwise(F.array(corner[0])))).withColumn("_in", inside).select("*", "_k.*")
    met = each.join(cells, keys, "left")
    value = lambda v: F.when(F.first("_in") & (F.count(F.when(F.col(f"_v_{v}").isNull(), 1)) == 0), F.sum(F.col(f"_v_{v}") * F.col("_w")))
    own = met.groupBy("_id").agg(F.first(F.struct(*(F.col(f"`{c}`") for c in gdf.columns))).alias("_row"), *(value(v).alias(f"{var_prefix or ''}{v}") for v in names))
    return own.select("_row.*", *(f"{var_prefix or ''}{v}" for v in names))


@op(tags=("filter", "geometric"), gdf=dict(data_type=DataFrameLike), location=dict(data_type=GeometryLike), max_results=dict(data_type=int), max_dist=dict(data_type=float))
def find_closest(gdf: DataFrame, location: Any, max_results: int = 1, max_dist: float = 180.0, dist_col_name: str = "distance") -> DataFrame:
    """The records nearest to a location, by great-circle degrees, in order; rows without geometry are left out."""
    x, y = location.centroid
    c = g.centroid_column(F.col("geometry"))
    dist = g.great_circle(F.lit(x), F.lit(y), c["x"], c["y"])
    near = gdf.where(F.col("geometry").isNotNull()).withColumn(dist_col_name, dist).where(F.col(dist_col_name) <= max_dist)
    return near.withColumn("_row", F.monotonically_increasing_id()).orderBy(dist_col_name, "_row").limit(max_results).drop("_row")
