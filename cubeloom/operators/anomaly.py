"""Differences from a reference."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, small
from ..likes import PolygonLike, TimeRangeLike
from ..op import op
from .aggregate import reduce
from .arithmetics import arithmetics
from .subset import subset_spatial, subset_temporal


@op(version="1.1", tags=("anomaly", "climatology"))
def anomaly_external(ds: Cube, reference: Any, transform: str | None = None) -> Cube:
    """Subtract a climatology of twelve months, given as a cube (with `month`, or with `time` in twelve steps) or as a path.

    Only cells that both have stay. `transform`: arithmetics applied first.
    """
    if ds.attrs.get("time_coverage_resolution") not in (None, "P1M"):
        raise ValidationError("anomaly_external expects a dataset with a temporal resolution of P1M.")
    ref: DataFrame = reference.df if isinstance(reference, Cube) else ds.df.sparkSession.read.parquet(reference) if isinstance(reference, str) else reference
    if "month" not in ref.columns:
        if "time" not in ref.columns:
            raise ValidationError("the reference has neither month nor time")
        known = reference.axes.get("time") if isinstance(reference, Cube) else None
        steps = known or sorted(r[0] for r in ref.select("time").distinct().limit(13).collect())
        if len(steps) != 12:
            raise ValidationError("the reference must have twelve time steps")
        months = ref.sparkSession.createDataFrame(list(zip(steps, range(1, 13))), f"time {ref.schema['time'].dataType.simpleString()}, month int")
        ref = ref.join(F.broadcast(months), "time")
    elif ref.select("month").distinct().limit(13).count() != 12:
        raise ValidationError("the reference must have twelve months")
    if transform:
        ds = arithmetics(ds, transform)
    names = [v for v in ds.vars if v in ref.columns]
    space = [d for d in ds.dims if d != "time" and d in ref.columns]
    right = ref.select(F.col("month").alias("_month"), *space, *(F.col(v).alias(f"_{v}") for v in names))
    joined = ds.df.withColumn("_month", F.month("time")).join(small(right), ["_month", *space])
    return ds.on(joined.select(*ds.dims, *((F.col(v) - F.col(f"_{v}")).alias(v) for v in names)), names)


@op(version="1.1", tags=("anomaly",), time_range=dict(data_type=TimeRangeLike, nullable=True), region=dict(data_type=PolygonLike, nullable=True), apply_spatial_weighting=dict(data_type=bool))
def anomaly_internal(ds: Cube, time_range: Any = None, region: Any = None, apply_spatial_weighting: bool = True) -> Cube:
    """Subtract the mean over all dimensions of the cube, or of its part in a range of time and a region."""
    part = ds
    if time_range:
        part = subset_temporal(part, time_range)
    if region:
        part = subset_spatial(part, region)
    mean = reduce(part, apply_spatial_weighting=apply_spatial_weighting and "lat" in ds.dims, method="mean").df
    one = F.broadcast(mean.select(*(F.col(v).alias(f"_{v}") for v in ds.vars)))  # a single row
    return ds.on(ds.df.crossJoin(one).select(*ds.dims, *((F.col(v) - F.col(f"_{v}")).alias(v) for v in ds.vars)))
