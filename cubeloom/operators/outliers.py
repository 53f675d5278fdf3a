"""Outliers by thresholds or quantiles."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..cube import Cube, ValidationError
from ..functions.quantiles import quantiles_of
from ..likes import VarNamesLike
from ..op import op


@op(tags=("filter", "outlier"), var=dict(data_type=VarNamesLike), quantiles=dict(data_type=bool), mask=dict(data_type=bool))
def detect_outliers(ds: Cube, var: Any, threshold_low: float = 0.05, threshold_high: float = 0.95, quantiles: bool = True, mask: bool = False) -> Cube:
    """Of the variables that match, drop values not strictly between two thresholds (quantiles of each variable, or values),
    or with `mask` add <var>_outlier_mask: 1 for outliers and missing values, else 0."""
    names = VarNamesLike.pick(var, list(ds.vars))
    if quantiles and not 0 <= threshold_low <= threshold_high <= 1:
        raise ValidationError("quantile thresholds must be between 0 and 1")
    limits = quantiles_of(ds.df, {v: F.col(v) for v in names}, [threshold_low, threshold_high]) if quantiles else dict.fromkeys(names, [threshold_low, threshold_high])
    good = {v: (F.col(v) > limits[v][0]) & (F.col(v) < limits[v][1]) if None not in limits[v] else F.lit(False) for v in names}
    if not mask:
        return ds.on(ds.df.select(*ds.dims, *(F.when(good[v], F.col(v)).alias(v) if v in names else F.col(v) for v in ds.vars)))
    made = {f"{v}_outlier_mask": v for v in names}
    df = ds.df.select("*", *(F.when(good[v], 0).otherwise(1).cast("byte").alias(k) for k, v in made.items()))
    told = {k: {"standard_name": f"{v} status_flag", "_FillValue": 0, "valid_range": (0, 1), "flag_values": [0, 1], "flag_meanings": "not_outlier outlier", "source": f"detect_outliers: {limits[v]}"} for k, v in made.items()}
    linked = {v: {**a, **({"ancillary_variables": f"{a.get('ancillary_variables', '')} {v}_outlier_mask".strip()} if v in names else {})} for v, a in ds.vars.items()}
    return ds.with_(df=df, vars={**linked, **told})
