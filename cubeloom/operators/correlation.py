"""Correlations of variables, in pairs and in groups."""

from __future__ import annotations

from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError
from ..likes import DimName, VarNamesLike
from ..op import op
from ..shipping import ship


@op(tags=("correlation",), ds_1_var_names=dict(data_type=VarNamesLike, nullable=True), ds_2_var_names=dict(data_type=VarNamesLike, nullable=True), dim=dict(data_type=DimName))
def pairwise_var_correlation(ds_1: Cube, ds_2: Cube, ds_1_var_names: Any = None, ds_2_var_names: Any = None, dim: str = "time") -> Cube:
    """corr_<a>_<b>: Pearson's correlation along a dimension of each variable of one cube with each of the other, over
    cells where both have values; none where one does not vary."""
    a, b = VarNamesLike.pick(ds_1_var_names, list(ds_1.vars)), VarNamesLike.pick(ds_2_var_names, list(ds_2.vars))
    keys = [d for d in ds_1.dims if d in ds_2.dims]
    rest = [d for d in keys if d != dim]
    joined = ds_1.df.select(*keys, *(F.col(v).alias(f"a_{v}") for v in a)).join(ds_2.df.select(*keys, *(F.col(v).alias(f"b_{v}") for v in b)), keys)
    made = []
    for x in a:
        for y in b:
            met = F.col(f"a_{x}").isNotNull() & F.col(f"b_{y}").isNotNull()
            p, q = F.when(met, F.col(f"a_{x}").cast("double")), F.when(met, F.col(f"b_{y}").cast("double"))
            made.append((F.covar_pop(p, q) / F.nullif(F.stddev_pop(p) * F.stddev_pop(q), F.lit(0.0))).alias(f"corr_{x}_{y}"))
    return Cube(joined.groupBy(*rest).agg(*made), tuple(rest), {f"corr_{x}_{y}": {} for x in a for y in b})


def canonical_correlation(xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """The first canonical correlation of each of many pairs of groups, from their matrices of products (pairs, p, p), (pairs,
    q, q) and (pairs, p, q). Directions without spread do not count; without any there is none."""

    def whitening(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 0))
        scale = np.where(scale > 0, scale, np.inf)
        size, turn = np.linalg.eigh(m / (scale[:, :, None] * scale[:, None, :]))
        counts = size > 1e-10 * np.maximum(1.0, size.max(axis=1, keepdims=True))
        return turn * np.where(counts, 1 / np.sqrt(np.where(counts, size, 1)), 0)[:, None, :] / scale[:, :, None], counts.any(axis=1)

    (p, some_p), (q, some_q) = whitening(xx), whitening(yy)
    first = np.linalg.norm(p.transpose(0, 2, 1) @ xy @ q, ord=2, axis=(1, 2))
    return np.where(some_p & some_q, np.minimum(first, 1.0), np.nan)


def common_direction(xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """As canonical_correlation, of two groups of features over the same few samples, from their matrices of products of samples."""

    def span(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, turn = np.linalg.eigh(m)
        counts = size > 1e-10 * np.maximum(1e-300, size.max(axis=1, keepdims=True))
        return turn * counts[:, None, :], counts.any(axis=1) & (size.max(axis=1) > 0)

    (p, some_p), (q, some_q) = span(xx), span(yy)
    first = np.linalg.norm(p.transpose(0, 2, 1) @ q, ord=2, axis=(1, 2))
    return np.where(some_p & some_q, np.minimum(first, 1.0), np.nan)


@op(tags=("correlation", "canonical"), ds_1_var_names=dict(data_type=VarNamesLike, nullable=True), ds_2_var_names=dict(data_type=VarNamesLike, nullable=True), num_components=dict(data_type=int))
def pixelwise_group_correlation(ds_1: Cube, ds_2: Cube, ds_1_var_names: Any = None, ds_2_var_names: Any = None, num_components: int = 2, reference_orientation: bool = False) -> Cube:
    """The first canonical correlation of two groups of variables in each pixel, with time steps as samples, or variables
    as samples with reference_orientation. A pixel with a missing value has none.

    One aggregate sums the products of each pixel's variables; a small problem of eigenvalues is left for each row."""
    a, b = VarNamesLike.pick(ds_1_var_names, list(ds_1.vars)), VarNamesLike.pick(ds_2_var_names, list(ds_2.vars))
    if set(ds_1.dims) != {"time", "lat", "lon"} or set(ds_2.dims) != set(ds_1.dims):
        raise ValidationError("both datasets need the dimensions time, lat and lon")
    keys = ["time", "lat", "lon"]
    left = ds_1.df.select(*keys, *(F.col(v).cast("double").alias(f"a_{v}") for v in a)).withColumn("_a", F.lit(True))
    right = ds_2.df.select(*keys, *(F.col(v).cast("double").alias(f"b_{v}") for v in b)).withColumn("_b", F.lit(True))
    joined = left.join(right, keys, "full_outer")
    if not joined.where(F.col("_a").isNull() | F.col("_b").isNull()).isEmpty():
        raise ValidationError("the coordinates of the datasets must be equal")

    x, y = [F.col(f"a_{v}") for v in a], [F.col(f"b_{v}") for v in b]
    turned = reference_orientation and len(a) == len(b)
    if turned:  # variables are samples: each time step is a feature, centred and scaled over the variables
        x, y = _scaled(x), _scaled(y)
        product = lambda p, q: F.sum(p * q)
    else:
        product = F.covar_pop
    table = lambda p, q: F.array(*(product(i, j) for i in p for j in q))
    present = reduce(lambda p, q: p & q, [v.isNotNull() & ~F.isnan(v) for v in (*x, *y)])
    sums = joined.groupBy("lat", "lon").agg(table(x, x).alias("xx"), table(y, y).alias("yy"), table(x, y).alias("xy"), F.count(F.when(~present, 1)).alias("gaps"), F.count("*").alias("n"))
    np_, nq = len(a), len(b)

    @F.pandas_udf("double")
    def correlation(xx: pd.Series, yy: pd.Series, xy: pd.Series) -> pd.Series:
        stack = lambda s, r, c: np.array(s.tolist(), float).reshape(len(s), r, c)
        if not len(xx):
            return pd.Series([], dtype=float)
        found = common_direction(stack(xx, np_, np_), stack(yy, nq, nq)) if turned else canonical_correlation(stack(xx, np_, np_), stack(yy, nq, nq), stack(xy, np_, nq))
        return pd.Series(np.where(np.isnan(found), None, found))

    ship(joined.sparkSession)
    enough = (F.col("gaps") == 0) & ((F.col("n") >= 2) if not turned else F.lit(True))
    zero = lambda c: F.transform(c, lambda v: F.coalesce(v, F.lit(0.0)))
    df = sums.select("lat", "lon", F.when(enough, correlation(zero("xx"), zero("yy"), zero("xy"))).alias("correlation"))
    return Cube(df, ("lat", "lon"), {"correlation": {}})


def _scaled(columns: list[Column]) -> list[Column]:
    """Columns less their mean over their population deviation, row by row; as they are less the mean where they do not vary."""
    n = len(columns)
    mean = reduce(lambda p, q: p + q, columns) / n
    spread = F.sqrt(reduce(lambda p, q: p + q, [(c - mean) * (c - mean) for c in columns]) / n)
    return [(c - mean) / F.when(spread > 0, spread).otherwise(1.0) for c in columns]
