"""Merging of cubes, and scaling of variables along a dimension."""

from __future__ import annotations

from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError
from ..likes import DimName, VarNamesLike
from ..op import op

JOINS = {"outer": "full_outer", "inner": "inner", "left": "left", "right": "right", "exact": "inner"}
COMPAT = ("identical", "equals", "broadcast_equals", "no_conflicts")


@op(tags=("merge", "utility"), join=dict(value_set=list(JOINS)), compat=dict(value_set=list(COMPAT)))
def merge(ds_1: Cube, ds_2: Cube | None = None, ds_3: Cube | None = None, ds_4: Cube | None = None, join: str = "outer", compat: str = "no_conflicts") -> Cube:
    """Merge cubes on the dimensions they share. Variables that several have must agree where they have values
    (no_conflicts), or in missing values too (the other kinds)."""
    cubes: list[Cube] = []
    for c in (ds_1, ds_2, ds_3, ds_4):
        if c is not None and not any(c is x for x in cubes):
            cubes.append(c)
    if not cubes:
        raise ValidationError("At least two different datasets must be given")
    return fold(lambda a, b: _merge(a, b, join, compat), cubes)


def _merge(a: Cube, b: Cube, join: str, compat: str) -> Cube:
    keys = [d for d in a.dims if d in b.dims]
    if not keys:
        raise ValidationError("the datasets share no dimension")
    both = [v for v in b.vars if v in a.vars]
    left = a.df.withColumn("_in_a", F.lit(True))
    right = b.df.select(*b.dims, *(F.col(v).alias(f"_{v}") for v in both), *[v for v in b.vars if v not in both]).withColumn("_in_b", F.lit(True))
    if join == "exact":
        outer = left.join(right, keys, "full_outer").where(F.col("_in_a").isNull() | F.col("_in_b").isNull())
        if not outer.isEmpty():
            raise ValidationError("indexes along the shared dimensions are not equal")
    joined = left.join(right, keys, JOINS[join])
    if both:
        met = F.col("_in_a") & F.col("_in_b")
        clash = [(F.col(v) != F.col(f"_{v}")) if compat == "no_conflicts" else ~F.col(v).eqNullSafe(F.col(f"_{v}")) for v in both]
        if not joined.where(met & fold(lambda x, y: x | y, clash)).isEmpty():
            raise ValidationError("conflicting values for variables " + ", ".join(both))
    dims = [*a.dims, *[d for d in b.dims if d not in a.dims]]
    names = {**a.vars, **{v: m for v, m in b.vars.items() if v not in a.vars}}
    df = joined.select(*dims, *((F.coalesce(v, f"_{v}").alias(v) if v in both else F.col(v)) for v in names))
    return Cube(df, tuple(dims), names, {**b.attrs, **a.attrs}, {**b.coord_attrs, **a.coord_attrs}, {**b.sides, **a.sides})


def _ranged(ds: Cube, names: list[str], dim: str, suffix: str | None, tag: str, drop: bool, scaled: Any) -> Cube:
    ds.require(dim)
    over = Window.partitionBy(*ds.others(dim))
    end = f"_{tag}" if suffix is None else f"_{suffix.lstrip('_')}"
    made = {f"{v}{end}": scaled(v, over) for v in names}
    kept = [v for v in ds.vars if not (drop and v in names)]
    df = ds.df.select(*ds.dims, *kept, *(c.alias(k) for k, c in made.items()))
    return ds.with_(df=df, vars={**{v: ds.vars[v] for v in kept}, **{k: {} for k in made}})


@op(tags=("utility", "normalise"), var_names=dict(data_type=VarNamesLike, nullable=True), dim=dict(data_type=DimName))
def normalise_vars(ds: Cube, var_names: Any = None, min_value: float = 0, max_value: float = 1, dim: str = "time", suffix: str | None = None, drop_original: bool = False) -> Cube:
    """Add variables scaled along a dimension: (x - least of all) * (max_value - min_value) / (range along the dimension).

    A range of zero gives no value.
    """
    if min_value >= max_value:
        raise ValidationError("min_value must be less than max_value")
    names = VarNamesLike.pick(var_names, list(ds.vars))
    least = ds.df.agg(*(F.min(v).alias(v) for v in names)).first()

    def scaled(v: str, over: Any) -> Column:
        width = F.max(v).over(over) - F.min(v).over(over)
        return F.when(width != 0, (F.col(v) - F.lit(least[v])) * float(max_value - min_value) / F.nullif(width, F.lit(0.0)))

    return _ranged(ds, names, dim, suffix, "norm", drop_original, scaled)


@op(tags=("utility", "standardise"), var_names=dict(data_type=VarNamesLike, nullable=True), dim=dict(data_type=DimName))
def standardise_vars(ds: Cube, var_names: Any = None, dim: str = "time", suffix: str | None = None, drop_original: bool = False) -> Cube:
    """Add variables less their mean along a dimension, by their population deviation; no value where that is zero."""
    names = VarNamesLike.pick(var_names, list(ds.vars))

    def scaled(v: str, over: Any) -> Column:
        return (F.col(v) - F.avg(v).over(over)) / F.nullif(F.stddev_pop(v).over(over), F.lit(0.0))

    return _ranged(ds, names, dim, suffix, "stand", drop_original, scaled)
