"""Arithmetic on all variables, and the difference of two cubes."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..cube import Cube, ValidationError, small
from ..op import op

_POSITIVE = {"log": F.log, "log10": F.log10, "log2": F.log2}


def apply_ops(x: Column, ops: str) -> Column:
    """Operations from left to right: log, log10, log2, log1p, exp, +c, -c, *c, /c. Values without a result are null."""
    for item in ops.split(","):
        name = item.strip()
        m = re.fullmatch(r"([-+*/])\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", name)
        if name in _POSITIVE:
            x = F.when(x > 0, _POSITIVE[name](x))
        elif name == "log1p":
            x = F.when(x > -1, F.log1p(x))
        elif name == "exp":
            x = F.exp(x)
        elif m:
            c = float(m.group(2))
            x = x + c if m.group(1) == "+" else x - c if m.group(1) == "-" else x * c if m.group(1) == "*" else (x / c if c else F.lit(None).cast("double"))
        else:
            raise ValidationError(f"Arithmetic operation {name!r} not implemented.")
    return x


@op(tags=("arithmetic",), ops=dict(data_type=str))
def arithmetics(ds: Cube, ops: str) -> Cube:
    """Apply operations, separated by commas, to every variable."""
    return ds.on(ds.df.select(*ds.dims, *(apply_ops(F.col(v), ops).alias(v) for v in ds.vars)))


def _numbered(ds: Cube) -> Any:
    """The cube with its time steps numbered; the axis alone is ranked."""
    axis = ds.coord("time").withColumn("_step", F.row_number().over(Window.orderBy("time")))
    return ds.df.join(small(axis), "time")


@op(tags=("arithmetic",))
def diff(ds: Cube, ds2: Cube) -> Cube:
    """ds - ds2 for the variables of both, where both have a cell. Dimensions that ds2 lacks, or of which it has a single
    time step, are spread out; time axes of equal length without common labels are paired by position."""
    names = [v for v in ds.vars if v in ds2.vars]
    shared = [d for d in ds.dims if d in ds2.dims]
    right = ds2.df
    if "time" in shared:
        steps = [r[0] for r in ds2.coord("time").limit(2).collect()]
        if len(steps) == 1:
            shared = [d for d in shared if d != "time"]
        elif ds.coord("time").join(ds2.coord("time"), "time", "left_semi").isEmpty():
            n1, n2 = ds.coord("time").count(), ds2.coord("time").count()
            if n1 == n2:
                a, b = _numbered(ds), _numbered(ds2)
                keys = ["_step", *[d for d in shared if d != "time"]]
                b = b.select(*keys, *(F.col(v).alias(f"_{v}") for v in names))
                rest = ds.others("time")
                return ds.on(a.join(b, keys).select(F.col("_step").alias("time_index"), *rest, *((F.col(v) - F.col(f"_{v}")).alias(v) for v in names)), names, ("time_index", *rest))
    right = right.select(*shared, *(F.col(v).alias(f"_{v}") for v in names))
    joined = ds.df.join(right if len(shared) == len(ds.dims) else small(right), shared) if shared else ds.df.crossJoin(small(right))
    return ds.on(joined.select(*ds.dims, *((F.col(v) - F.col(f"_{v}")).alias(v) for v in names)), names)
