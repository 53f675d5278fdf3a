"""Selection of variables and of features by value."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..likes import DataFrameLike, DictLike, VarNamesLike
from ..op import op


@op(tags=("select", "subset", "filter", "var"), var=dict(data_type=VarNamesLike, nullable=True))
def select_var(ds: Cube, var: Any = None) -> Cube:
    """Keep the variables that match any pattern; coordinates stay. Without patterns all stay.

    :param ds: the cube
    :param var: names or patterns
    """
    if not var:
        return ds
    sides = {d: f.select(*[c for c in f.columns if c in d or c in VarNamesLike.pick(var, f.columns)]) for d, f in ds.sides.items()}
    return ds.select(VarNamesLike.pick(var, list(ds.vars))).with_(sides={d: f for d, f in sides.items() if len(f.columns) > len(d)})


@op(tags=("select", "filter"), df=dict(data_type=DataFrameLike), var=dict(data_type=DictLike, nullable=True))
def select_features(df: DataFrame, var: Any = None) -> DataFrame:
    """Keep rows that have any of the given values: {column: value}."""
    if not var:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.col(k) == F.lit(v) for k, v in var.items()]))


@op(tags=("filter",))
def where(ds: Cube, condition: Any = None) -> Cube:
    """Keep the cube's shape; variables of cells that do not meet the condition are missing."""
    test: Column = F.expr(condition) if isinstance(condition, str) else condition
    return ds.on(ds.df.select(*ds.dims, *(F.when(test, F.col(v)).alias(v) for v in ds.vars)))
