"""A labelled data cube as a DataFrame with one row for each cell."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """An input that an operation does not take."""


@dataclass(frozen=True)
class Cube:
    """df holds the dimensions as key columns and the variables as value columns; a missing value is null.

    sides: frames of variables that have fewer dimensions, by their dimensions. Attributes stay on the driver. axes: sorted
    labels of dimensions where an operation made them and so knows them; another frame is taken to have others.
    """

    df: DataFrame
    dims: tuple[str, ...]
    vars: dict[str, dict[str, Any]]
    attrs: dict[str, Any] = field(default_factory=dict)
    coord_attrs: dict[str, dict[str, Any]] = field(default_factory=dict)
    sides: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)
    axes: dict[str, list[Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, dims: tuple[str, ...] | list[str], variables: list[str] | None = None, attrs: dict | None = None) -> Cube:
        """A cube of a table; NaN in variables becomes null, once, here."""
        names = [c for c in df.columns if c not in dims] if variables is None else variables
        floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        cells = df.select(*dims, *((F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)) for c in names))
        return cls(cells, tuple(dims), {n: {} for n in names}, dict(attrs or {}))

    def with_(self, **changes: Any) -> Cube:
        return replace(self, **changes)

    def on(self, df: DataFrame, variables: list[str] | None = None, dims: tuple[str, ...] | None = None) -> Cube:
        """The cube with another frame and the variables it has."""
        names = list(self.vars) if variables is None else variables
        return replace(self, df=df, vars={n: self.vars.get(n, {}) for n in names}, dims=self.dims if dims is None else dims, axes={})

    def require(self, *dims: str) -> None:
        for d in dims:
            if d not in self.dims:
                raise ValidationError(f"the cube has no dimension {d!r}; it has {', '.join(self.dims)}")

    def others(self, *dims: str) -> list[str]:
        return [d for d in self.dims if d not in dims]

    def coord(self, dim: str) -> DataFrame:
        self.require(dim)
        return self.df.select(dim).where(F.col(dim).isNotNull()).distinct()

    def extent(self, dim: str) -> tuple[Any, Any]:
        if self.axes.get(dim):
            return self.axes[dim][0], self.axes[dim][-1]
        low, high = self.df.agg(F.min(dim), F.max(dim)).first()
        return low, high

    def labels(self, dim: str, most: int = 1_000_000) -> list[Any]:
        """The sorted labels of an axis, on the driver; an axis of more than `most` labels is refused, not cut."""
        if dim in self.axes:
            return list(self.axes[dim])
        rows = self.coord(dim).limit(most + 1).collect()
        if len(rows) > most:
            raise ValidationError(f"the axis {dim!r} has more than {most} labels")
        return sorted(r[0] for r in rows)

    def step(self, dim: str) -> float | None:
        """The distance of the first two labels."""
        two = [r[0] for r in self.coord(dim).orderBy(dim).limit(2).collect()]
        return two[1] - two[0] if len(two) == 2 else None

    def densify(self) -> Cube:
        """All combinations of labels, missing cells with null variables."""
        grid = None
        for d in self.dims:
            grid = self.coord(d) if grid is None else grid.crossJoin(self.coord(d))  # a grid is what is asked for
        return self.on(grid.join(self.df, list(self.dims), "left")) if grid is not None else self

    def select(self, names: list[str]) -> Cube:
        kept = [n for n in self.vars if n in names]
        return self.on(self.df.select(*self.dims, *kept), kept)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cos_lat(lat: str | Column = "lat") -> Column:
    return F.cos(F.radians(lat))
