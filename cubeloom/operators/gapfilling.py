"""Gap filling by a stencil, until nothing changes."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cube import Cube, small
from ..op import op
from ..shipping import ship, stored

KERNEL = ((0.5, 0.7, 0.5), (0.7, 1.0, 0.7), (0.5, 0.7, 0.5))
#: Labels of a side of a tile, and steps of the stencil between two exchanges of borders.
TILE, STEPS = 256, 16


def fill(block: np.ndarray, kernel: np.ndarray, threshold: float = 1.0, steps: int | None = None) -> np.ndarray:
    """Each gap becomes the weighted mean of its neighbours with values if their weights reach the threshold; all gaps at
    once, again and again until none can be filled, or for so many steps."""
    block = block.astype(float).copy()
    h, w = block.shape
    ky, kx = kernel.shape[0] // 2, kernel.shape[1] // 2
    while steps is None or steps > 0:
        steps = None if steps is None else steps - 1
        gap = ~np.isfinite(block)
        if not gap.any() or gap.all():
            return block
        value = np.pad(np.where(gap, 0.0, block), ((ky, ky), (kx, kx)))
        there = np.pad((~gap).astype(float), ((ky, ky), (kx, kx)))
        s, k = np.zeros_like(block), np.zeros_like(block)
        for i in range(kernel.shape[0]):
            for j in range(kernel.shape[1]):
                s += kernel[i, j] * value[i : i + h, j : j + w]
                k += kernel[i, j] * there[i : i + h, j : j + w]
        can = gap & (k >= threshold)
        if not can.any():
            return block
        block[can] = s[can] / k[can]
    return block


def fill_step(cells: DataFrame, group: list[str], kernel: tuple = KERNEL, threshold: float = 1.0) -> DataFrame:
    """One round as relations: cells (group, iy, ix, v) with gaps of null."""
    ky, kx = len(kernel) // 2, len(kernel[0]) // 2
    offsets = [(i - ky, j - kx, float(kernel[i][j])) for i in range(len(kernel)) for j in range(len(kernel[0])) if (i, j) != (ky, kx)]
    around = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(k).alias("k")) for a, b, k in offsets))
    told = cells.where(F.col("v").isNotNull()).select(*group, "iy", "ix", "v", F.explode(around).alias("o")).groupBy(*group, (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") + F.col("o.dx")).alias("ix")).agg((F.sum(F.col("o.k") * F.col("v")) / F.sum("o.k")).alias("_v"), F.sum("o.k").alias("_k"))
    gaps = F.when(F.col("_k") >= threshold, F.col("_v"))
    return cells.join(told, [*group, "iy", "ix"], "left").select(*group, "iy", "ix", F.coalesce("v", gaps).alias("v"))


class Tiles:
    """A grid cut into tiles: rows (slice, ty, tx, one binary block of doubles for each variable)."""

    def __init__(self, ds: Cube, kernel: np.ndarray, tile: int, steps: int) -> None:
        self.names, self.rest, self.kernel, self.tile = list(ds.vars), ds.others("lat", "lon"), kernel, tile
        half = max(kernel.shape[0] // 2, kernel.shape[1] // 2, 1)
        self.axes = {d: np.array(ds.labels(d), float) for d in ("lat", "lon")}
        self.size = {d: len(a) for d, a in self.axes.items()}
        self.many = max(self.size.values()) > tile
        self.steps = max(1, min(steps, tile // half))
        self.halo = self.steps * half
        if half > tile:
            raise ValueError("the kernel reaches over more than a tile")
        kinds = {f.name: f.dataType.simpleString() for f in ds.df.schema}
        self.slice = [f"`{d}` {kinds[d]}" for d in self.rest]
        self.blocks = ", ".join([*self.slice, "_ty int", "_tx int", *(f"`{v}` binary" for v in self.names)])

    def _shape(self, ty: int, tx: int) -> tuple[int, int]:
        return min(self.tile, self.size["lat"] - ty * self.tile), min(self.tile, self.size["lon"] - tx * self.tile)

    def cut(self, ds: Cube) -> DataFrame:
        """The tiles of all slices; those without a cell are whole gaps."""
        cells = ds.df
        for d in ("lat", "lon"):
            labels = T.StructType([T.StructField(d, cells.schema[d].dataType), T.StructField(f"_{d}", T.IntegerType())])
            cells = cells.join(small(cells.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ds.labels(d))], labels)), d)
        place = lambda d: F.floor(F.col(f"_{d}") / self.tile).cast("int")
        cells = cells.select(*self.rest, place("lat").alias("_ty"), place("lon").alias("_tx"), "_lat", "_lon", *(F.col(v).cast("double").alias(v) for v in self.names))
        rows, columns = (-(-self.size[d] // self.tile) for d in ("lat", "lon"))
        grid = cells.sparkSession.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("_ty"), (F.col("id") % columns).cast("int").alias("_tx"))
        if self.rest and self.many:
            grid = ds.df.select(*self.rest).distinct().crossJoin(F.broadcast(grid)) if rows * columns <= 10_000 else ds.df.select(*self.rest).distinct().crossJoin(grid)  # all tiles of all slices are what is asked for
        if self.many:
            cells = cells.unionByName(grid, allowMissingColumns=True)

        def block(part: pd.DataFrame) -> pd.DataFrame:
            ty, tx = int(part["_ty"].iloc[0]), int(part["_tx"].iloc[0])
            shape, some = self._shape(ty, tx), part.dropna(subset=["_lat"])
            out = {d: [part[d].iloc[0]] for d in self.rest} | {"_ty": [ty], "_tx": [tx]}
            for v in self.names:
                b = np.full(shape, np.nan)
                b[some["_lat"].to_numpy(int) - ty * self.tile, some["_lon"].to_numpy(int) - tx * self.tile] = some[v].to_numpy(float)
                out[v] = [b.tobytes()]
            return pd.DataFrame(out)

        return cells.groupBy(*self.rest, "_ty", "_tx").applyInPandas(block, self.blocks)

    def exchange(self, tiles: DataFrame) -> DataFrame:
        """Every tile as it is and the borders that its neighbours need: _ty, _tx are the receiver's, _fy, _fx say where the piece comes from."""
        h, t = self.halo, self.tile

        def give(frames):
            for frame in frames:
                for r in frame.to_dict("records"):
                    ty, tx = int(r["_ty"]), int(r["_tx"])
                    shape = self._shape(ty, tx)
                    rows = []
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            y, x = ty + dy, tx + dx
                            if y < 0 or x < 0 or y * t >= self.size["lat"] or x * t >= self.size["lon"]:
                                continue
                            part = (slice(0, h) if dy < 0 else slice(max(0, shape[0] - h), None) if dy > 0 else slice(None), slice(0, h) if dx < 0 else slice(max(0, shape[1] - h), None) if dx > 0 else slice(None))
                            rows.append({d: r[d] for d in self.rest} | {"_ty": y, "_tx": x, "_fy": -dy, "_fx": -dx} | {v: np.frombuffer(r[v]).reshape(shape)[part].tobytes() for v in self.names})
                    yield pd.DataFrame(rows)

        return tiles.select(*self.rest, "_ty", "_tx", *self.names).mapInPandas(give, ", ".join([*self.slice, "_ty int", "_tx int", "_fy int", "_fx int", *(f"`{v}` binary" for v in self.names)]))

    def step(self, tiles: DataFrame) -> DataFrame:
        """The tiles after some steps of the stencil, exact inside of a border as wide as these reach; _changed: cells filled."""
        h, t = self.halo, self.tile

        def work(part: pd.DataFrame) -> pd.DataFrame:
            ty, tx = int(part["_ty"].iloc[0]), int(part["_tx"].iloc[0])
            own, changed = self._shape(ty, tx), 0
            out = {d: [part[d].iloc[0]] for d in self.rest} | {"_ty": [ty], "_tx": [tx]}
            for v in self.names:
                wide = np.full((own[0] + 2 * h, own[1] + 2 * h), np.nan)
                for fy, fx, data in zip(part["_fy"], part["_fx"], part[v]):
                    there = self._shape(ty + fy, tx + fx)
                    size = (min(h, there[0]) if fy else own[0], min(h, there[1]) if fx else own[1])
                    y, x = (h - size[0] if fy < 0 else h + own[0] if fy > 0 else h), (h - size[1] if fx < 0 else h + own[1] if fx > 0 else h)
                    wide[y : y + size[0], x : x + size[1]] = np.frombuffer(data).reshape(size)
                after = fill(self._inside(wide, ty, tx, own), self.kernel, steps=self.steps)
                core = self._core(after, ty, tx, own)
                changed += int((np.isfinite(core) & ~np.isfinite(wide[h : h + own[0], h : h + own[1]])).sum())
                out[v] = [np.ascontiguousarray(core).tobytes()]
            return pd.DataFrame(out | {"_changed": [changed]})

        return self.exchange(tiles).groupBy(*self.rest, "_ty", "_tx").applyInPandas(work, f"{self.blocks}, _changed long")

    def _edges(self, ty: int, tx: int, own: tuple[int, int]) -> tuple[slice, slice]:
        """Of a tile with its border, what is in the grid."""
        h, out = self.halo, []
        for at, n, size in ((ty, own[0], self.size["lat"]), (tx, own[1], self.size["lon"])):
            low = at * self.tile
            out.append(slice(h - min(h, low), h + n + min(h, size - low - n)))
        return tuple(out)

    def _inside(self, wide: np.ndarray, ty: int, tx: int, own: tuple[int, int]) -> np.ndarray:
        return wide[self._edges(ty, tx, own)]

    def _core(self, after: np.ndarray, ty: int, tx: int, own: tuple[int, int]) -> np.ndarray:
        y, x = (self.halo - s.start for s in self._edges(ty, tx, own))
        return after[y : y + own[0], x : x + own[1]]

    def whole(self, tiles: DataFrame) -> DataFrame:
        """Slices of one tile, filled to the end at once."""

        def work(frames):
            for frame in frames:
                for v in self.names:
                    frame[v] = [fill(np.frombuffer(b).reshape(self._shape(0, 0)), self.kernel).tobytes() for b in frame[v]]
                yield frame

        return tiles.mapInPandas(work, self.blocks)

    def cells(self, tiles: DataFrame) -> DataFrame:
        def rows(frames):
            for frame in frames:
                for r in frame.to_dict("records"):
                    ty, tx = int(r["_ty"]), int(r["_tx"])
                    n = self._shape(ty, tx)
                    lat, lon = self.axes["lat"][ty * self.tile :][: n[0]], self.axes["lon"][tx * self.tile :][: n[1]]
                    yield pd.DataFrame({d: [r[d]] * (n[0] * n[1]) for d in self.rest} | {"lat": np.repeat(lat, n[1]), "lon": np.tile(lon, n[0])} | {v: np.frombuffer(r[v]) for v in self.names})

        fields = ", ".join([*self.slice, "lat double", "lon double", *(f"`{v}` double" for v in self.names)])
        df = tiles.select(*self.rest, "_ty", "_tx", *self.names).mapInPandas(rows, fields)
        value = lambda v: F.when(~F.isnan(v), F.col(v)).alias(v)
        return df.select(*self.rest, "lat", "lon", *(value(v) for v in self.names))


def _some_changed() -> Column:
    return F.col("_changed") > 0


@op(tags=("gapfilling",))
def gapfill(ds: Cube, kernel: Any = None, tile: int = TILE, steps: int = STEPS) -> Cube:
    """Fill the gaps of each variable's lat/lon slices, on the axes of the whole cube.

    A slice is cut into tiles. A round gives each tile the borders of its neighbours, as wide as the steps of a round reach, and
    runs these steps on it; rounds are stored and go on until none fills a cell, so the result is that of the stencil on the
    whole slice at once. Slices of one tile need no rounds.
    """
    ds.require("lat", "lon")
    ship(ds.df.sparkSession)
    k = np.array(kernel if kernel is not None else KERNEL, float)
    tiles = Tiles(ds, k, tile, steps)
    rest, names = tiles.rest, tiles.names
    if not min(tiles.size.values()):
        now = ds.df.select(*rest, *(F.col(d).cast("double").alias(d) for d in ("lat", "lon")), *(F.col(v).cast("double").alias(v) for v in names))
        return ds.on(now, names, (*rest, "lat", "lon"))
    now = tiles.cut(ds)
    if not tiles.many:
        return ds.on(tiles.cells(tiles.whole(now)), names, (*rest, "lat", "lon"))
    now, going = stored(now, "tiles"), True
    while going:
        now = stored(tiles.step(now), "tiles")
        going = not now.where(_some_changed()).isEmpty()
    return ds.on(tiles.cells(now), names, (*rest, "lat", "lon"))
