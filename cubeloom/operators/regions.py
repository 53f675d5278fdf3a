"""Masks by regions: tables of polygons with a name and a continent."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, small
from ..functions import geometry as g
from ..likes import VarNamesLike
from ..op import op

#: Degrees of latitude of a band of edges.
BAND = 1.0


class Regions:
    """Polygons by name: (name, continent, geometry), from a list or a GeoJSON file."""

    def __init__(self, rows: list[tuple[str, str, Any]]) -> None:
        self.rows = [(n, c, g.parse_geometry(s)) for n, c, s in rows]

    @classmethod
    def read(cls, path: str) -> Regions:
        import json

        with open(path) as f:
            features = json.load(f)["features"]
        return cls([(x["properties"].get("name", ""), x["properties"].get("continent", ""), x["geometry"]) for x in features])

    def chosen(self, regions: Any) -> list[tuple[int, str, str, g.Geometry]]:
        """Numbered from one; all, or those whose name or continent is named."""
        names = VarNamesLike.convert(regions)
        rows = [(i + 1, *r) for i, r in enumerate(self.rows) if not names or r[0] in names or r[1] in names]
        if not rows:
            raise ValidationError(f"no region matches {regions!r}")
        return rows


def scan_lines(lats: DataFrame, rows: list) -> DataFrame:
    """lat, code, low, high: the pieces of each latitude inside of each region, from low on and up to, not with, high.

    Edges are cut into bands of latitude and meet the latitudes of their band; where a latitude crosses a region's edges,
    from the east the first crossing and the second bound a piece, the third and the fourth, and so on.
    """
    edges = [(i, *map(float, e)) for i, _, _, s in rows for e in g._edges(s) if e[1] != e[3]]
    spark = lats.sparkSession
    df = spark.createDataFrame(edges, "code int, x1 double, y1 double, x2 double, y2 double")
    band = lambda y: F.floor(y / BAND).cast("int")
    cut = df.select("*", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("band"))
    y = F.col("lat")
    crosses = (F.col("y1") > y) != (F.col("y2") > y)
    at = (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    met = lats.withColumn("band", band(y)).join(small(cut), "band").where(crosses).select("lat", "code", at.alias("x"))
    line = Window.partitionBy("lat", "code").orderBy(F.desc("x"))
    return met.select("lat", "code", F.col("x").alias("high"), F.lead("x").over(line).alias("low"), F.row_number().over(line).alias("k")).where("k % 2 = 1 AND low < high").select("lat", "code", "low", "high")


def region_codes(ds: Cube, regions: Regions, names: Any = None) -> DataFrame:
    """lat, lon, code of the first region that holds each pixel's centre: it stands in a piece of its latitude inside of the region."""
    rows = regions.chosen(names)
    cells = ds.df.select("lat", "lon").distinct()
    pieces = scan_lines(ds.df.select("lat").distinct(), rows)
    met = cells.join(small(pieces), "lat").where((F.col("lon") >= F.col("low")) & (F.col("lon") < F.col("high")))
    return met.groupBy("lat", "lon").agg(F.min("code").alias("code"))


@op(tags=("regions",))
def make_regions_dataset(ds: Cube, regions: Regions, names: Any = None) -> Cube:
    """country_code (from one, in order) and continent_code (continents in order of their names) of each pixel, else -1."""
    rows = regions.chosen(names)
    continents = {c: k + 1 for k, c in enumerate(sorted({c for _, _, c, _ in rows}))}
    of = F.create_map(*(x for i, _, c, _ in rows for x in (F.lit(i), F.lit(continents[c]))))
    cells = ds.df.select("lat", "lon").distinct().join(region_codes(ds, regions, names), ["lat", "lon"], "left")
    df = cells.select("lat", "lon", F.coalesce("code", F.lit(-1)).alias("country_code"), F.coalesce(F.element_at(of, F.col("code")), F.lit(-1)).alias("continent_code"))
    return Cube(df, ("lat", "lon"), {"country_code": {"flag_meanings": [n for _, n, _, _ in rows]}, "continent_code": {"flag_meanings": sorted(continents)}})


@op(tags=("regions",))
def get_regions_mask(ds: Cube, regions: Regions, names: Any = None) -> Cube:
    """mask: whether a pixel's centre is in one of the regions."""
    cells = ds.df.select("lat", "lon").distinct().join(region_codes(ds, regions, names), ["lat", "lon"], "left")
    return Cube(cells.select("lat", "lon", F.col("code").isNotNull().alias("mask")), ("lat", "lon"), {"mask": {}})


@op(tags=("regions",))
def get_land_mask(ds: Cube, regions: Regions) -> Cube:
    """mask: whether a pixel's centre is in any region."""
    return get_regions_mask(ds, regions)


@op(tags=("regions",))
def mask_dataset_by_regions(ds: Cube, regions: Regions, names: Any = None) -> Cube:
    """Variables are missing outside of the regions."""
    mask = get_regions_mask(ds, regions, names).df
    met = ds.df.join(mask, ["lat", "lon"], "left")
    return ds.on(met.select(*ds.dims, *(F.when(F.col("mask"), F.col(v)).alias(v) for v in ds.vars)))


@op(tags=("regions",))
def mask_dataset_by_land(ds: Cube, regions: Regions) -> Cube:
    """Variables are missing outside of all regions."""
    return mask_dataset_by_regions(ds, regions)
