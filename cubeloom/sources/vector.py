"""Vector files: GeoJSON and KML, read feature by feature and written by partition, on any file system that Spark reaches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import COLUMN
from ..shipping import ship

#: Columns that readers of KML make up, with the value that says nothing.
KML_DEFAULTS = {"Name": None, "description": None, "timestamp": None, "begin": None, "end": None, "altitudeMode": None, "tessellate": -1, "extrude": 0, "visibility": -1, "drawOrder": None, "icon": None}
_RING = "LinearRing struct<coordinates:string>"
_POLYGON = f"struct<outerBoundaryIs:struct<{_RING}>,innerBoundaryIs:array<struct<{_RING}>>>".replace("LinearRing struct", "LinearRing:struct")
_KML = f"""name string, description string, ExtendedData struct<SchemaData:struct<SimpleData:array<struct<_VALUE:string,_name:string>>>,Data:array<struct<_name:string,value:string>>>,
Point struct<coordinates:string>, LineString struct<coordinates:string>, Polygon {_POLYGON},
MultiGeometry struct<Point:array<struct<coordinates:string>>,LineString:array<struct<coordinates:string>>,Polygon:array<{_POLYGON}>>"""


def _shape(kind: Column, parts: Column) -> Column:
    """A geometry of parts, each an array of points; of several parts, after how many points each but the last ends."""
    sizes = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.size(p))
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n))
    return F.struct(kind.alias("type"), F.flatten(parts).alias("coords"), F.when(F.size(parts) > 1, ends).alias("ends")).cast(COLUMN)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Properties and geometries of FeatureCollections; all kinds of points, lines and polygons, with their holes and parts."""
    raw = spark.read.option("multiLine", True).json(path)
    if "features" not in raw.columns:
        raise ValueError("not a FeatureCollection")
    feature = raw.schema["features"].dataType.elementType
    told = feature["properties"].dataType if "properties" in feature.names else None
    props = getattr(told, "names", [])  # a collection without any has no struct
    # coordinates are of another depth in each kind of geometry: they come as text
    fields = T.StructType([*([T.StructField("properties", told)] if props else []), T.StructField("geometry", T.StringType())])
    whole = T.StructType([T.StructField("features", T.ArrayType(fields))])
    each = spark.read.option("multiLine", True).schema(whole).json(path).select(F.explode("features").alias("f"))
    given, kind = F.get_json_object("f.geometry", "$.coordinates"), F.get_json_object("f.geometry", "$.type")
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    deep = lambda n: F.from_json(given, "array<" * n + "double" + ">" * n)
    line = lambda r: F.transform(r, pair)
    parts = (
        F.when(kind == "Point", F.array(F.array(pair(deep(1)))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(line(deep(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(deep(3), line))
        .when(kind == "MultiPolygon", F.flatten(F.transform(deep(4), lambda p: F.transform(p, line))))
    )
    return each.select(*(F.col(f"f.properties.`{p}`").alias(p) for p in props), F.when(parts.isNotNull(), _shape(kind, parts)).alias("geometry"))


def _parts(g: Any) -> list[list[tuple[float, float]]]:
    points, ends = [(p["x"], p["y"]) for p in g["coords"]], list(g["ends"] if g["ends"] is not None else [])
    return [points[a:b] for a, b in zip([0, *ends], [*ends, len(points)])]


def _turn(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def _inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = point
    return sum((a[1] > y) != (b[1] > y) and x < (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, [*ring[1:], ring[0]])) % 2 == 1


def polygons(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Rings as polygons: a ring whose first point is inside of an odd number of others is a hole of the smallest of these."""
    around = {i: [j for j, o in enumerate(rings) if j != i and abs(_turn(o)) > abs(_turn(r)) and _inside(r[0], o)] for i, r in enumerate(rings)}
    shells = {i: [r] for i, r in enumerate(rings) if len(around[i]) % 2 == 0}
    for i, r in enumerate(rings):
        if i not in shells:
            shells[min((j for j in around[i] if j in shells), key=lambda j: abs(_turn(rings[j])))].append(r)
    return list(shells.values())


def _geojson(g: Any) -> dict | None:
    if g is None or g["coords"] is None or not len(g["coords"]):
        return None
    kind, parts = g["type"], [[list(p) for p in r] for r in _parts(g)]
    if kind == "Point":
        return {"type": kind, "coordinates": parts[0][0]}
    if kind in ("LineString", "MultiPoint"):
        return {"type": kind, "coordinates": parts[0]}
    if kind == "MultiPolygon":
        return {"type": kind, "coordinates": [[[list(p) for p in r] for r in s] for s in polygons(_parts(g))]}
    return {"type": kind, "coordinates": parts}


def _written(df: DataFrame, path: str, head: str, feature: Any, between: str, foot: str, replace: bool) -> None:
    """A folder of text files, one for each partition with rows: head, a line for each feature, foot."""
    ship(df.sparkSession)

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for frame in frames:
            out = [] if begun or not len(frame) else [head]
            for row in frame.to_dict("records"):
                out.append((between if begun else "") + feature(row))
                begun = True
            yield pd.DataFrame({"value": out}, dtype=object)
        if begun:
            yield pd.DataFrame({"value": [foot]})

    rows = df.select(*(F.col(f"`{c}`") if t.startswith(("struct", "array")) or t in ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "string") else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes))
    rows = rows.select(*(F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) if c != "geometry" else F.col("geometry") for c in rows.columns))  # numbers, nulls and texts as JSON has them
    rows.mapInPandas(lines, "value string").write.mode("overwrite" if replace else "errorifexists").text(path)


def _properties(row: dict, names: list[str]) -> dict[str, Any]:
    return {n: json.loads(row[n]).get(n) for n in names}


def write_geojson(df: DataFrame, path: str, replace: bool = False) -> None:
    """A folder of FeatureCollections, one from each partition with rows."""
    names = [c for c in df.columns if c != "geometry"]

    def feature(row: dict) -> str:
        return json.dumps({"type": "Feature", "properties": _properties(row, names), "geometry": _geojson(row["geometry"])}, ensure_ascii=False)

    _written(df, path, '{"type": "FeatureCollection", "features": [', feature, ",", "]}", replace)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with their data, split by Spark's XML source. Texts that are numbers or True / False in all rows become such; columns that say nothing are left out."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", True).schema(_KML).load(path)
    pair = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    points = lambda c: F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), pair)
    rings = lambda p: F.concat(F.array(points(p["outerBoundaryIs"]["LinearRing"]["coordinates"])), F.transform(F.coalesce(p["innerBoundaryIs"], F.array()), lambda r: points(r["LinearRing"]["coordinates"])))
    many = F.col("MultiGeometry")
    of = lambda f, make: F.flatten(F.transform(F.filter(many[f], lambda v: v.isNotNull()), make))
    shape = (
        F.when(F.col("Point").isNotNull(), _shape(F.lit("Point"), F.array(points(F.col("Point.coordinates")))))
        .when(F.col("LineString").isNotNull(), _shape(F.lit("LineString"), F.array(points(F.col("LineString.coordinates")))))
        .when(F.col("Polygon").isNotNull(), _shape(F.lit("Polygon"), rings(F.col("Polygon"))))
        .when(many["Polygon"].isNotNull(), _shape(F.lit("MultiPolygon"), of("Polygon", rings)))
        .when(many["LineString"].isNotNull(), _shape(F.lit("MultiLineString"), F.transform(many["LineString"], lambda v: points(v["coordinates"]))))
        .when(many["Point"].isNotNull(), _shape(F.lit("MultiPoint"), F.array(of("Point", lambda v: points(v["coordinates"])))))
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    simple = F.transform(F.col("ExtendedData.SchemaData.SimpleData"), lambda d: F.struct(d["_name"].alias("key"), d["_VALUE"].alias("value")))
    data = F.transform(F.col("ExtendedData.Data"), lambda d: F.struct(d["_name"].alias("key"), d["value"].alias("value")))
    own = F.when(F.col("name").isNotNull(), F.array(F.struct(F.lit("Name").alias("key"), F.col("name").alias("value"))))
    said = raw.select(F.concat(F.coalesce(own, none), F.coalesce(simple, none), F.coalesce(data, none)).alias("said"), shape.alias("geometry"))
    # what the texts of each column are: a row for each name
    text = F.col("value")
    each = said.select(F.monotonically_increasing_id().alias("row"), F.posexplode("said").alias("at", "d")).select("row", "at", F.col("d.key").alias("key"), F.col("d.value").alias("value")).where("value IS NOT NULL")
    seen = each.groupBy("key").agg(
        F.min(F.struct("row", "at")).alias("first"), F.bool_and(text.isin("True", "False")).alias("flag"), F.bool_and(text.rlike(r"^\s*[-+]?\d+\s*$")).alias("whole"), F.bool_and(text.try_cast("double").isNotNull() & text.rlike(r"\d")).alias("number"), F.min("value").alias("low"), F.max("value").alias("high")
    ).orderBy("first").collect()

    def last(key: str) -> Column:
        own = F.filter("said", lambda d: (d["key"] == key) & d["value"].isNotNull())
        return F.try_element_at(F.transform(own, lambda d: d["value"]), F.lit(-1))

    columns = []
    for s in seen:
        if s["key"] in KML_DEFAULTS and s["low"] == s["high"] == str(KML_DEFAULTS[s["key"]]):
            continue
        value = last(s["key"])
        kind = "boolean" if s["flag"] else "long" if s["whole"] else "double" if s["number"] else None
        columns.append((F.trim(value).cast(kind) if kind else value).alias(s["key"]))
    return said.select(*columns, "geometry")


def write_kml(df: DataFrame, path: str, replace: bool = False) -> None:
    """A folder of documents, one from each partition with rows: placemarks with typed data, of all kinds of points, lines and polygons; those without geometry too."""
    names = [c for c in df.columns if c != "geometry"]
    types = {"bigint": "int", "int": "int", "double": "float", "float": "float"}
    kinds = dict(df.dtypes)
    fields = "".join(f'<SimpleField name="{escape(n)}" type="{types.get(kinds[n], "string")}"/>' for n in names)
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Schema id="data">{fields}</Schema>'

    def shape(g: Any) -> str:
        if g is None or g["coords"] is None or not len(g["coords"]):
            return ""
        told = lambda r: f"<coordinates>{' '.join(f'{x!r},{y!r}' for x, y in r)}</coordinates>"
        ring = lambda tag, r: f"<{tag}><LinearRing>{told(r)}</LinearRing></{tag}>"
        area = lambda s: f"<Polygon>{ring('outerBoundaryIs', s[0])}{''.join(ring('innerBoundaryIs', r) for r in s[1:])}</Polygon>"
        parts = [[(float(x), float(y)) for x, y in r] for r in _parts(g)]
        one = {"Point": lambda: f"<Point>{told(parts[0])}</Point>", "LineString": lambda: f"<LineString>{told(parts[0])}</LineString>", "Polygon": lambda: area(parts)}
        if g["type"] in one:
            return one[g["type"]]()
        inner = [f"<Point>{told([p])}</Point>" for p in parts[0]] if g["type"] == "MultiPoint" else [f"<LineString>{told(r)}</LineString>" for r in parts] if g["type"] == "MultiLineString" else [area(s) for s in polygons(parts)]
        return f"<MultiGeometry>{''.join(inner)}</MultiGeometry>"

    def feature(row: dict) -> str:
        data = "".join(f'<SimpleData name="{escape(n)}">{escape(str(v))}</SimpleData>' for n, v in _properties(row, names).items() if v is not None)
        return f'<Placemark><ExtendedData><SchemaData schemaUrl="#data">{data}</SchemaData></ExtendedData>{shape(row["geometry"])}</Placemark>'

    _written(df, path, head, feature, "", "</Document></kml>", replace)
