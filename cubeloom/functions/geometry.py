"""Plane geometry without a library: literals on the driver, tests of points as column expressions.

A geometry column is a struct (type, coords: array of (x, y), ends: array of int). coords are the points of all rings, lines
or parts one after the other; ends says after how many points each part but the last ends (null or empty: there is one).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
COLUMN = "struct<type:string,coords:array<struct<x:double,y:double>>,ends:array<int>>"
EARTH_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


@dataclass
class Geometry:
    """kind in upper case; parts: rings (the first of a polygon is its shell, given by `shells`), lines or points."""

    kind: str
    parts: list[Ring]
    shells: list[int] = field(default_factory=lambda: [0])

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(p for r in self.parts for p in r))
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def area(self) -> float:
        if "POLYGON" not in self.kind:
            return 0.0
        return sum((1 if i in self.shells else -1) * abs(ring_area(r)) for i, r in enumerate(self.parts))

    @property
    def is_box(self) -> bool:
        if self.kind != "POLYGON" or len(self.parts) != 1:
            return False
        x0, y0, x1, y1 = self.bounds
        return len(set(self.parts[0])) == 4 and set(self.parts[0]) == {(x0, y0), (x0, y1), (x1, y0), (x1, y1)}

    @property
    def wkt(self) -> str:
        n = lambda v: f"{v:.15g}"
        text = [", ".join(f"{n(x)} {n(y)}" for x, y in r) for r in self.parts]
        if self.kind == "POINT":
            return f"POINT ({text[0]})"
        if self.kind == "LINESTRING":
            return f"LINESTRING ({text[0]})"
        if self.kind == "POLYGON":
            return "POLYGON (" + ", ".join(f"({t})" for t in text) + ")"
        if self.kind == "MULTIPOLYGON":
            ends = [*self.shells[1:], len(text)]
            return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(f"({t})" for t in text[a:b]) + ")" for a, b in zip(self.shells, ends)) + ")"
        if self.kind == "MULTIPOINT":
            return f"MULTIPOINT ({', '.join(text)})"
        return f"{self.kind} (" + ", ".join(f"({t})" for t in text) + ")"

    @property
    def centroid(self) -> tuple[float, float]:
        if "POLYGON" in self.kind and self.area:
            total = x = y = 0.0
            for i, r in enumerate(self.parts):
                a, cx, cy = _moments(r)
                s = (1 if i in self.shells else -1) * abs(a)
                total, x, y = total + s, x + s * cx, y + s * cy
            return x / total, y / total
        points = [p for r in self.parts for p in r]
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


def ring_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def _moments(ring: Ring) -> tuple[float, float, float]:
    a = ring_area(ring)
    c = [(p[0] * q[1] - q[0] * p[1], p[0] + q[0], p[1] + q[1]) for p, q in zip(ring, [*ring[1:], ring[0]])]
    return a, sum(w * x for w, x, _ in c) / (6 * a), sum(w * y for w, _, y in c) / (6 * a)


def point(x: float, y: float) -> Geometry:
    return Geometry("POINT", [[(x, y)]])


def polygon(ring: Ring) -> Geometry:
    return Geometry("POLYGON", [ring if ring[0] == ring[-1] else [*ring, ring[0]]])


def box(x0: float, y0: float, x1: float, y1: float) -> Geometry:
    return polygon([(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)])


def parse_wkt(text: str) -> Geometry:
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\)|EMPTY)\s*", text, re.S)
    if not m or m.group(2) == "EMPTY":
        raise ValueError(f"not a geometry: {text!r}")
    kind, body = m.group(1).upper(), m.group(2)

    def ring(t: str) -> Ring:
        return [tuple(map(float, p.strip(" ()").split()[:2])) for p in t.split(",")]

    rings = re.findall(r"\(([^()]*)\)", body)
    if kind in ("POINT", "LINESTRING", "MULTIPOINT"):
        return Geometry(kind, [ring(body[1:-1])])
    if kind in ("POLYGON", "MULTILINESTRING"):
        return Geometry(kind, [ring(r) for r in rings], [0] if kind == "POLYGON" else list(range(len(rings))))
    if kind == "MULTIPOLYGON":
        shells, count, depth = [], 0, 0
        for c in body:
            depth += (c == "(") - (c == ")")
            if c == "(" and depth == 2:
                shells.append(count)
            if c == "(" and depth == 3:
                count += 1
        return Geometry(kind, [ring(r) for r in rings], shells)
    raise ValueError(f"unsupported kind of geometry: {kind}")


def parse_geometry(value: Any) -> Geometry:
    """From a Geometry, WKT, 'x,y', 'x1,y1,x2,y2', a GeoJSON dict, numbers, or coordinates."""
    if isinstance(value, Geometry):
        return value
    if isinstance(value, dict):
        kind, c = value["type"].upper(), value["coordinates"]
        pair = lambda p: (float(p[0]), float(p[1]))
        if kind == "POINT":
            return point(*pair(c))
        if kind in ("LINESTRING", "MULTIPOINT"):
            return Geometry(kind, [list(map(pair, c))])
        if kind in ("POLYGON", "MULTILINESTRING"):
            return Geometry(kind, [list(map(pair, r)) for r in c], [0] if kind == "POLYGON" else list(range(len(c))))
        shells, parts = [], []
        for p in c:
            shells.append(len(parts))
            parts += [list(map(pair, r)) for r in p]
        return Geometry(kind, parts, shells)
    if isinstance(value, str):
        if re.fullmatch(r"[-+\d.eE\s,]+", value):
            n = [float(x) for x in value.split(",")]
            if len(n) == 2:
                return point(*n)
            if len(n) == 4:
                return box(*n)
            raise ValueError(value)
        return parse_wkt(value)
    values = list(value)
    if all(isinstance(x, (int, float)) for x in values):
        return point(*map(float, values)) if len(values) == 2 else box(*map(float, values))
    if isinstance(values[0][0], (tuple, list)):
        return Geometry("POLYGON", [[(float(x), float(y)) for x, y in r] for r in values])
    return polygon([(float(x), float(y)) for x, y in values])


def point_column(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).alias("coords"), F.lit(None).alias("ends")).cast(COLUMN))


def x_of(geometry: Column) -> Column:
    return geometry["coords"][0]["x"]


def y_of(geometry: Column) -> Column:
    return geometry["coords"][0]["y"]


def _edges(g: Geometry) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for r in g.parts for a, b in zip(r, r[1:])]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def on_boundary(x: Column, y: Column, g: Geometry) -> Column:
    def one(x1: float, y1: float, x2: float, y2: float) -> Column:
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        return (F.abs(cross) <= 1e-12 * max(1.0, abs(x2 - x1), abs(y2 - y1))) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))

    return _any([one(*e) for e in _edges(g)])


def crossings_odd(x: Column, y: Column, g: Geometry) -> Column:
    """The even-odd rule over all rings."""
    hits = [F.when((F.lit(y1) > y) != (F.lit(y2) > y), F.when(x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1, 1).otherwise(0)).otherwise(0) for x1, y1, x2, y2 in _edges(g) if y1 != y2]
    return (reduce(lambda a, b: a + b, hits, F.lit(0)) % 2) == 1


def in_bounds(x: Column, y: Column, g: Geometry) -> Column:
    x0, y0, x1, y1 = g.bounds
    return x.between(x0, x1) & y.between(y0, y1)


def within(x: Column, y: Column, g: Geometry) -> Column:
    """Strictly inside."""
    x0, y0, x1, y1 = g.bounds
    if g.is_box:
        return (x > x0) & (x < x1) & (y > y0) & (y < y1)
    if "POLYGON" not in g.kind:
        return intersects(x, y, g)
    return in_bounds(x, y, g) & crossings_odd(x, y, g) & ~on_boundary(x, y, g)


def intersects(x: Column, y: Column, g: Geometry) -> Column:
    if g.is_box:
        return in_bounds(x, y, g)
    if g.kind in ("POINT", "MULTIPOINT"):
        return _any([(x == a) & (y == b) for a, b in g.parts[0]])
    if "POLYGON" not in g.kind:
        return in_bounds(x, y, g) & on_boundary(x, y, g)
    return in_bounds(x, y, g) & (on_boundary(x, y, g) | crossings_odd(x, y, g))


def touches(x: Column, y: Column, g: Geometry) -> Column:
    if "POLYGON" in g.kind:
        return in_bounds(x, y, g) & on_boundary(x, y, g)
    if g.kind == "LINESTRING":
        return _any([(x == a) & (y == b) for a, b in (g.parts[0][0], g.parts[0][-1])])
    return F.lit(False)


def contains(x: Column, y: Column, g: Geometry) -> Column:
    """A point contains a geometry only if that is the same point."""
    return intersects(x, y, g) if g.kind == "POINT" else F.lit(False)


def almost_equals(x: Column, y: Column, g: Geometry, tolerance: float = 1e-6) -> Column:
    if g.kind != "POINT":
        return F.lit(False)
    (a, b), = g.parts[0]
    return (F.abs(x - a) <= tolerance) & (F.abs(y - b) <= tolerance)


POINT_TESTS = {
    "intersects": intersects, "within": within, "touches": touches, "contains": contains, "almost_equals": almost_equals,
    "disjoint": lambda x, y, g: ~intersects(x, y, g), "crosses": lambda x, y, g: F.lit(False),
}


def great_circle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees between two points (longitude, latitude in degrees)."""
    a1, a2, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    c1, c2, s1, s2 = F.cos(a1), F.cos(a2), F.sin(a1), F.sin(a2)
    across, along = c2 * F.sin(d), c1 * s2 - s1 * c2 * F.cos(d)
    return F.degrees(F.atan2(F.sqrt(across * across + along * along), s1 * s2 + c1 * c2 * F.cos(d)))


def centroid_column(geometry: Column) -> Column:
    """struct(x, y): of a ring by its area, of points and lines the mean of their points."""
    c = geometry["coords"]
    n = F.size(c)
    index = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    pick = lambda i, f: c[i.cast("int")][f]
    cross = F.transform(index, lambda i: pick(i, "x") * F.coalesce(pick((i + 1) % n, "y"), F.lit(0.0)) - F.coalesce(pick((i + 1) % n, "x"), F.lit(0.0)) * pick(i, "y"))
    total = F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)
    moment = lambda f: F.aggregate(F.transform(index, lambda i: (pick(i, f) + pick((i + 1) % n, f)) * (pick(i, "x") * pick((i + 1) % n, "y") - pick((i + 1) % n, "x") * pick(i, "y"))), F.lit(0.0), lambda a, v: a + v) / (3 * total)
    mean = lambda f: F.aggregate(F.transform(c, lambda p: p[f]), F.lit(0.0), lambda a, v: a + v) / n
    ring = (geometry["type"] == "Polygon") & (F.abs(total) > 0)
    return F.struct(F.when(ring, moment("x")).otherwise(mean("x")).alias("x"), F.when(ring, moment("y")).otherwise(mean("y")).alias("y"))


#: Lambert's azimuthal equal-area systems by code: latitude and longitude of the centre, false easting and northing, axis, flattening.
AZIMUTHAL = {
    "3035": (52.0, 10.0, 4321000.0, 3210000.0, 6378137.0, 1 / 298.257222101),
    "6931": (90.0, 0.0, 0.0, 0.0, EARTH_AXIS, FLATTENING), "6932": (-90.0, 0.0, 0.0, 0.0, EARTH_AXIS, FLATTENING),
}


class _Azimuthal:
    """An equal-area system about a centre, on the sphere of the same area. m: the functions, of numbers (math) or columns (F)."""

    def __init__(self, code: str) -> None:
        lat, lon, self.east, self.north, axis, f = AZIMUTHAL[code]
        self.e2 = f * (2 - f)
        self.e = math.sqrt(self.e2)
        self.lat, self.lon = math.radians(lat), math.radians(lon)
        self.pole = self._q(1.0, math)
        self.radius = axis * math.sqrt(self.pole / 2)
        at = self._q(math.sin(self.lat), math) / self.pole
        self.sin, self.cos = at, math.sqrt(max(0.0, 1 - at * at))
        self.polar = abs(abs(lat) - 90) < 1e-9
        self.d = 1.0 if self.polar else axis * math.cos(self.lat) / math.sqrt(1 - self.e2 * math.sin(self.lat) ** 2) / (self.radius * self.cos)

    def _q(self, s: Any, m: Any) -> Any:
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - m.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def forward(self, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
        s = self._q(m.sin(m.radians(y)), m) / self.pole
        c, turn = m.sqrt(_clip(1 - s * s, m)), m.radians(x) - self.lon
        b = self.radius * m.sqrt(2 / (1 + self.sin * s + self.cos * c * m.cos(turn)))
        return b * self.d * c * m.sin(turn) + self.east, b / self.d * (self.cos * s - self.sin * c * m.cos(turn)) + self.north

    def back(self, x: Any, y: Any, m: Any) -> tuple[Any, Any]:
        a, b = (x - self.east) / self.d, (y - self.north) * self.d
        rho = m.sqrt(a * a + b * b)
        half = rho / (2 * self.radius)
        sine, cosine = 2 * half * m.sqrt(_clip(1 - half * half, m)), 1 - 2 * half * half  # of the angle from the centre
        of = sine / _positive(rho, m)
        s = cosine * self.sin + b * of * self.cos
        beta = m.asin(_between(s, m))
        lon = self.lon + m.atan2(a * sine, rho * self.cos * cosine - b * self.sin * sine)
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta) + 761 * e6 / 45360 * m.sin(6 * beta)
        return m.degrees(lon), m.degrees(lat)


def _clip(v: Any, m: Any) -> Any:
    return max(0.0, v) if m is math else F.greatest(v, F.lit(0.0))


def _between(v: Any, m: Any) -> Any:
    return min(1.0, max(-1.0, v)) if m is math else F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))


def _positive(v: Any, m: Any) -> Any:
    return (v or 1.0) if m is math else F.when(v > 0, v).otherwise(1.0)


def unproject(x: Column, y: Column, crs: str) -> tuple[Column, Column] | None:
    """Longitude and latitude of places in web Mercator or an azimuthal equal-area system; None for other systems."""
    code = crs.upper().removeprefix("EPSG:")
    if code in ("4326", "CRS84", "OGC:CRS84"):
        return x, y
    if code in ("3857", "900913"):
        return F.degrees(x / EARTH_AXIS), F.degrees(F.atan(F.exp(y / EARTH_AXIS))) * 2 - 90
    return _Azimuthal(code).back(x, y, F) if AZIMUTHAL.get(code) else None


def project(x: Column, y: Column, crs: str) -> tuple[Column, Column] | None:
    """From longitude and latitude to web Mercator, UTM or an azimuthal equal-area system, in closed form; None for other systems."""
    code = crs.upper().removeprefix("EPSG:")
    if code in AZIMUTHAL:
        return _Azimuthal(code).forward(x, y, F)
    if code in ("4326", "CRS84", "OGC:CRS84"):
        return x, y
    if code in ("3857", "900913"):
        return F.radians(x) * EARTH_AXIS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * EARTH_AXIS
    if re.fullmatch(r"32[67](0[1-9]|[1-5]\d|60)", code):
        zone, south = int(code[3:]), code[2] == "7"
        e2 = FLATTENING * (2 - FLATTENING)
        ep, k = e2 / (1 - e2), 0.9996
        f = F.radians(y)
        s, c, t = F.sin(f), F.cos(f), F.tan(f)
        v = EARTH_AXIS / F.sqrt(1 - e2 * s * s)
        a = F.radians(x - (zone * 6 - 183)) * c
        t2, c2 = t * t, ep * c * c
        m = EARTH_AXIS * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * f - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * f) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * f) - (35 * e2**3 / 3072) * F.sin(6 * f))
        east = k * v * (a + (1 - t2 + c2) * a**3 / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep) * a**5 / 120) + 500000
        north = k * (m + v * t * (a * a / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * a**4 / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep) * a**6 / 720)) + (10_000_000 if south else 0)
        return east, north
    return None


def project_point(x: float, y: float, crs: str) -> tuple[float, float] | None:
    """As project(), of one point on the driver."""
    code = crs.upper().removeprefix("EPSG:")
    if code in AZIMUTHAL:
        return _Azimuthal(code).forward(x, y, math)
    if code in ("4326", "CRS84", "OGC:CRS84"):
        return x, y
    if code in ("3857", "900913"):
        return math.radians(x) * EARTH_AXIS, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * EARTH_AXIS
    if re.fullmatch(r"32[67](0[1-9]|[1-5]\d|60)", code):
        zone, south = int(code[3:]), code[2] == "7"
        e2 = FLATTENING * (2 - FLATTENING)
        ep, f = e2 / (1 - e2), math.radians(y)
        s, c, t = math.sin(f), math.cos(f), math.tan(f)
        v, a, t2, c2 = EARTH_AXIS / math.sqrt(1 - e2 * s * s), math.radians(x - (zone * 6 - 183)) * c, t * t, ep * c * c
        m = EARTH_AXIS * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * f - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * f) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * f) - (35 * e2**3 / 3072) * math.sin(6 * f))
        east = 0.9996 * v * (a + (1 - t2 + c2) * a**3 / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep) * a**5 / 120) + 500000
        north = 0.9996 * (m + v * t * (a * a / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * a**4 / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep) * a**6 / 720)) + (10_000_000 if south else 0)
        return east, north
    return None
