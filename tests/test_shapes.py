"""Tests of lines, polygons, holes and parts against regions: cases with known answers, and rectilinear shapes against their cells."""

import random

import pytest
from pyspark.sql import functions as F

from cubeloom.functions import geometry as g
from cubeloom.functions import shapes
from cubeloom.operators import data_frame

NAMES = ("intersects", "disjoint", "within", "contains", "touches", "crosses")
BOX = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
RING = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))"
# column, region, the tests that hold
CASES = [
    ("LINESTRING (-5 5, 5 5)", BOX, "intersects crosses"),
    ("LINESTRING (-5 5, 15 5)", BOX, "intersects crosses"),
    ("LINESTRING (2 2, 5 8, 9 1)", BOX, "intersects within"),
    ("LINESTRING (0 0, 10 0)", BOX, "intersects touches"),
    ("LINESTRING (-5 0, 0 0)", BOX, "intersects touches"),
    ("LINESTRING (0 5, 5 5)", BOX, "intersects within"),
    ("LINESTRING (20 20, 30 30)", BOX, "disjoint"),
    ("LINESTRING (-1 5, -1 20, 20 20)", BOX, "disjoint"),
    ("LINESTRING (-1 5, 5 11)", BOX, "intersects crosses"),
    ("LINESTRING (-2 8, 2 12)", BOX, "intersects touches"),
    ("LINESTRING (4 4, 6 6)", RING, "disjoint"),
    ("LINESTRING (1 1, 9 9)", RING, "intersects crosses"),
    ("LINESTRING (3 3, 7 7)", RING, "intersects touches"),
    ("LINESTRING (1 1, 1 9)", RING, "intersects within"),
    ("MULTILINESTRING ((1 1, 2 2), (20 20, 21 21))", BOX, "intersects crosses"),
    ("MULTILINESTRING ((1 1, 2 2), (3 3, 4 4))", BOX, "intersects within"),
    ("LINESTRING (0 0, 10 10)", "LINESTRING (0 10, 10 0)", "intersects crosses"),
    ("LINESTRING (0 0, 5 5)", "LINESTRING (5 5, 9 0)", "intersects touches"),
    ("LINESTRING (0 0, 5 5)", "LINESTRING (0 10, 5 5, 10 10)", "intersects touches"),
    ("LINESTRING (1 1, 2 2)", "LINESTRING (0 0, 5 5)", "intersects within"),
    ("LINESTRING (0 0, 2 2, 5 5)", "LINESTRING (5 5, 0 0)", "intersects within contains"),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (2 2, 6 6)", "intersects"),
    ("LINESTRING (0 0, 4 4)", "POINT (2 2)", "intersects contains"),
    ("LINESTRING (0 0, 4 4)", "POINT (4 4)", "intersects touches"),
    ("LINESTRING (0 0, 4 4)", "MULTIPOINT (2 2, 9 9)", "intersects crosses"),
    ("LINESTRING (0 0, 4 4)", BOX, "intersects within"),
    ("POLYGON ((1 1, 4 1, 4 4, 1 1))", BOX, "intersects within"),
    (BOX, "POLYGON ((1 1, 4 1, 4 4, 1 1))", "intersects contains"),
    (BOX, "POLYGON ((10 0, 10 10, 0 10, 0 0, 10 0))", "intersects within contains"),
    (BOX, "POLYGON ((10 2, 20 2, 20 8, 10 8, 10 2))", "intersects touches"),
    (BOX, "POLYGON ((10 10, 20 10, 20 20, 10 10))", "intersects touches"),
    (BOX, "POLYGON ((5 5, 20 5, 20 8, 5 8, 5 5))", "intersects"),
    (BOX, "POLYGON ((11 0, 20 0, 20 9, 11 0))", "disjoint"),
    (RING, "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))", "disjoint"),
    (RING, "POLYGON ((3 3, 7 3, 7 7, 3 7, 3 3))", "intersects touches"),
    (RING, BOX, "intersects within"),
    (BOX, RING, "intersects contains"),
    (RING, "POLYGON ((2 2, 8 2, 8 8, 2 8, 2 2))", "intersects"),
    (RING, "POINT (5 5)", "disjoint"),
    (RING, "POINT (1 5)", "intersects contains"),
    (RING, "POINT (3 5)", "intersects touches"),
    (RING, "LINESTRING (1 1, 1 9)", "intersects contains"),
    (RING, "LINESTRING (1 1, 9 9)", "intersects crosses"),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((8 8, 9 8, 9 9, 8 8)))", "intersects"),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", BOX, "intersects within"),
    ("MULTIPOINT (1 1, 5 5)", BOX, "intersects within"),
    ("MULTIPOINT (1 1, 15 5)", BOX, "intersects crosses"),
    ("MULTIPOINT (0 0, 15 5)", BOX, "intersects touches"),
    ("MULTIPOINT (1 1, 2 2)", "MULTIPOINT (1 1, 3 3)", "intersects"),
    ("MULTIPOINT (1 1, 2 2)", "POINT (2 2)", "intersects contains"),
    ("MULTIPOINT (20 1, 20 2)", BOX, "disjoint"),
]
KINDS = {"LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon", "POINT": "Point"}


def cell(wkt):
    """A value of a geometry column."""
    s = g.parse_wkt(wkt)
    ends, total = [], 0
    for r in s.parts[:-1]:
        total += len(r)
        ends.append(total)
    return (KINDS[s.kind], [p for r in s.parts for p in r], ends or None)


def told(spark, pairs, names=NAMES):
    """For each (column, region), the tests that hold."""
    out = [None] * len(pairs)
    for region in dict.fromkeys(r for _, r in pairs):
        rows = [(i, cell(c)) for i, (c, r) in enumerate(pairs) if r == region]
        df = spark.createDataFrame(rows, f"i int, geometry {g.COLUMN}")
        for r in df.select("i", *(shapes.test(n, "geometry", g.parse_geometry(region)).alias(n) for n in names)).collect():
            out[r["i"]] = {n for n in names if r[n]}
    return out


def test_known_cases(spark):
    got = told(spark, [(c, r) for c, r, _ in CASES])
    assert {(c, r): " ".join(n for n in NAMES if n in s) for (c, r, _), s in zip(CASES, got)} == {(c, r): " ".join(n for n in NAMES if n in want.split()) for c, r, want in CASES}


def boxed(cells):
    """A rectilinear shape's cells as rings under the even-odd rule: one square for each cell, whose common sides are drawn twice; merged into rows."""
    rings = []
    for y in sorted({y for _, y in cells}):
        xs = sorted(x for x, v in cells if v == y)
        while xs:
            end = next(i for i in range(1, len(xs) + 1) if i == len(xs) or xs[i] != xs[i - 1] + 1)
            a, b = xs[0], xs[end - 1] + 1
            rings.append(f"(({a} {y}, {b} {y}, {b} {y + 1}, {a} {y + 1}, {a} {y}))")
            xs = xs[end:]
    return rings


def test_rectangles_with_holes_against_their_cells(spark):
    rng = random.Random(3)

    def some():
        a, b = sorted(rng.sample(range(8), 2))
        c, d = sorted(rng.sample(range(8), 2))
        wkt, cells = f"(({a} {c}, {b} {c}, {b} {d}, {a} {d}, {a} {c})", {(x, y) for x in range(a, b) for y in range(c, d)}
        if b - a > 2 and d - c > 2:
            wkt += f", ({a + 1} {c + 1}, {b - 1} {c + 1}, {b - 1} {d - 1}, {a + 1} {d - 1}, {a + 1} {c + 1})"
            cells -= {(x, y) for x in range(a + 1, b - 1) for y in range(c + 1, d - 1)}
        return f"POLYGON {wkt})", cells

    corners = lambda cells: {(x + i, y + j) for x, y in cells for i in (0, 1) for j in (0, 1)}
    regions, columns = [some() for _ in range(6)], [some() for _ in range(60)]
    pairs = [(c, r) for r in regions for c in columns]
    got = told(spark, [(c[0], r[0]) for c, r in pairs])
    for (c, r), have in zip(pairs, got):
        both, meet = c[1] & r[1], bool(corners(c[1]) & corners(r[1]))
        want = {n for n, holds in (("intersects", meet), ("disjoint", not meet), ("within", c[1] <= r[1]), ("contains", r[1] <= c[1]), ("touches", meet and not both)) if holds}
        assert have == want, (c[0], r[0])


def test_in_tables(spark):
    rows = [(1, cell("LINESTRING (-5 5, 5 5)")), (2, cell("POINT (5 5)")), (3, cell(RING)), (4, None), (5, ("Polygon", [], None)), (6, cell("LINESTRING (4 4, 6 6)"))]
    df = spark.createDataFrame(rows, f"k int, geometry {g.COLUMN}")
    of = lambda d: sorted(r["k"] for r in d.select("k").collect())
    assert of(data_frame.query(df, f"@intersects('{BOX}')")) == [1, 2, 3, 6]
    assert of(data_frame.query(df, f"@within('{BOX}') and k > 2")) == [3, 6]
    assert of(data_frame.query(df, f"@crosses('{BOX}')")) == [1]
    assert of(data_frame.data_frame_subset(df, "disjoint", RING)) == [2, 5, 6]
    assert of(data_frame.query(df, "@almost_equals('LINESTRING (-5 5, 5.0000001 5)')")) == [1]
    assert of(data_frame.query(df.limit(0), f"@crosses('{BOX}')")) == []
    with pytest.raises(ValueError):
        data_frame.query(df, "@crosses('POLYGON')")


@pytest.mark.parametrize("name", sorted(shapes.TESTS))
def test_segments_are_worked_out_once(spark, monkeypatch, name):
    """The points of a row's segments are picked once for a test, not for each point or segment that they are held against."""
    texts, expr = [], F.expr
    monkeypatch.setattr(shapes.F, "expr", lambda text: texts.append(text) or expr(text))
    shapes.test(name, "geometry", g.Geometry("POLYGON", [[(0, 0), (4, 0), (4, 4), (0, 0)]]))
    assert texts and all(t.count("sequence(") <= 1 for t in texts)
