"""How lines, polygons and points of a geometry column lie to a region: SQL expressions over arrays of segments.

The segments of each side are cut where those of the other meet them, and the middle of each piece is inside of the other
side, on its boundary, or outside of it. What these say of both sides decides every test. Polygons are read by the even-odd
rule over all their rings, so holes and several parts need nothing more; the boundary of lines are the points at which an
odd number of them end. Ends within 1e-9 of a segment lie on it. Only what a test asks for is put into its plan, and boxes
that do not meet are told apart first, of sides and of segments. A row's segments, box and pieces are worked out once for a
test, and no further piece is looked at when one has told. Expressions are put together as SQL text, which Catalyst reads at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Geometry

NEAR = 1e-9
#: Boxes further apart than this have no common point, by any rounding of what is near.
APART = 1e-6
SEGMENT = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
POINTS = "array<struct<x:double,y:double>>"
IN, ON, OUT = 1, 0, -1
_numbers = count()

Say = Callable[[str], str]


def _call(function: str, values: str, body: Say) -> str:
    v = f"v{next(_numbers)}"
    return f"{function}({values}, {v} -> {body(v)})"


def _each(values: str, body: Say) -> str:
    return _call("transform", values, body)


def _some(values: str, body: Say) -> str:
    return _call("exists", values, body)


def _those(values: str, body: Say) -> str:
    return _call("filter", values, body)


def _struct(**values: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _let(body: Say, **values: str) -> str:
    """What body makes of a struct of values, each of which is worked out once and stands in the plan once."""
    return _each(f"array({_struct(**values)})", body) + "[0]"


@dataclass
class Shape:
    """One side: its dimension (0 points, 1 lines, 2 polygons), its points (as given, or of lines where they end), its segments and its box."""

    dim: int
    points: str
    segments: str
    box: tuple[str, str, str, str]

    @cached_property
    def boundary(self) -> str:
        """Points at which an odd number of lines end."""
        return _those(self.points, lambda p: f"size({_those(self.points, lambda q: f'{q}.x = {p}.x AND {q}.y = {p}.y')}) % 2 = 1")


@dataclass
class Line(Shape):
    """A shape of lines whose boundary is worked out."""

    known: str = ""

    @property
    def boundary(self) -> str:
        return self.known


def of_column(name: str, dim: int) -> Shape:
    """The shape of a geometry column (type, coords, ends of its parts but the last), where it has this dimension."""
    g = "`" + name.replace("`", "``") + "`"
    c, ends = f"{g}.coords", f"coalesce({g}.ends, cast(array() AS array<int>))"
    at = lambda i: f"element_at({c}, {i})"
    inner = _those(f"if(size({c}) > 1, sequence(1, size({c}) - 1), cast(array() AS array<int>))", lambda i: f"NOT array_contains({ends}, {i})")
    lines = _each(inner, lambda i: _struct(x1=f"{at(i)}.x", y1=f"{at(i)}.y", x2=f"{at(f'{i} + 1')}.x", y2=f"{at(f'{i} + 1')}.y"))
    segments = _those(lines, lambda s: f"{s}.x1 <> {s}.x2 OR {s}.y1 <> {s}.y2")
    points = c
    if dim == 1:
        points = f"concat({_each(f'concat(array(0), {ends})', lambda e: at(f'{e} + 1'))}, {_each(f'concat({ends}, array(size({c})))', at)})"
    xs, ys = _each(c, lambda p: f"{p}.x"), _each(c, lambda p: f"{p}.y")
    return Shape(dim, points, segments, (f"array_min({xs})", f"array_min({ys})", f"array_max({xs})", f"array_max({ys})"))


def settled(shape: Shape, body: Callable[[Shape], str]) -> str:
    """What body makes of a shape whose points, segments and box are worked out once."""

    def ends(v: str) -> str:
        known = Shape(shape.dim, f"{v}.p", f"{v}.s", shape.box)
        if shape.dim != 1:
            return body(known)
        return _let(lambda w: body(Line(1, known.points, known.segments, shape.box, f"{w}.b")), b=known.boundary)

    return _let(ends, p=shape.points, s=shape.segments)


def boxed(shape: Shape, body: Callable[[Shape], str]) -> str:
    """What body makes of a shape whose box is worked out once."""
    names = ("x0", "y0", "x1", "y1")
    return _let(lambda v: body(Shape(shape.dim, shape.points, shape.segments, tuple(f"{v}.{n}" for n in names))), **dict(zip(names, shape.box)))


def of_literal(g: Geometry) -> Shape:
    dim = 0 if "POINT" in g.kind else 1 if "LINE" in g.kind else 2
    edges = [(*a, *b) for r in g.parts for a, b in zip(r, r[1:]) if a != b] if dim else []
    points = [p for r in g.parts for p in ((r[0], r[-1]) if dim == 1 else r)]
    number = lambda v: f"{float(v)!r}D"
    structs = lambda names, rows, kind: f"cast(array({', '.join(_struct(**{n: number(v) for n, v in zip(names, r)}) for r in rows)}) AS {kind})"
    return Shape(dim, structs(("x", "y"), points, POINTS), structs(("x1", "y1", "x2", "y2"), edges, SEGMENT), tuple(map(number, g.bounds)))


def side(p: str, shape: Shape) -> str:
    """Whether a point is inside, on the boundary or outside of a shape."""
    same = lambda q: f"abs({q}.x - {p}.x) <= {NEAR} AND abs({q}.y - {p}.y) <= {NEAR}"
    if shape.dim == 0:
        return f"if({_some(shape.points, same)}, {IN}, {OUT})"

    def on(s: str) -> str:
        told = lambda v: f"abs({v}.px * {v}.dy - {v}.py * {v}.dx) <= {v}.e AND {v}.px * {v}.dx + {v}.py * {v}.dy BETWEEN -{v}.e AND {v}.dx * {v}.dx + {v}.dy * {v}.dy + {v}.e"
        return _let(told, dx=f"{s}.x2 - {s}.x1", dy=f"{s}.y2 - {s}.y1", px=f"{p}.x - {s}.x1", py=f"{p}.y - {s}.y1", e=f"{NEAR} * (abs({s}.x2 - {s}.x1) + abs({s}.y2 - {s}.y1))")

    met = _some(shape.segments, on)
    if shape.dim == 1:
        return f"CASE WHEN NOT {met} THEN {OUT} WHEN {_some(shape.boundary, same)} THEN {ON} ELSE {IN} END"
    # of segments that are level nothing is divided
    crossed = lambda s: f"CASE WHEN ({s}.y1 > {p}.y) = ({s}.y2 > {p}.y) THEN false ELSE {p}.x < ({p}.y - {s}.y1) / ({s}.y2 - {s}.y1) * ({s}.x2 - {s}.x1) + {s}.x1 END"
    return f"CASE WHEN {met} THEN {ON} WHEN size({_those(shape.segments, crossed)}) % 2 = 1 THEN {IN} ELSE {OUT} END"


def _meetings(a: str, b: str) -> str:
    """Where along the segment a (0 to 1) a segment b meets it: one place, or the ends of b on a line with a."""
    near = lambda t, e: f"{t} BETWEEN -{e} AND 1 + {e}"

    def measured(v: str) -> str:
        return _let(
            placed, cross=f"{v}.rx * {v}.sy - {v}.ry * {v}.sx", t=f"{v}.qx * {v}.sy - {v}.qy * {v}.sx", u=f"{v}.qx * {v}.ry - {v}.qy * {v}.rx", along=f"{v}.qx * {v}.rx + {v}.qy * {v}.ry",
            further=f"{v}.sx * {v}.rx + {v}.sy * {v}.ry", rr=f"{v}.rx * {v}.rx + {v}.ry * {v}.ry", r=f"abs({v}.rx) + abs({v}.ry)", s=f"abs({v}.sx) + abs({v}.sy)",
        )

    def placed(v: str) -> str:
        e, f = f"({NEAR} / sqrt({v}.rr))", f"({NEAR} / {v}.s)"
        one = _those(f"array({v}.t / {v}.cross)", lambda t: f"{near(t, e)} AND {near(f'{v}.u / {v}.cross', f)}")
        ends = _those(f"array({v}.along / {v}.rr, ({v}.along + {v}.further) / {v}.rr)", lambda t: near(t, e))
        return f"CASE WHEN abs({v}.cross) > 1e-14 * {v}.r * {v}.s THEN {one} WHEN abs({v}.u) <= {NEAR} * {v}.r THEN {ends} ELSE cast(array() AS array<double>) END"

    least, most = (lambda s, c: f"least({s}.{c}1, {s}.{c}2)"), (lambda s, c: f"greatest({s}.{c}1, {s}.{c}2)")
    apart = " OR ".join(f"{least(p, c)} > {most(q, c)} + {APART}D" for c in "xy" for p, q in ((a, b), (b, a)))
    met = _let(measured, rx=f"{a}.x2 - {a}.x1", ry=f"{a}.y2 - {a}.y1", sx=f"{b}.x2 - {b}.x1", sy=f"{b}.y2 - {b}.y1", qx=f"{b}.x1 - {a}.x1", qy=f"{b}.y1 - {a}.y1")
    return f"if({apart}, cast(array() AS array<double>), {met})"


def _pieces(a: Shape, b: Shape) -> str:
    """The pieces of a's segments between the places where b meets them: structs of the middle and the direction."""

    def cut(s: str) -> str:
        met = _each(f"flatten({_each(b.segments, lambda o: _meetings(s, o))})", lambda t: f"least(greatest({t}, 0D), 1D)")
        return _let(lambda v: between(s, v), ends=f"array_sort(concat(array(0D, 1D), {met}))", dx=f"{s}.x2 - {s}.x1", dy=f"{s}.y2 - {s}.y1")

    def between(s: str, v: str) -> str:
        spans = f"zip_with(slice({v}.ends, 1, size({v}.ends) - 1), slice({v}.ends, 2, size({v}.ends) - 1), (p, q) -> {_struct(m='(p + q) / 2', w='q - p')})"
        long = _those(spans, lambda w: f"{w}.w * sqrt({v}.dx * {v}.dx + {v}.dy * {v}.dy) > {4 * NEAR}")
        return _each(long, lambda w: _struct(x=f"{s}.x1 + {w}.m * {v}.dx", y=f"{s}.y1 + {w}.m * {v}.dy", dx=f"{w}.w * {v}.dx", dy=f"{w}.w * {v}.dy"))

    return f"flatten({_each(a.segments, cut)})"


class Pair:
    """What is to be known of two shapes; nothing is put together before it is asked for."""

    def __init__(self, a: Shape, b: Shape, parts_a: str | None = None) -> None:
        self.a, self.b, self._parts_a = a, b, parts_a

    @cached_property
    def parts_a(self) -> str:
        return self._parts_a or self._parts(self.a, self.b)

    def _parts(self, a: Shape, b: Shape) -> str:
        return a.points if a.dim == 0 else _pieces(a, b)

    def cut(self, body: Callable[[Pair], str]) -> str:
        """What body makes of the pair with the parts of a worked out once."""
        return body(self) if self._parts_a or self.a.dim == 0 else _let(lambda v: body(Pair(self.a, self.b, f"{v}.p")), p=self.parts_a)

    def some_a(self, told: str) -> str:
        """Whether the side of b on which some part of a lies is told so."""
        return _some(self.parts_a, lambda p: f"{side(p, self.b)} {told}")

    def some_b(self, told: str) -> str:
        return _some(self._parts(self.b, self.a), lambda p: f"{side(p, self.a)} {told}")

    @property
    def box_inside(self) -> str:
        (x0, y0, x1, y1), (u0, v0, u1, v1) = self.a.box, self.b.box
        return f"({x0} >= {u0} - {APART}D AND {y0} >= {v0} - {APART}D AND {x1} <= {u1} + {APART}D AND {y1} <= {v1} + {APART}D)"

    @property
    def boxes_meet(self) -> str:
        (x0, y0, x1, y1), (u0, v0, u1, v1) = self.a.box, self.b.box
        return f"({x0} <= {u1} + {NEAR} AND {u0} <= {x1} + {NEAR} AND {y0} <= {v1} + {NEAR} AND {v0} <= {y1} + {NEAR})"

    @property
    def meet(self) -> str:
        a, b = self.a, self.b
        if a.dim == 0 or b.dim == 0:
            return self.some_a(f">= {ON}") if a.dim == 0 else self.some_b(f">= {ON}")
        # without a common point of segments, or where one covers another, one side has a point of the other
        starts = lambda one, other: _some(_each(one.segments, lambda s: _struct(x=f"{s}.x1", y=f"{s}.y1")), lambda p: f"{side(p, other)} >= {ON}")
        touching = _some(a.segments, lambda s: _some(b.segments, lambda o: f"size({_meetings(s, o)}) > 0"))
        return f"({starts(a, b)} OR {starts(b, a) if a.dim == 2 else 'false'} OR {touching})"

    @property
    def crossing(self) -> str:
        """Whether two lines have a point that is an inner one of both."""
        a, b = self.a, self.b
        both = lambda p: f"{side(p, a)} = {IN} AND {side(p, b)} = {IN}"
        at = lambda s, t: _let(both, x=f"{s}.x1 + {t} * ({s}.x2 - {s}.x1)", y=f"{s}.y1 + {t} * ({s}.y2 - {s}.y1)")
        return _some(a.segments, lambda s: _some(b.segments, lambda o: _some(_meetings(s, o), lambda t: at(s, t))))

    @property
    def shared_inside(self) -> str:
        """Whether insides meet along a boundary that both have: a little beside it, one is in both."""
        a, b = self.a, self.b
        both = lambda p: f"{side(p, a)} = {IN} AND {side(p, b)} = {IN}"
        beside = lambda m: _some("array(1e-5D, -1e-5D)", lambda k: _let(both, x=f"{m}.x - {k} * {m}.dy", y=f"{m}.y + {k} * {m}.dx"))
        return _some(self.parts_a, lambda m: f"{side(m, b)} = {ON} AND {beside(m)}")

    @property
    def inside_meet(self) -> str:
        """Whether the insides have a point in common."""
        a, b = self.a.dim, self.b.dim
        told = f"= {IN}"
        if a == b == 1:
            return f"({self.some_a(told)} OR {self.crossing})"
        if a == b == 2:
            return self.cut(lambda p: f"({p.some_a(told)} OR {p.some_b(told)} OR {p.shared_inside})")
        return self.some_a(told) if a <= b else self.some_b(told)


def within(p: Pair) -> str:
    if p.a.dim > p.b.dim:
        return "false"
    further = f" AND NOT {p.some_b(f'= {IN}')}" if p.a.dim == 2 else ""
    return f"({p.box_inside} AND {p.cut(lambda q: f'NOT {q.some_a(f"= {OUT}")}{further} AND {q.inside_meet}')})"


def crosses(p: Pair) -> str:
    a, b = p.a.dim, p.b.dim
    if a == b == 1:
        return f"(NOT {p.some_a(f'>= {ON}')} AND {p.crossing})"
    return "false" if a == b else f"({p.inside_meet} AND {p.some_a(f'= {OUT}') if a < b else p.some_b(f'= {OUT}')})"


TESTS: dict[str, Callable[[Pair], str]] = {
    "intersects": lambda p: p.meet,
    "disjoint": lambda p: f"NOT {p.meet}",
    "within": within,
    "contains": lambda p: within(Pair(p.b, p.a)),
    "touches": lambda p: "false" if p.a.dim == p.b.dim == 0 else f"({p.meet} AND NOT {p.inside_meet})",
    "crosses": crosses,
}


def almost_equals(name: str, region: Geometry, tolerance: float = 1e-6) -> Column:
    """The same kind with the same points in the same order."""
    points, g = [p for r in region.parts for p in r], F.col("`" + name.replace("`", "``") + "`")
    flat = F.expr(of_literal(Geometry("POLYGON", [points])).points)
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    return (F.upper(g["type"]) == region.kind) & (F.size(g["coords"]) == len(points)) & F.forall(F.zip_with(g["coords"], flat, near), lambda v: F.coalesce(v, F.lit(False)))


def test(name: str, column: str, region: Geometry) -> Column:
    """A test of a geometry column with lines, polygons or several points against a region; a shape without points is disjoint and nothing else."""
    if name == "almost_equals":
        return F.coalesce(almost_equals(column, region), F.lit(False))
    other = of_literal(region)

    def one(dim: int) -> Column:
        told = lambda shape: settled(shape, lambda s: TESTS[name](Pair(s, other)))
        found = boxed(of_column(column, dim), lambda s: f"CASE WHEN {Pair(s, other).boxes_meet} THEN coalesce({told(s)}, false) ELSE {'true' if name == 'disjoint' else 'false'} END")
        return F.expr(found)

    g = F.col("`" + column.replace("`", "``") + "`")
    none = F.size(F.coalesce(g["coords"], F.array().cast(POINTS))) == 0
    return F.when(none, name == "disjoint").when(g["type"].isin("Point", "MultiPoint"), one(0)).when(g["type"].isin("LineString", "MultiLineString"), one(1)).otherwise(one(2))
