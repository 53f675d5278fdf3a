"""The query language of tables as columns: Python comparisons, arithmetic, and / or / not, in, and geometry tests."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import ValidationError
from . import shapes
from .geometry import POINT_TESTS, Geometry, parse_geometry, project_point, x_of, y_of

_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil}


def region_in(geometry: Geometry, crs: str | None) -> Geometry | None:
    """A region given in longitude and latitude in the system of a table, or None where that is unknown."""
    if not crs:
        return geometry
    parts = [[project_point(x, y, crs) for x, y in r] for r in geometry.parts]
    return None if any(p is None for r in parts for p in r) else Geometry(geometry.kind, parts, geometry.shells)


def geometry_test(name: str, region: Geometry, column: str = "geometry", crs: str | None = None) -> Column:
    shape = region_in(region, crs)
    if shape is None:
        return F.lit(False)
    g = F.col(column)
    other = shapes.test(name, column, shape)
    return F.when(g.isNull() | g["type"].isNull(), False).when(g["type"] == "Point", F.coalesce(POINT_TESTS[name](x_of(g), y_of(g), shape), F.lit(False))).otherwise(other)


def parse_query(expression: str, df: DataFrame, names: dict | None = None, crs: str | None = None) -> Column:
    """A boolean column. @name refers to names; @intersects('wkt') and the like test the geometry column."""
    names = names or {}
    text = re.sub(r"@(\w+)", r"__at_\1", expression)
    text = re.sub(r"(?<![&])&(?![&])", " and ", re.sub(r"(?<![|])\|(?![|])", " or ", text)) if "'" not in text and '"' not in text else text
    text = re.sub(r"`([^`]+)`", lambda m: f"__quoted_{m.group(1).encode().hex()}", text)
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        raise ValidationError(f"not a query: {expression!r}") from None

    def name(n: str) -> Column | object:
        if n.startswith("__at_"):
            if n[5:] not in names:
                raise ValidationError(f"@{n[5:]} is not known")
            return names[n[5:]]
        if n.startswith("__quoted_"):
            n = bytes.fromhex(n[9:]).decode()
        if n not in df.columns:
            raise ValidationError(f"name {n!r} is not defined")
        return F.col(f"`{n}`")

    def column(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    def walk(e: ast.expr) -> object:
        if isinstance(e, ast.BoolOp):
            out = column(walk(e.values[0]))
            for v in e.values[1:]:
                out = (out & column(walk(v))) if isinstance(e.op, ast.And) else (out | column(walk(v)))
            return out
        if isinstance(e, ast.UnaryOp):
            v = walk(e.operand)
            return ~column(v) if isinstance(e.op, (ast.Not, ast.Invert)) else -v
        if isinstance(e, ast.BinOp):
            a, b = walk(e.left), walk(e.right)
            if isinstance(e.op, (ast.BitAnd, ast.BitOr)):
                return (column(a) & column(b)) if isinstance(e.op, ast.BitAnd) else (column(a) | column(b))
            a = column(a)
            if isinstance(e.op, ast.Div):
                return a / F.nullif(column(b).cast("double"), F.lit(0.0))
            if isinstance(e.op, ast.Mod):
                return F.try_mod(a, column(b))
            if isinstance(e.op, ast.Pow):
                return F.pow(a, column(b))
            return {ast.Add: a.__add__, ast.Sub: a.__sub__, ast.Mult: a.__mul__}[type(e.op)](b)
        if isinstance(e, ast.Compare):
            left, out = walk(e.left), None
            for o, r in zip(e.ops, e.comparators):
                right = walk(r)
                if isinstance(o, (ast.In, ast.NotIn)):
                    test = column(left).isin(list(right))
                    test = ~test if isinstance(o, ast.NotIn) else test
                else:
                    test = getattr(column(left), _COMPARE[type(o)])(right)
                out, left = test if out is None else out & test, right
            return out
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name):
            f = e.func.id.removeprefix("__at_")
            args = [walk(a) for a in e.args]
            if f == "from_wkt":
                return parse_geometry(args[0])
            if f in POINT_TESTS:
                return geometry_test(f, parse_geometry(args[-1]), crs=crs)
            if f in _FUNCTIONS:
                return _FUNCTIONS[f](column(args[0]))
            raise ValidationError(f"function {f!r} is not known")
        if isinstance(e, ast.Name):
            return name(e.id)
        if isinstance(e, ast.Constant):
            return e.value
        if isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            return [walk(x) for x in e.elts]
        raise ValidationError(f"not part of the query language: {ast.dump(e)}")

    try:
        return column(walk(tree))
    except KeyError as err:
        raise ValidationError(f"not part of the query language: {err}") from None
