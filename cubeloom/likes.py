"""Coercion of arguments: what each kind of input accepts, how it is read, written and put into JSON."""

from __future__ import annotations

import ast
import io
from datetime import date, datetime, timedelta
from fnmatch import fnmatch
from typing import Any

from .cube import Cube, ValidationError
from .functions.geometry import Geometry, box, parse_geometry, point, polygon

_FORMATS = ((("%Y-%m-%dT%H:%M:%S"), timedelta(0)), (("%Y-%m-%d %H:%M:%S"), timedelta(0)), ("%Y-%m-%d", timedelta(hours=24, seconds=-1)), ("%Y-%m", timedelta(weeks=4, seconds=-1)), ("%Y", timedelta(days=365, seconds=-1)))


def to_datetime(value: Any, upper: bool = False) -> datetime | None:
    """A moment; as an upper bound a day, month or year reaches to its end (a month has four weeks here, a year 365 days)."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day, 12)
    text = str(value).strip().removesuffix("Z")
    for form, rest in _FORMATS:
        try:
            return datetime.strptime(text, form) + (rest if upper else timedelta(0))
        except ValueError:
            pass
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        raise ValidationError(f"cannot read {value!r} as a date and time") from None


def to_datetime_range(start: Any, end: Any = None) -> tuple[datetime | None, datetime | None]:
    return to_datetime(start), to_datetime(start if end is None or end == "" else end, upper=True)


class Like:
    """A kind of input. convert() reads a value or raises ValidationError; format() writes it as text."""

    name = "any"

    @classmethod
    def convert(cls, value: Any) -> Any:
        return value

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else str(value)

    @classmethod
    def accepts(cls, value: Any) -> bool:
        try:
            cls.convert(value)
            return True
        except (ValueError, TypeError):
            return False

    @classmethod
    def to_json(cls, value: Any) -> Any:
        return cls.format(cls.convert(value)) if value is not None else None

    @classmethod
    def from_json(cls, value: Any) -> Any:
        return cls.convert(value)

    @classmethod
    def _refuse(cls, value: Any) -> ValidationError:
        return ValidationError(f"cannot convert value <{value!r}> to {cls.name}")


class Arbitrary(Like):
    name = "Arbitrary"


class Literal(Like):
    name = "Literal"

    @classmethod
    def convert(cls, value: Any) -> Any:
        if not isinstance(value, str):
            return value
        if not value.strip():
            return None
        try:
            return ast.literal_eval(value)
        except (ValueError, SyntaxError):
            raise cls._refuse(value) from None

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else repr(value)


class Text(Like):
    name = "str"

    @classmethod
    def convert(cls, value: Any) -> str | None:
        if value is None or isinstance(value, str):
            return value
        raise cls._refuse(value)


class HTMLLike(Text):
    name = "HTMLLike"


class VarName(Text):
    name = "VarName"


class DimName(Text):
    name = "DimName"


class VarNamesLike(Like):
    """Names or patterns, as a list or separated by commas."""

    name = "VarNamesLike"

    @classmethod
    def convert(cls, value: Any) -> list[str] | None:
        if value is None or value == "" or value == []:
            return None
        if isinstance(value, str):
            return [x.strip() for x in value.split(",") if x.strip()]
        if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
            return list(value)
        raise cls._refuse(value)

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else ", ".join(cls.convert(value) or [])

    @classmethod
    def pick(cls, value: Any, names: list[str]) -> list[str]:
        """The names that match any pattern, all if there is none."""
        patterns = cls.convert(value)
        return list(names) if not patterns else [n for n in names if any(fnmatch(n, p) for p in patterns)]


class DimNamesLike(VarNamesLike):
    name = "DimNamesLike"


class FileLike(Like):
    name = "FileLike"

    @classmethod
    def convert(cls, value: Any) -> Any:
        if value is None or value == "":
            return None
        if isinstance(value, (str, io.IOBase)):
            return value
        raise cls._refuse(value)


class DictLike(Like):
    name = "DictLike"

    @classmethod
    def convert(cls, value: Any) -> dict | None:
        if value is None or isinstance(value, dict):
            return value
        if isinstance(value, str):
            if not value.strip():
                return None
            try:
                call = ast.parse(f"dict({value})", mode="eval").body
                if isinstance(call, ast.Call) and not call.args and all(k.arg for k in call.keywords):
                    return {k.arg: ast.literal_eval(k.value) for k in call.keywords}
            except (ValueError, SyntaxError):
                pass
        raise cls._refuse(value)

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else ", ".join(f"{k}={v!r}" for k, v in value.items())


class TimeLike(Like):
    name = "TimeLike"

    @classmethod
    def convert(cls, value: Any) -> datetime | None:
        if value is None or isinstance(value, (str, date)):
            return to_datetime(value)
        raise cls._refuse(value)

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else value.isoformat() if value.time() != datetime.min.time() else value.strftime("%Y-%m-%d")


class TimeRangeLike(Like):
    name = "TimeRangeLike"

    @classmethod
    def convert(cls, value: Any) -> tuple[datetime | None, datetime | None] | None:
        if value is None or value == "":
            return None
        parts = [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value) if isinstance(value, (tuple, list)) else None
        if parts is None or len(parts) not in (1, 2):
            raise cls._refuse(value)
        if not isinstance(value, str) and len(parts) != 2:
            raise cls._refuse(value)
        low, high = to_datetime_range(parts[0], parts[1] if len(parts) == 2 else None)
        if low and high and low > high:
            raise ValidationError(f"the range {value!r} ends before it starts")
        return low, high

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else ", ".join(TimeLike.format(x) for x in value)


class GeometryLike(Like):
    name = "GeometryLike"

    @classmethod
    def convert(cls, value: Any) -> Geometry | None:
        if value is None or value == "":
            return None
        try:
            return parse_geometry(value)
        except (ValueError, TypeError, IndexError):
            raise cls._refuse(value) from None

    @classmethod
    def format(cls, value: Any) -> str:
        return "" if value is None else value.wkt


class PointLike(GeometryLike):
    name = "PointLike"

    @classmethod
    def convert(cls, value: Any) -> Geometry | None:
        if isinstance(value, (tuple, list)) and len(value) == 2 and all(isinstance(x, (int, float)) for x in value):
            return point(*map(float, value))
        found = super().convert(value)
        if found is not None and found.kind != "POINT":
            raise cls._refuse(value)
        return found


class PolygonLike(GeometryLike):
    """A polygon; a box as text or four numbers; a ring of coordinates. Those without area are refused."""

    name = "PolygonLike"

    @classmethod
    def convert(cls, value: Any) -> Geometry | None:
        if isinstance(value, (tuple, list)) and len(value) == 4 and all(isinstance(x, (int, float)) for x in value):
            return box(*map(float, value))
        if isinstance(value, (tuple, list)) and value and isinstance(value[0], (tuple, list)):
            return polygon([(float(x), float(y)) for x, y in value])
        found = super().convert(value)
        if found is None:
            return None
        if found.kind not in ("POLYGON", "MULTIPOLYGON") or not found.area:
            raise cls._refuse(value)
        return found


class CubeLike(Like):
    name = "DatasetLike"

    @classmethod
    def convert(cls, value: Any) -> Cube | None:
        if value is None or isinstance(value, Cube):
            return value
        if hasattr(value, "columns") and hasattr(value, "schema"):
            dims = [d for d in ("time", "lat", "lon") if d in value.columns]
            if dims:
                return Cube.of(value, dims)
        raise cls._refuse(value)


class DataFrameLike(Like):
    name = "DataFrameLike"

    @classmethod
    def convert(cls, value: Any) -> Any:
        if value is None or hasattr(value, "sparkSession"):
            return value
        if isinstance(value, Cube):
            return value.df
        raise cls._refuse(value)
