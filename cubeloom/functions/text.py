"""Small text utilities: times in names, constants, free names, URL paths, values for JSON."""

from __future__ import annotations

import ast
import re
from datetime import date, datetime
from typing import Any
from urllib.parse import quote, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"(?<!\d)(\d{4})-?(0[1-9]|1[0-2])(?:-?(0[1-9]|[12]\d|3[01])(?:T?([01]\d|2[0-3]):?([0-5]\d):?([0-5]\d))?)?(?!\d)"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def time_strings(text: str) -> list[str]:
    """The times in a name such as x-20020401-20020406.nc, as ISO dates; else the number of a month that it names."""
    found = []
    for y, m, d, h, mi, s in re.findall(_STAMP, text):
        found.append("-".join(filter(None, (y, m, d))) + (f"T{h}:{mi}:{s}" if h else ""))
    if not found:
        found = [f"{k + 1:02d}" for k, n in enumerate(_MONTHS) if re.search(rf"(?<![a-z]){n[:3]}(?:{n[3:]})?(?![a-z])", text.lower())]
    return found


def first_time(name: Column) -> Column:
    """The first day in a column of names, null if there is none."""
    day = F.regexp_extract(name, r"(?<!\d)(\d{4}-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12]\d|3[01]))", 1)
    return F.try_to_timestamp(F.nullif(F.replace(day, F.lit("-"), F.lit("")), F.lit("")), F.lit("yyyyMMdd")).cast("timestamp_ntz")


def simple_date(value: date) -> str:
    """Without a time of midnight."""
    return value.strftime("%Y-%m-%d") if not isinstance(value, datetime) or value.time() == datetime.min.time() else value.strftime("%Y-%m-%dT%H:%M:%S")


def to_json(value: Any) -> Any:
    """A value of plain types: dates as text, complex numbers as pairs, arrays as lists, what is not finite as null."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    if isinstance(value, complex):
        return [value.real, value.imag]
    if isinstance(value, date):
        return simple_date(value)
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        return to_json(value.tolist())
    if isinstance(value, (list, tuple, set, frozenset)):
        return [to_json(v) for v in value]
    return str(value)


def to_list(value: Any, kind: type = str) -> list:
    """None as an empty list, one value as a list of it, each of the kind."""
    if value is None:
        return []
    items = list(value) if isinstance(value, (list, tuple, set)) else [value]
    for x in items:
        if not isinstance(x, kind):
            raise ValueError(f"{x!r} is not of type {kind.__name__}")
    return items


def new_indexed_name(names: set[str], pattern: str) -> str:
    """The first name of a pattern with {index} that is not taken."""
    if "{index" not in pattern:
        raise ValueError('pattern must contain "{index}"')
    return next(n for k in range(1, len(names) + 2) if (n := pattern.format(index=k)) not in names)


def encode_url_path(pattern: str, path_args: dict | None = None, query_args: dict | None = None) -> str:
    path = pattern % {k: quote(str(v), safe="") for k, v in (path_args or {}).items()} if path_args else pattern
    return f"{path}?{urlencode(query_args)}" if query_args else path


def is_str_constant(text: str) -> bool:
    try:
        return isinstance(ast.literal_eval(text), str)
    except (ValueError, SyntaxError):
        return False


def to_str_constant(text: str, quote_mark: str = "'") -> str:
    return quote_mark + text.replace("\\", "\\\\").replace(quote_mark, "\\" + quote_mark) + quote_mark


def to_scalar(value: Any, digits: int | None = None, default: Any = None) -> Any:
    """The one value of a row, list or array of one; else the default."""
    while isinstance(value, (list, tuple)) or hasattr(value, "shape"):
        if hasattr(value, "item") and getattr(value, "size", 0) == 1:
            value = value.item()
        elif hasattr(value, "__len__") and len(value) == 1:
            value = value[0]
        else:
            return default
    return round(value, digits) if digits is not None and isinstance(value, float) else value
