"""How the cells of one axis overlap those of another: small tables made on the driver, which joins use by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overlap(source: int, out: int) -> list[tuple[int, int, float, bool]]:
    """(out, source, weight, whole): the share of each source cell in each output cell; whole: within the half-open range
    of numbers that an output cell covers."""
    rows, scale = [], source / out
    for o in range(out):
        low, high = scale * o, scale * (o + 1)
        s0, s1 = int(low), int(high)
        w0, w1 = 1 - (low - s0), high - s1
        last = s1 if w1 >= 1e-10 else s1 - 1
        if w1 < 1e-10:
            w1 = 1.0
            s1 = max(s0, s1 - 1)
        for s in range(s0, min(s1, source - 1) + 1):
            rows.append((o, s, w0 if s == s0 else w1 if s == s1 else 1.0, s <= max(last, s0)))
    return rows


def neighbours(source: int, out: int, linear: bool) -> list[tuple[int, int, float]]:
    """(out, source, weight): the nearest cell, or the two around a linear position."""
    rows = []
    for o in range(out):
        if not linear:
            rows.append((o, min(int(source / out * o), source - 1), 1.0))
            continue
        x = (source - 1) / (out - 1) * o if out > 1 else 0.0
        i = min(int(x), source - 1)
        t = x - i
        rows.append((o, i, 1 - t))
        if i + 1 < source:
            rows.append((o, i + 1, t))
    return rows


def table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of an axis: as many rows as its cells meet; marked for broadcast up to a million rows."""
    kinds = {bool: "boolean", int: "int", float: "double"}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, rows[0])))
    return F.broadcast(df) if len(rows) <= 1_000_000 else df

