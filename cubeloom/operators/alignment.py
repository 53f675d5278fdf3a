"""Temporal alignment: a replica on the time steps of a primary."""

from __future__ import annotations

import bisect
import warnings
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..cube import Cube, ValidationError, small
from ..functions.quantiles import aggregated
from ..functions.splines import between
from ..functions.temporal import guess_period, parse_period
from ..functions.weights import table
from ..op import op

DOWN = ("count", "first", "last", "max", "min", "mean", "median", "std", "sum", "var")
UP = ("linear", "nearest", "zero", "slinear", "quadratic", "cubic")
NOMINAL = {"min": 60, "h": 3600, "D": 86400, "W": 604800, "MS": 30 * 86400, "QS": 90 * 86400, "YS": 364 * 86400}


def step_seconds(alias: str) -> float:
    p = parse_period(alias)
    if p.kind == "second":
        return p.n
    if p.kind == "week":
        return p.n * NOMINAL["W"]
    return p.n // 12 * NOMINAL["YS"] if p.n % 12 == 0 else p.n // 3 * NOMINAL["QS"] if p.n % 3 == 0 else p.n * NOMINAL["MS"]


def time_bounds(times: list[datetime], alias: str) -> list[tuple[datetime, datetime]]:
    """Of each step: its calendar period, or half a step to either side."""
    p = parse_period(alias)
    if p.kind == "month":
        out = []
        for t in times:
            k = t.year * 12 + t.month - 1
            if p.n in (3, 12):
                k -= (k - p.anchor) % p.n if p.n == 12 else k % 3
            out.append((datetime(k // 12, k % 12 + 1, 1), datetime((k + p.n) // 12, (k + p.n) % 12 + 1, 1)))
        return out
    half = (times[1] - times[0]) / 2
    return [(t - half, t + half) for t in times]


@op(tags=("temporal", "alignment", "resampling"), method=dict(value_set=[*DOWN, *UP]))
def temporal_alignment(ds_primary: Cube, ds_replica: Cube, method: str = "mean") -> Cube:
    """The replica's variables at the primary's time steps: aggregated to coarser steps, interpolated to finer ones."""
    for c in (ds_primary, ds_replica):
        if "time" not in c.dims:
            raise ValidationError("temporal alignment needs the dimension time in both datasets")
    tp, tr = ds_primary.labels("time"), ds_replica.labels("time")
    fp, fr = guess_period(tp), guess_period(tr)
    if fp is None:
        raise ValidationError("the primary dataset's time steps are not evenly spaced")
    bp = time_bounds(tp, fp)
    br = time_bounds(tr, fr) if fr else [(a, b) for a, b in zip(tr, [*tr[1:], tr[-1] + (tr[-1] - tr[-2] if len(tr) > 1 else timedelta(1))])]
    down = step_seconds(fp) > (step_seconds(fr) if fr else (tr[1] - tr[0]).total_seconds() if len(tr) > 1 else 0)
    kept = [i for i, (a, b) in enumerate(br) if b > bp[0][0] and a < bp[-1][1]]
    if not kept:
        raise ValidationError("the time ranges of the datasets do not overlap")
    if down != (method in DOWN):
        warnings.warn(f"method {method!r} is not one for {'down' if down else 'up'}sampling", stacklevel=2)
        method = "mean" if down else "nearest"
    rest, names, spark = ds_replica.others("time"), list(ds_replica.vars), ds_replica.df.sparkSession
    if down:
        edges = _edges(tp, bp, [tr[i] for i in kept], fp)
        rows = [(tp[b], tr[i]) for i in kept for b in _bins_of(tr[i], edges)]
        if not rows:
            raise ValidationError("the time ranges of the datasets do not overlap")
        bins = F.broadcast(spark.createDataFrame(rows, "_time timestamp_ntz, time timestamp_ntz"))  # of one axis: a row for each of the replica's steps
        t = F.col("time")
        made = {"count": F.count, "max": F.max, "min": F.min, "mean": F.avg, "median": None, "std": F.stddev_pop, "var": F.var_pop, "sum": F.sum, "first": lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), t)), "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), t))}[method]
        binned, middles = ds_replica.df.join(bins, "time"), {v: F.col(v) for v in names} if method == "median" else {}
        got = aggregated(binned, ["_time", *rest], [] if middles else [made(v).alias(v) for v in names], middles).withColumnRenamed("_time", "time")
    elif method in ("nearest", "zero", "linear", "slinear"):
        got = _between(ds_replica, tp, [tr[i] for i in kept], [br[i] for i in kept], fr, method)
    else:
        got = _spline(ds_replica, tp, [tr[i] for i in kept], 2 if method == "quadratic" else 3)
    steps = spark.createDataFrame([(t,) for t in tp], "time timestamp_ntz")
    grid = F.broadcast(steps).crossJoin(ds_replica.df.select(*rest).distinct()) if rest else steps  # the primary's steps for every cell
    return ds_replica.on(grid.join(got, ["time", *rest], "left").select("time", *rest, *names), names, ("time", *rest))


def _edges(tp: list[datetime], bp: list[tuple], tr: list[datetime], alias: str) -> list[tuple[datetime, datetime, int]]:
    """(from, to, number of the primary's step). Calendar steps contain their period; steps of fixed length are counted from
    midnight before the first replica step, moved on by its distance from its primary step's start."""
    p = parse_period(alias)
    if p.kind == "month":
        return [(a, b, i) for i, (a, b) in enumerate(bp)]
    size = timedelta(seconds=step_seconds(alias))
    t0 = tr[0]
    home = next((i for i, (a, b) in enumerate(bp) if a <= t0 < b), 0)
    start = datetime(t0.year, t0.month, t0.day) + (t0 - bp[home][0])
    while start > t0:
        start -= size
    return [(start + k * size, start + (k + 1) * size, home + k) for k in range(len(tp) - home)]


def _bins_of(t: datetime, edges: list[tuple]) -> list[int]:
    i = bisect.bisect_right([e[0] for e in edges], t) - 1
    return [edges[i][2]] if i >= 0 and t < edges[i][1] else []


def _between(ds: Cube, tp: list[datetime], tr: list[datetime], br: list[tuple], alias: str | None, method: str):
    """Of each primary step the one or two replica steps that count, with weights."""
    calendar = alias is not None and parse_period(alias).kind == "month"
    rows = []
    for t in tp:
        if not br[0][0] <= t <= br[-1][1]:
            continue
        i = bisect.bisect_right(tr, t) - 1
        if method == "nearest":
            if calendar:
                near = next((k for k, (a, b) in enumerate(br) if a <= t < b), None)
            else:
                near = 0 if i < 0 else i if i + 1 >= len(tr) or t - tr[i] <= tr[i + 1] - t else i + 1
            if near is not None:
                rows.append((t, tr[near], 1.0))
        elif 0 <= i and (t == tr[i] or method == "zero"):
            rows.append((t, tr[i], 1.0))
        elif 0 <= i < len(tr) - 1:
            share = (t - tr[i]) / (tr[i + 1] - tr[i])
            rows += [(t, tr[i], 1 - share), (t, tr[i + 1], share)]
    rest, names = ds.others("time"), list(ds.vars)
    pairs = F.broadcast(ds.df.sparkSession.createDataFrame(rows, "_time timestamp_ntz, time timestamp_ntz, w double"))  # at most two rows for each primary step
    met = ds.df.join(pairs, "time")
    value = lambda v: F.when(F.count(F.when(F.col(v).isNull(), 1)) == 0, F.sum(F.col(v) * F.col("w")))
    return met.groupBy("_time", *rest).agg(*(value(v).alias(v) for v in names)).withColumnRenamed("_time", "time")


def _spline(ds: Cube, tp: list[datetime], tr: list[datetime], degree: int):
    """The interpolating spline of a degree through the replica steps: a sum over steps by weights that depend on the axes
    alone. None outside of the steps, nor where a value with a weight is missing."""
    seconds = lambda ts: [(t - tr[0]).total_seconds() for t in ts]
    found = between(seconds(tr), seconds(tp), degree)
    rest, names = ds.others("time"), list(ds.vars)
    counts = Counter(i for i, _, _ in found)
    rows = [(tp[i], tr[j], w, counts[i]) for i, j, w in found]
    pairs = small(ds.df.sparkSession.createDataFrame(rows, "_time timestamp_ntz, time timestamp_ntz, w double, n int"))
    met = ds.df.join(pairs, "time")
    value = lambda v: F.when(F.count(v) == F.max("n"), F.sum(F.col(v) * F.col("w")))
    return met.groupBy("_time", *rest).agg(*(value(v).alias(v) for v in names)).withColumnRenamed("_time", "time")
