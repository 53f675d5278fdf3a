"""Exact quantiles of columns of any length, by narrowing histograms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import small
from ..shipping import stored

BINS = 2048
#: Rows of a group whose median is found by sorting them in one aggregate, at most.
MOST_OF_GROUP = 1_000_000


def exact_quantiles(df: DataFrame, x: Column, levels: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of one column."""
    return quantiles_of(df, {"x": x}, levels)["x"]


def quantiles_of(df: DataFrame, columns: dict[str, Column], levels: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, all in the same passes over df.

    Each pass counts the values of some ranges in bins; a range narrows to the bins that hold the wanted ranks, until
    these hold one value each. Two or three passes are common; no task and no pass holds more than the ranges' bins.
    """
    names = list(columns)
    if not names:
        return {}
    values = df.select(*(columns[v].cast("double").alias(f"x{i}") for i, v in enumerate(names)))
    ends = values.agg(*(f for i in range(len(names)) for f in (F.count(f"x{i}"), F.min(f"x{i}"), F.max(f"x{i}")))).first()
    size = [ends[3 * i] for i in range(len(names))]
    known: list[dict[int, float]] = [{} for _ in names]
    # (column, from, to, values below, ranks)
    ranges: list[tuple[int, float, float, int, list[int]]] = []
    for i in range(len(names)):
        ranks = sorted({k for q in levels for k in (math.floor(q * (size[i] - 1)), min(math.floor(q * (size[i] - 1)) + 1, size[i] - 1))}) if size[i] else []
        ranges.append((i, ends[3 * i + 1], ends[3 * i + 2], 0, ranks))
    while True:
        for i, a, b, _, ranks in ranges:
            if a == b:
                known[i].update(dict.fromkeys(ranks, a))
        ranges = [r for r in ranges if r[1] != r[2] and r[4]]
        if not ranges:
            break
        each = []
        for k, (i, a, b, _, _) in enumerate(ranges):
            x, width = F.col(f"x{i}"), b / BINS - a / BINS
            # where bins would be too narrow to tell doubles apart there are few of these: each is its own bin
            place = x if width <= 4 * math.ulp(max(abs(a), abs(b))) else F.least(F.floor((x - a) / width), F.lit(BINS - 1)).cast("double")
            if not math.isfinite(width):  # an end is infinite: the ends and what is between
                place = F.when(x == a, 0.0).when(x == b, 2.0).otherwise(1.0)
            each.append(F.when(x.between(a, b), F.struct(F.lit(k).alias("range"), place.alias("bin"), x.alias("x"))))
        rows = values.select(F.inline(F.array_compact(F.array(*each)))).groupBy("range", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("range", "bin").collect()
        narrower = []
        for k, (i, _, _, below, ranks) in enumerate(ranges):
            for r in (r for r in rows if r["range"] == k):
                inside = [x for x in ranks if below <= x < below + r["n"]]
                if inside:
                    narrower.append((i, r["a"], r["b"], below, inside))
                below += r["n"]
        ranges = narrower
    out = {}
    for i, v in enumerate(names):
        out[v] = []
        for q in levels:
            if not size[i]:
                out[v].append(None)
                continue
            place = q * (size[i] - 1)
            low = known[i][math.floor(place)]
            out[v].append(low + (known[i][min(math.floor(place) + 1, size[i] - 1)] - low) * (place - math.floor(place)))
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> Column:
    """Equality of keys of a and columns of b, null with null."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[n]) for k, n in zip(keys, names)), F.lit(True))


def _large_medians(df: DataFrame, keys: list[str], large: DataFrame, columns: list[Column]) -> DataFrame:
    """Medians m0, m1, ... of the groups in large, by narrowing histograms of all of them in common passes.

    The state has a row for each group, column and middle rank: the range of values that the rank lies in. A pass counts the
    range's values in bins, and the bin with the rank is the next range, until its ends are one value.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    at = [*own, "_v"]
    named = small(large.select(*(F.col(k).alias(n) for k, n in zip(keys, own))))
    each = F.array(*(F.struct(F.lit(i).alias("_v"), x.cast("double").alias("x")) for i, x in enumerate(columns)))
    values = df.join(named, _same(df, named, keys, own)).select(*own, F.inline(each)).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = values.groupBy(*at).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = stored(ends.select(*at, "a", "b", F.explode(middle).alias("r")).withColumn("left", F.col("r")), "medians")
    while not (going := state.where("a < b")).isEmpty():
        ask = small(going.select(*(F.col(c).alias(f"{c}_") for c in at), "a", "b", "r", "left"))
        met = values.join(ask, _same(values, ask, at, [f"{c}_" for c in at])).where(F.col("x").between(F.col("a"), F.col("b")))
        width = F.col("b") / BINS - F.col("a") / BINS
        fine = width <= 1e-15 * F.greatest(F.abs("a"), F.abs("b"))  # few doubles are left in between: each is its own bin
        ends_only = F.when(F.col("x") == F.col("a"), 0.0).when(F.col("x") == F.col("b"), 2.0).otherwise(1.0)
        place = F.when(F.abs(width) == float("inf"), ends_only).when(fine, F.col("x")).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(BINS - 1)).cast("double"))
        bins = met.groupBy(*at, "r", "left", place.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        below = F.sum("c").over(Window.partitionBy(*at, "r").orderBy("bin")) - F.col("c")
        held = bins.withColumn("below", below).where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col("c")))
        narrower = held.select(*at, "a", "b", "r", (F.col("left") - F.col("below")).alias("left"))
        state = stored(state.where("a = b").unionByName(narrower), "medians")
    found = state.groupBy(*at).agg(F.avg("a").alias("m"))
    wide = found.groupBy(*own).agg(*(F.max(F.when(F.col("_v") == i, F.col("m"))).alias(f"m{i}") for i in range(len(columns))))
    every = large.select(*keys)  # groups without a value too
    return every.join(wide, _same(every, wide, keys, own), "left").select(*keys, *(f"m{i}" for i in range(len(columns))))


def aggregated(df: DataFrame, keys: list[str], figures: list[Column], medians: dict[str, Column], most: int = MOST_OF_GROUP) -> DataFrame:
    """df by keys: figures, and exact medians under their names, null and not-a-number left out.

    The rows of the largest groups are counted first: groups up to `most` rows sort their values in one aggregate, larger
    ones narrow histograms, all together, and so no task holds more than `most` values of a group.
    """
    exact = [F.median(F.when(~F.isnan(x.cast("double")), x)).alias(n) for n, x in medians.items()]
    if not medians:
        return df.groupBy(*keys).agg(*figures)
    if not keys:
        found = quantiles_of(df, {n: F.when(~F.isnan(x.cast("double")), x) for n, x in medians.items()}, [0.5])
        told = [F.lit(found[n][0]).cast("double").alias(n) for n in medians]
        return df.agg(*(figures or [F.count("*").alias("_n")])).select("*", *told).drop("_n")
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    if large.isEmpty():
        return df.groupBy(*keys).agg(*figures, *exact)
    large = stored(large, "large")
    names = [f"_g{i}" for i in range(len(keys))]
    marks = small(large.select(*(F.col(k).alias(n) for k, n in zip(keys, names))))
    rest = df.join(marks, _same(df, marks, keys, names), "left_anti")
    of_large = _large_medians(df, keys, large, list(medians.values()))
    all_medians = rest.groupBy(*keys).agg(*exact).unionByName(of_large.select(*keys, *(F.col(f"m{i}").alias(n) for i, n in enumerate(medians))))
    if not figures:
        return all_medians
    base = df.groupBy(*keys).agg(*figures)
    other = all_medians.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *medians)
    return base.join(other, _same(base, other, keys, names)).drop(*names)
