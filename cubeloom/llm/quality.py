"""Quality by a sparse rule ensemble over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path in them is a rule, a conjunction of
bounds on statistics. A lasso-penalised logistic fit keeps few rules; they are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, in_task, small_batches

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_neighbours", "lines_distinct", "line_words", "upper", "digits", "stops",
    "commas", "exclaims", "bars", "marks", "other_marks", "controls", "not_ascii", "longest_word", "marked_words",
)
_CLASS = np.full(256, -1)
_GROUPS = {"upper": range(65, 91), "digits": range(48, 58), "stops": b".?", "commas": b",;:", "exclaims": b"!", "bars": b"|<>{}[]\\/_=", "marks": b"%$&*#@^~+", "other_marks": b"\"'`()-", "controls": [*range(9), *range(11, 32), 127], "not_ascii": range(128, 256)}
for _k, _g in enumerate(_GROUPS.values()):
    _CLASS[list(_g)] = _k


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text, in the order of STATISTICS; of an empty one, all zero."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    if not data:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = [float(counts[_CLASS == k].sum()) / len(data) for k in range(len(_GROUPS))]
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    same = sum(map(str.__eq__, words, words[1:]))
    marked = sum(1 for w in words if not w[-1].isalnum()) / n
    return (
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, same / n, len(set(lines)) / len(lines), n / len(lines),
        *share, math.log1p(max(map(len, words), default=0)), marked,
    )


def statistics(text: str) -> Column:
    """The statistics of a text column as one struct."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(x) for x in texts], columns=list(STATISTICS))

    return of(text)


@dataclass
class Rules:
    """A logistic score: intercept plus the weights of the rules that hold. A rule: (statistic, is_above, bound) each."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, of: str) -> Column:
        """The score, from a struct column of statistics."""
        z = F.lit(self.intercept)
        for bounds, weight in self.rules:
            test = F.lit(True)
            for name, above, bound in bounds:
                x = F.col(f"{of}.{name}")
                test = test & ((x > bound) if above else (x <= bound))
            z = z + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> list[tuple]:
    """Grow one tree by second-order gain: its nodes as (bounds, rows, value)."""
    out: list[tuple] = []

    def grow(rows: np.ndarray, bounds: tuple, level: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        if level:
            out.append((bounds, rows, g / (h + 1.0), level))
        if level == depth or len(rows) < 2 * least:
            return
        best = (1e-6, None, None)
        for j, cut in enumerate(edges):
            if not len(cut):
                continue
            k = len(cut) + 1
            cg = np.cumsum(np.bincount(bins[rows, j], gradient[rows], k))[:-1]
            ch = np.cumsum(np.bincount(bins[rows, j], hessian[rows], k))[:-1]
            cn = np.cumsum(np.bincount(bins[rows, j], minlength=k))[:-1]
            gain = cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1)
            gain[(cn < least) | (len(rows) - cn < least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], j, i)
        _, j, i = best
        if j is None:
            return
        low = bins[rows, j] <= i
        bound = float(edges[j][i])
        grow(rows[low], (*bounds, (j, False, bound)), level + 1)
        grow(rows[~low], (*bounds, (j, True, bound)), level + 1)

    grow(np.arange(len(x)), (), 0)
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty (none on the intercept, the last column of a), by accelerated proximal steps."""
    n, m = a.shape[0], a.shape[1] - 1

    def through(v: np.ndarray, f: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
        """a.T @ f(a @ v), a part of the rows at a time."""
        out = np.zeros(m + 1)
        for lo in range(0, n, 2000):
            rows = slice(lo, lo + 2000)
            part = a[rows].astype(float)
            out += part.T @ f(part @ v, rows)
        return out

    v = np.ones(m + 1)
    for _ in range(30):
        v = through(v, lambda z, _: z)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / norm
    w = np.zeros(m + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[m] = math.log(share / (1 - share))
    u, t = w.copy(), 1.0
    for _ in range(rounds):
        new = u - step * through(u, lambda z, rows: 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:m], float(w[m])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4) -> Rules:
    """Rules from labelled statistics: every path of every tree is one. Without rows the score is 0.5; with one label only, near that label."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Rules(math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    edges = [e[(e >= c.min()) & (e < c.max())] for e, c in zip(edges, x.T)]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    z, found = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    least = max(3, min(20, len(y) // 100))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        nodes = _tree(x, bins, edges, y - p, p * (1 - p), depth, least)
        for bounds, rows, value, level in nodes:
            found.setdefault(frozenset(bounds), (bounds, rows))
            if level == depth or not any(set(bounds) < set(b) for b, *_ in nodes):
                z[rows] += 0.3 * value
    rules = list(found.values())
    if not rules:
        return Rules(math.log(y.mean() / (1 - y.mean())))
    a = np.zeros((len(y), len(rules) + 1), bool)
    a[:, -1] = True  # for the intercept
    for k, (_, rows) in enumerate(rules):
        a[rows, k] = True
    w, b = _lasso(a, y, penalty)
    keep = [(tuple((STATISTICS[j], up, c) for j, up, c in bounds), float(v)) for (bounds, _), v in zip(rules, w) if abs(v) > 1e-6]
    return Rules(b, keep)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Rules:
    """Fit on at most max_rows labelled rows (the first by a hash of the id), never on those with crc32(doc_id) mod 4 of 2."""
    small_batches(docs.sparkSession)
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "y", statistics("text").alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y", "s.*")

    def fitted(some: pd.DataFrame) -> Rules:
        some = some.sort_values("doc_id", kind="stable")
        return fit(some[list(STATISTICS)].to_numpy(float), some["y"].to_numpy(float))

    return in_task(rows, fitted)


def score(docs: DataFrame, model: Rules, into: str = "score") -> DataFrame:
    """docs with the column `into`: 0 to 1, higher where label 1 is likelier; a column of that name gives way.

    Null and empty texts have statistics of zero and a score like any other; ids and other columns play no part, nulls and
    repeated rows stay as they are. An empty table gives none. The whole text counts.
    """
    small_batches(docs.sparkSession)
    (held,) = fresh([*docs.columns, into], "_statistics")
    return docs.withColumn(held, statistics("text")).withColumn(into, model.column(held)).drop(held)
