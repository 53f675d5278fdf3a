"""Hard negatives by k-means inverted lists with stored centroid radii.

Centroids are fitted by Lloyd's steps on a bounded sample; every row goes to the list of its nearest one. A list is stored
in pieces of bounded size in the folder that all executors share, and keeps its radius: the largest distance of a member from
the centroid. By Cauchy-Schwarz, no member of a list scores more than <q, c> + |q| r with a vector q, or less than <q, c> - |q| r.

A block of anchors visits lists by falling upper bound, each anchor in its own order, and stops when the bound is strictly
below its k-th score: first for its positives, then for the negatives of all its positives' windows together. A list whose
lower bound is above a window, or whose upper bound is below it, is skipped for that window. Anchors go on by rounds that
double, and in a round all anchors that come to a list are scored with it by one product of matrices; of the scores only
those between the k-th ones and the windows' upper ends are looked at. The search is exact; how well the centroids fit
changes only what it reads. Where vectors spread in many directions the bounds hold back little, and the work is that of
all pairs of anchors and rows, at the price of a multiplication of matrices.

Of rows with one vector and label only the first ids can be among the first of any answer (ties go to smaller ids), so each
such group keeps that many ids before vectors are moved; a vector that a third of all rows have is one short group.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, in_task, scratch, small_batches, stored
from .search import NO_ID, Best, ball_of

#: Rows for each list, lists of one length of vector at most, rows of the sample for each list, Lloyd's steps.
LIST, MOST_LISTS, SAMPLE_OF_LIST, STEPS = 512, 4096, 4, 8
#: Rows of a stored piece and anchors of a block (about); bytes of pieces that a task keeps.
PIECE, BLOCK, KEPT = 4096, 512, 128_000_000
#: Anchors of a block at least, where more blocks would only share out few; columns scored at a time.
FEW, WIDE = 64, 2048
#: Whole components of vectors shorter than this multiply exactly in single precision: all sums stay below 2**24.
SHORT = 4096.0
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def lloyd(points: np.ndarray, most: int, steps: int = STEPS) -> np.ndarray:
    """Centroids of points by k-means, from distinct points picked by a fixed draw; none is empty."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.random.default_rng(7).permutation(len(distinct))[:most]]
    for _ in range(steps):
        near = ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, points)
        centroids = total[count > 0] / count[count > 0, None]
    return centroids


def centroids_of(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """By length of vector, the centroids of a sample of rows (n, vector): the rows of the smallest hashes."""
    sample = rows.orderBy(F.xxhash64("vector"), "id").limit(SAMPLE_OF_LIST * most).select("n", "vector")

    def fit(frame: pd.DataFrame) -> dict[int, np.ndarray]:
        return {int(n): lloyd(np.array(part["vector"].tolist(), float).reshape(len(part), int(n)), most) for n, part in frame.groupby("n")}

    return in_task(sample, fit)


def is_short(x: np.ndarray) -> bool:
    """Whether products of these vectors and others of this kind are exact in single precision."""
    return bool((x == np.rint(x)).all() and ((x**2).sum(axis=1) < SHORT**2).all())


def _write(folder: str, name: str, **arrays: np.ndarray) -> None:
    """A file that is whole when it has its name, the same from every attempt of a task."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    part = f"{base}/{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(out.getvalue())
    try:
        system.move(part, f"{base}/{name}.npz")
    except OSError:  # there from another attempt, where moving does not replace
        system.delete_file(part)


def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    system, base = filesystem(folder)
    with system.open_input_file(f"{base}/{name}.npz") as f:
        data = np.load(io.BytesIO(f.readall()))
    return {k: data[k] for k in data.files}


def inverted_lists(rows: DataFrame, centroids: dict[int, np.ndarray], folder: str, piece: int = PIECE) -> DataFrame:
    """Store rows (n, id, label, copies, vector) by list in pieces, and of each length n an index of its lists; returns n, lists, members."""
    dealt = rows.withColumn("list", ball_of(F.col("vector"), centroids))
    counts = dealt.groupBy("n", "list").agg(F.count("*").alias("m")).checkpoint()
    pieces = F.ceil(F.col("m") / piece)
    cut = dealt.join(counts, ["n", "list"]).withColumn("piece", F.pmod(F.xxhash64("id", "label", "vector"), pieces).cast("int"))

    def centre(n: int, at: int) -> np.ndarray:
        return centroids[n][at] if n in centroids else np.zeros(n)

    def store(group: pd.DataFrame) -> pd.DataFrame:
        n, at, part = (int(group[c].iloc[0]) for c in ("n", "list", "piece"))
        group = group.sort_values(["label", "id"], kind="stable")
        x = np.array(group["vector"].tolist(), float).reshape(len(group), n)
        _write(folder, f"{n}-{at}-{part}", ids=group["id"].to_numpy(np.int64), labels=group["label"].to_numpy(np.int64), copies=group["copies"].to_numpy(np.int64), x=x.astype(np.int16) if is_short(x) else x)
        radius = float(np.sqrt(((x - centre(n, at)) ** 2).sum(axis=1).max()))
        return pd.DataFrame({"n": [n], "list": [at], "piece": [part], "size": [len(group)], "radius": [radius]})

    known = stored(cut.groupBy("n", "list", "piece").applyInPandas(store, "n int, list int, piece int, size long, radius double"), "lists")

    def describe(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].iloc[0])
        group = group.sort_values("list")
        offsets = np.concatenate(([0], np.cumsum(group["pieces"].map(len))))
        _write(folder, f"index-{n}", centres=np.array([centre(n, at) for at in group["list"]]).reshape(len(group), n), radius=group["radius"].to_numpy(), list=group["list"].to_numpy(), pieces=np.concatenate([np.sort(p) for p in group["pieces"]]), offsets=offsets)
        return pd.DataFrame({"n": [n], "lists": [len(group)], "members": [int(group["members"].sum())]})

    whole = known.groupBy("n", "list").agg(F.max("radius").alias("radius"), F.collect_list("piece").alias("pieces"), F.sum("size").alias("members"))
    return stored(whole.groupBy("n").applyInPandas(describe, "n int, lists long, members long"), "index")


class Lists:
    """The inverted lists of one length of vector, read piece by piece; a bounded part of them stays in memory."""

    def __init__(self, folder: str, n: int) -> None:
        index = _read(folder, f"index-{n}")
        self.centres, self.radius, self.list = index["centres"], index["radius"], index["list"]
        self._pieces, self._offsets, self._folder, self._n = index["pieces"], index["offsets"], folder, n
        self._held: OrderedDict[tuple[int, int], dict[str, np.ndarray]] = OrderedDict()
        self._bytes = 0

    def pieces(self, at: int) -> Iterator[dict[str, np.ndarray]]:
        for p in self._pieces[self._offsets[at] : self._offsets[at + 1]].tolist():
            key = (at, p)
            if key not in self._held:
                self._held[key] = piece = _read(self._folder, f"{self._n}-{self.list[at]}-{p}")
                if piece["x"].dtype == np.int16:
                    piece["x"] = piece["x"].astype(np.float32)
                self._bytes += sum(v.nbytes for v in piece.values())
                while self._bytes > KEPT and len(self._held) > 1:
                    self._bytes -= sum(v.nbytes for v in self._held.popitem(last=False)[1].values())
            self._held.move_to_end(key)
            yield self._held[key]


def _visit(upper: np.ndarray, goes: Callable[[np.ndarray, np.ndarray], np.ndarray], look: Callable[[int, np.ndarray], None]) -> int:
    """Each row visits lists by falling upper bound, as long as goes(rows, lists) says so of its next list; look(list, rows) scores. Returns the visits.

    goes gives 1 to visit, 0 to skip the list, -1 to stop. Rows advance by rounds of 1, 2, 4, ... lists; those that come to one list in a round are scored together."""
    order = np.argsort(-upper, axis=1, kind="stable")
    live, visits, at, wide = np.arange(len(upper)), 0, 0, 1
    while len(live) and at < order.shape[1]:
        next_ = order[live, at : at + wide]
        row, place = np.repeat(np.arange(len(live)), next_.shape[1]), np.tile(np.arange(next_.shape[1]), len(live))
        by = np.lexsort((place, next_.ravel()))
        lists, starts = np.unique(next_.ravel()[by], return_index=True)
        members = np.split(row[by], starts[1:])
        on = np.ones(len(live), bool)
        for i in np.argsort(np.minimum.reduceat(place[by], starts), kind="stable"):  # near ones first
            mine = members[i]
            what = goes(live[mine], np.full(len(mine), lists[i]))
            on[mine[what < 0]] = False  # further lists of the round have no higher bound and say the same
            if (rows := live[mine[what > 0]]).size:
                look(int(lists[i]), rows)
                visits += len(rows)
        live, at, wide = live[on], at + wide, 2 * wide
    return visits


def merge(best: Best, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Put scored ids (a row, a score and an id each) among the best of their rows."""
    touched, row = np.unique(rows, return_inverse=True)
    k = best.score.shape[1]
    all_rows = np.concatenate((np.repeat(np.arange(len(touched)), k), row))
    all_scores, all_ids = np.concatenate((best.score[touched].ravel(), score)), np.concatenate((best.id[touched].ravel(), ids))
    order = np.lexsort((all_ids, -all_scores, all_rows))
    first = np.searchsorted(all_rows[order], np.arange(len(touched)))
    pick = order[first[:, None] + np.arange(k)]
    best.score[touched], best.id[touched] = all_scores[pick], all_ids[pick]


def search_block(lists: Lists, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, positives: int, k: int, window: tuple[int, int]) -> tuple[Best, Best, tuple[int, int]]:
    """Of a block of anchors: the first positives of each, the first k negatives of each anchor and positive (in rows anchor by anchor), and the lists visited for both."""
    m, length = len(ids), np.sqrt((x**2).sum(axis=1))
    middle, reach = x @ lists.centres.T, length[:, None] * lists.radius
    pad = 1e-9 * (np.abs(middle) + reach) + 1e-6
    upper, lower = middle + reach + pad, middle - reach - pad
    none = np.full(m, -np.inf)
    near = Best(m, positives, none)
    x32 = x.astype(np.float32) if is_short(x) else None

    def scored(p: dict[str, np.ndarray], rows: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Products of anchors and rows of a piece, in single precision where that is exact."""
        other = p["x"][at]
        return x32[rows] @ other.T if x32 is not None and other.dtype == np.float32 else x[rows] @ other.astype(float, copy=False).T

    def put(best: Best, rows: np.ndarray, score: np.ndarray, p: dict[str, np.ndarray], columns: np.ndarray, most: int) -> None:
        """Scores of rows of a piece, as often as there are copies, among the best of rows."""
        if len(rows):
            n = np.minimum(p["copies"][columns], most)
            merge(best, np.repeat(rows, n), np.repeat(score, n), np.repeat(p["ids"][columns], n))

    def like(at: int, rows: np.ndarray) -> None:
        for p in lists.pieces(at):
            for label in np.unique(labels[rows]):
                own, same = rows[labels[rows] == label], np.nonzero(p["labels"] == label)[0]
                for lo in range(0, len(same), WIDE):
                    columns = same[lo : lo + WIDE]
                    score = scored(p, own, columns)
                    i, j = np.nonzero(score >= near.score[own, -1].astype(score.dtype)[:, None])
                    other = p["ids"][columns[j]] != ids[own[i]]
                    i, j = i[other], j[other]
                    put(near, own[i], score[i, j].astype(float), p, columns[j], positives)

    first = _visit(upper, lambda rows, at: np.where(upper[rows, at] < near.score[rows, -1], -1, 1), like)
    # windows: from ceil(low * score / 100) to floor(high * score / 100); of a score below zero none
    score = near.score
    there = (score > -np.inf) & (score >= 0)
    whole = np.where(there, score, 0).astype(np.int64)
    least = np.where(there, -((-window[0] * whole) // 100), np.inf)
    most = np.where(there, (window[1] * whole) // 100, -np.inf)
    far = Best(m * positives, k, np.full(m * positives, -np.inf))

    def goes(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        kth = far.score.reshape(m, positives, k)[rows, :, -1]
        over, under = upper[rows, at][:, None], lower[rows, at][:, None]
        on = there[rows] & (over >= least[rows]) & (over >= kth)  # a window that this bound has left is done: later bounds are no higher
        return np.where(on.any(axis=1), (on & (under <= most[rows])).any(axis=1).astype(int), -1)

    def unlike(at: int, rows: np.ndarray) -> None:
        for p in lists.pieces(at):
            for lo in range(0, len(p["ids"]), WIDE):
                score = scored(p, rows, slice(lo, lo + WIDE))
                kth = np.maximum(far.score.reshape(m, positives, k)[rows, :, -1], least[rows])
                # the ends are whole, so they are exact in single precision as scores are
                low, high = kth.min(axis=1).astype(score.dtype), most[rows].max(axis=1).astype(score.dtype)
                i, j = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
                other = p["labels"][lo + j] != labels[rows[i]]
                i, j = i[other], j[other]
                value, column = score[i, j].astype(float), lo + j
                for w in range(positives):
                    fit = (value >= kth[i, w]) & (value <= most[rows[i], w])
                    put(far, rows[i[fit]] * positives + w, value[fit], p, column[fit], k)

    second = _visit(upper, goes, unlike)
    return near, far, (first, second)


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90), per_list: int = LIST, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """Of rows (id long, label int, vector array<double>): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first rows of its label, by inner product, ties to the smaller id, rows of its own id left
    out. Of each positive the first k rows of other labels follow whose score is from window[0] to window[1] hundredths of the
    positive's. Rows with a null vector or label take no part, nor do anchors with a null id; a null id is the last in a tie.
    Repeated rows count each, as anchors too. Vectors meet those of their own length. Other columns play no part; empty
    tables give none. Scores are exact for whole components while sums stay below 2**53; ids are below 2**63 - 1.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    folder = scratch(spark, "lists")
    some = rows.where("vector IS NOT NULL AND label IS NOT NULL").select(F.coalesce("id", F.lit(int(NO_ID))).alias("id"), F.col("label").cast("long").alias("label"), "vector", F.size("vector").alias("n"))
    group = Window.partitionBy("n", "vector", "label").orderBy("id")
    # at most so many of one vector and label can be among the first, the anchor's own id aside
    kept = some.groupBy("n", "vector", "label", "id").agg(F.count("*").alias("copies")).withColumn("at", F.row_number().over(group)).where(F.col("at") <= max(positives, k) + 1).drop("at")
    kept = stored(kept, "distinct")
    centroids = centroids_of(kept, max(1, min(MOST_LISTS, kept.count() // per_list)))
    inverted_lists(kept, centroids, folder, piece).count()
    asked = anchors.where("vector IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL").select("id", F.col("label").cast("long").alias("label"), "vector", F.size("vector").alias("n"))
    asked = asked.withColumn("list", ball_of(F.col("vector"), centroids)).withColumn("at", F.monotonically_increasing_id())
    asked = stored(asked, "anchors")
    n_asked = asked.count()
    parts = max(1, -(-n_asked // block), min(spark.sparkContext.defaultParallelism, n_asked // FEW))
    blocks = asked.repartitionByRange(parts, "n", "list", "id", "at").sortWithinPartitions("n", "list", "id", "at").select("n", "id", "label", "vector")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Lists | None = None
        for frame in frames:
            for n, part in frame.groupby("n"):
                try:
                    held = held if held is not None and held._n == n else Lists(folder, int(n))
                except FileNotFoundError:  # no row has this length
                    continue
                for lo in range(0, len(part), block):
                    own = part.iloc[lo : lo + block]
                    ids, labels = own["id"].to_numpy(np.int64), own["label"].to_numpy(np.int64)
                    near, far, _ = search_block(held, ids, labels, np.array(own["vector"].tolist(), float).reshape(len(own), int(n)), positives, k, window)
                    row, rank = np.nonzero(far.score > -np.inf)
                    a, j = row // positives, row % positives
                    name = lambda x: pd.array(np.where(x == NO_ID, 0, x), "Int64").copy()
                    positive, negative = near.id[a, j], far.id[row, rank]
                    out = pd.DataFrame({"anchor_id": ids[a], "positive_id": name(positive), "rank": (rank + 1).astype(np.int32), "negative_id": name(negative), "positive_score": near.score[a, j].astype(np.int64), "negative_score": far.score[row, rank].astype(np.int64)})
                    out.loc[positive == NO_ID, "positive_id"] = pd.NA
                    out.loc[negative == NO_ID, "negative_id"] = pd.NA
                    yield out

    return blocks.mapInPandas(run, FOUND)
