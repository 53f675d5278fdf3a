"""Exact top-k search by inner product, with dual cover trees.

Queries and candidates are dealt together to balls: around pivots, which are picked farthest first from a bounded sample,
each row goes to the nearest. The rows of a ball make fragments of bounded size; of each one cover tree is built, once,
and stored with its vectors in the folder that all executors share. A pair of a query fragment and a candidate fragment
is a row with two names and the bound

    <q, p> + |q| rp + |p| rq + rq rp

of their centres and covering radii, which no inner product of their points exceeds. Each query fragment first meets the
candidate fragment of the highest bound; the worst k-th score that it then has drops pairs before any tree of them is
read, and the k-th scores prune pairs of nodes by the same bound inside the trees of the pairs that stay. No vector is
moved for a pair: its task reads the two stored trees.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, scratch, small_batches, stored

LEAF, FANOUT = 256, 16
#: Rows of a query fragment and of a candidate fragment at most (about), rows for each ball, balls and sample at most.
QUERY_FRAGMENT, FRAGMENT, BALL, MOST_BALLS, SAMPLE = 4096, 32_768, 8192, 1024, 2048
#: Scores in one block of a product.
BLOCK = 4_000_000
#: Stands for a null id, which is the last in a tie.
NO_ID = np.iinfo(np.int64).max
MOST_BROADCAST = 50_000


def farthest_first(points: np.ndarray, first: int, most: int, near_enough: float = 0.0) -> tuple[list[int], np.ndarray, float]:
    """Picks, the pick that each point is nearest to, and the scale: each point is within it of its pick, and picks are as far from each other."""
    picks, near = [first], ((points - points[first]) ** 2).sum(axis=1)
    place = np.zeros(len(points), np.int64)
    while len(picks) < most and near.max() > near_enough**2:
        at = int(near.argmax())
        d = ((points - points[at]) ** 2).sum(axis=1)
        closer = d < near
        near, place = np.where(closer, d, near), np.where(closer, len(picks), place)
        picks.append(at)
    return picks, place, float(np.sqrt(near.max()))


@dataclass
class Tree:
    """A cover tree. Nodes are in preorder; node i holds points[lo[i]:hi[i]] and its subtree are the nodes i to after[i].

    Nesting: a node's first child has the node's centre. Covering: each point is within the node's scale of its child's
    centre, and within radius (exact) of the node's. Separation: centres of a node's children are a scale apart at least.
    """

    points: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    after: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        self.centres = self.points[self.centre]
        self.norm = np.sqrt((self.centres**2).sum(axis=1))

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j < self.after[i]:
            out.append(j)
            j = int(self.after[j])
        return out


def cover_tree(points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
    """The tree of at least one point; equal points always share a leaf, of any size and radius zero."""
    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    todo, order, nodes, parent, done = [(np.arange(len(points)), middle, -1)], [], [], [], 0
    while todo:
        rows, pick, above = todo.pop()
        own = points[rows]
        radius = float(np.sqrt(((own - points[pick]) ** 2).sum(axis=1).max()))
        here, scale = len(nodes), 0.0
        split = len(rows) > leaf and radius > 0
        if split:
            picks, place, scale = farthest_first(own, int(np.nonzero(rows == pick)[0][0]), fanout, radius / 2)
            split = len(picks) > 1  # squares of huge components are infinite and tell nothing apart
        if split:
            todo += [(rows[place == j], int(rows[picks[j]]), here) for j in range(len(picks) - 1, -1, -1)]
        nodes.append((done, 0 if split else len(rows), pick, radius, scale))
        parent.append(above)
        if not split:
            order.append(rows)
            done += len(rows)
    taken = np.concatenate(order)
    lo, size = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes], np.int64)
    after = np.arange(1, len(nodes) + 1)
    for i in range(len(nodes) - 1, 0, -1):
        size[parent[i]] += size[i]
        after[parent[i]] = max(after[parent[i]], after[i])
    new = np.empty(len(points), np.int64)
    new[taken] = np.arange(len(points))
    return Tree(points[taken], taken, lo, lo + size, after, new[[n[2] for n in nodes]], np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes]))


class Best:
    """The k best of each query: scores descending, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), NO_ID)
        self.floor = floor  # a k-th score that is known to be reached

    def reached(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def worst(self, lo: int, hi: int) -> float:
        return float(np.maximum(self.score[lo:hi, -1], self.floor[lo:hi]).min())

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = (score >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]).any(axis=1)
        if not some.any():
            return
        rows, score = rows[some], score[some]
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # keep what reaches the k-th score of these; ties stay
            reach = np.partition(score, -k, axis=1)[:, -k]
            columns = np.nonzero((score >= reach[:, None]).any(axis=0))[0]
            columns = columns[np.argsort(ids[columns], kind="stable")]
            score, ids = score[:, columns], ids[columns]
        both = np.hstack([self.score[rows], score])
        names = np.hstack([self.id[rows], np.broadcast_to(ids, score.shape)])
        order = np.lexsort((names, -both), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def dual_search(q: Tree, query_ids: np.ndarray, p: Tree, ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The k best points of p for each point of q, in their trees' order of points; a point of the query's own id is not one."""
    best = Best(len(q.points), k, floor)

    def bounds(i: list[int], j: list[int]) -> np.ndarray:
        b = (q.centres[i] * p.centres[j]).sum(axis=1) + q.norm[i] * p.radius[j] + p.norm[j] * q.radius[i] + q.radius[i] * p.radius[j]
        return b + 1e-9 * np.abs(b) + 1e-6

    def compare(i: int, j: int) -> None:
        rows = np.arange(q.lo[i], q.hi[i])
        wide = max(1, BLOCK // len(rows))
        for lo in range(int(p.lo[j]), int(p.hi[j]), wide):
            hi = min(lo + wide, int(p.hi[j]))
            score = q.points[rows] @ p.points[lo:hi].T
            score[query_ids[rows][:, None] == ids[lo:hi][None, :]] = -np.inf
            best.add(rows, score, ids[lo:hi])

    todo = [(np.inf, 0, 0)]
    while todo:
        most, i, j = todo.pop()
        if most < best.worst(q.lo[i], q.hi[i]):
            continue
        a, b = q.children(i), p.children(j)
        if not a and not b:
            compare(i, j)
            continue
        pairs = [(x, j) for x in a] if a and (not b or q.radius[i] > p.radius[j]) else [(i, y) for y in b]
        over = bounds([x for x, _ in pairs], [y for _, y in pairs])
        todo += [(float(over[t]), *pairs[t]) for t in np.argsort(over, kind="stable")]  # the highest is next
    return best


def whole_units(vector: Column, unit: int = 256) -> Column:
    """floor(unit * x) of each component, as doubles that hold whole numbers; null for vectors null or with components null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * unit).cast("double")))


def pivots_of(sample: list[tuple[int, list[float]]], most: int) -> dict[int, np.ndarray]:
    """By length of vector, picks of the sample, farthest first."""
    by: dict[int, list] = {}
    for n, v in sample:
        by.setdefault(n, []).append(v)
    out = {}
    for n, rows in by.items():
        points = np.array(rows, float).reshape(len(rows), n)
        first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        out[n] = points[farthest_first(points, first, most)[0]]
    return out


def ball_of(vector: Column, pivots: dict[int, np.ndarray]) -> Column:
    """The number of the nearest pivot of the vector's length; 0 where there is none."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out, lengths = np.zeros(len(vectors), np.int32), vectors.map(len).to_numpy()
        for n in np.unique(lengths):
            if n in pivots and n:
                at = np.nonzero(lengths == n)[0]
                x = np.stack(vectors.to_numpy()[at])
                out[at] = ((pivots[n] ** 2).sum(axis=1) - 2 * x @ pivots[n].T).argmin(axis=1)
        return pd.Series(out)

    return nearest(vector)


def _save(tree: Tree, ids: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, **{f: getattr(tree, f) for f in Tree.__dataclass_fields__})
    return out.getvalue()


def _load(system, path: str) -> tuple[Tree, np.ndarray]:
    with system.open_input_file(path) as f:
        data = np.load(io.BytesIO(f.readall()))
    return Tree(*(data[f] for f in Tree.__dataclass_fields__)), data["ids"]


def fragments(rows: DataFrame, folder: str) -> DataFrame:
    """Trees of rows (asks, n, ball, piece, id, vector), stored in folder: asks, n, name, size, centre, radius, norm of each fragment."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        asks, n = bool(group["asks"].iloc[0]), int(group["n"].iloc[0])
        tree = cover_tree(np.array(group["vector"].tolist(), float).reshape(len(group), n))
        ids = group["id"].to_numpy(np.int64)[tree.rows]
        name = f"{'q' if asks else 'p'}-{uuid.uuid4().hex}.npz"
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{name}") as f:
            f.write(_save(tree, ids))
        return pd.DataFrame({"asks": [asks], "n": [n], "name": [name], "size": [len(group)], "centre": [tree.centres[0]], "radius": [tree.radius[0]], "norm": [tree.norm[0]]})

    return rows.groupBy("asks", "n", "ball", "piece").applyInPandas(build, "asks boolean, n int, name string, size long, centre array<double>, radius double, norm double")


def fragment_pairs(known: DataFrame) -> DataFrame:
    """q, p, bound: of each query fragment and each candidate fragment of its length; the stated queries against all rows, in blocks."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = known.where("asks").select("n", F.col("name").alias("q"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("norm").alias("qn"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"))
    right = known.where("NOT asks").select("n", F.col("name").alias("p"), F.col("centre").alias("pc"), F.col("radius").alias("pr"), F.col("norm").alias("pn"), F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("salt"))
    dot = F.aggregate(F.zip_with("qc", "pc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    bound = dot + F.col("qn") * F.col("pr") + F.col("pn") * F.col("qr") + F.col("qr") * F.col("pr")
    return left.join(right, ["n", "salt"]).select("q", "p", (bound + F.abs(bound) * 1e-9 + 1e-6).alias("bound"))


def search_pairs(pairs: DataFrame, folder: str, k: int) -> DataFrame:
    """q, p, worst, floors, found of pairs (q, p, floors: known k-th scores of q's points or null), each from its two stored trees."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(folder)
        held: tuple = (None, None)
        for frame in frames:
            for name, other, floors in zip(frame["q"], frame["p"], frame["floors"]):
                if other != held[0]:
                    held = (other, _load(system, f"{base}/{other}"))
                (q, own), (p, ids) = _load(system, f"{base}/{name}"), held[1]
                floor = np.full(len(own), -np.inf) if floors is None else np.asarray(floors, float)
                best = dual_search(q, own, p, ids, k, floor)
                at = np.nonzero(best.score > -np.inf)
                found = [{"row": int(i), "query_id": int(own[i]), "id": None if x == NO_ID else int(x), "score": int(s)} for i, x, s in zip(at[0], best.id[at], best.score[at])]
                reached = best.reached()
                yield pd.DataFrame({"q": [name], "p": [other], "worst": [reached.min()], "floors": [reached], "found": [found]})

    many = pairs.count()
    parts = min(max(1, many), max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // 64))
    near = pairs.repartition(parts, "p").sortWithinPartitions("p").select("q", "p", "floors")
    return near.mapInPandas(run, "q string, p string, worst double, floors array<double>, found array<struct<row: long, query_id: long, id: long, score: long>>")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, ball: int = BALL, most: int = FRAGMENT, most_queries: int = QUERY_FRAGMENT) -> DataFrame:
    """Of rows (id long, vector array<double>): query_id, rank, id, score of the k candidates of highest inner product.

    Ties go to the smaller id, a null id last; candidates of the query's id are left out; fewer than k candidates give
    fewer rows. Rows with a null vector take no part, nor do queries with a null id. Every other row does: candidates of
    one id are each found, and each query row of one id has its own answer. A query meets candidates of its own length
    only; empty vectors score zero; empty tables give none. Other columns play no part. Scores are exact for whole
    components while sums stay below 2**53; ids are below 2**63 - 1.
    """
    spark = queries.sparkSession
    folder = scratch(spark, "trees")
    small_batches(spark, 4096)
    sides = [(True, queries.where(F.col("id").isNotNull())), (False, candidates)]
    asked, told = (d.where(F.col("vector").isNotNull()).select(F.lit(s).alias("asks"), F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "vector", F.size("vector").alias("n")) for s, d in sides)
    both = asked.unionByName(told)
    sample = [(r["n"], r["vector"]) for r in told.orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).collect()]
    pivots = pivots_of(sample, max(1, min(MOST_BALLS, told.count() // ball)))
    dealt = both.withColumn("ball", ball_of(F.col("vector"), pivots))
    counts = dealt.groupBy("asks", "n", "ball").agg(F.count("*").alias("m")).checkpoint()
    counts = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    pieces = F.ceil(F.col("m") / F.when(F.col("asks"), most_queries).otherwise(most))
    rows = dealt.withColumn("at", F.monotonically_increasing_id()).join(counts, ["asks", "n", "ball"]).withColumn("piece", F.pmod(F.xxhash64("at", "id"), pieces).cast("int"))
    known = stored(fragments(rows.select("asks", "n", "ball", "piece", "id", "vector"), folder), "fragments")
    pairs = fragment_pairs(known)
    first = pairs.groupBy("q").agg(F.max(F.struct("bound", "p")).alias("b")).select("q", F.col("b.p").alias("p"), F.lit(None).cast("array<double>").alias("floors")).checkpoint()
    began = stored(search_pairs(first, folder, k), "first")
    left = pairs.join(began.select("q", "worst", "floors", F.col("p").alias("_p")), "q").where((F.col("bound") >= F.col("worst")) & (F.col("p") != F.col("_p")))
    ended = stored(search_pairs(left.select("q", "p", "floors").checkpoint(), folder, k), "rest")
    found = began.select("q", F.inline("found")).unionByName(ended.select("q", F.inline("found")))
    order = Window.partitionBy("q", "row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
