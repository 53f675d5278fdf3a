"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the same real number of copies, target / source size. Its whole part is certain; the
fraction is rounded by the pivotal method: two fractional documents meet, mass moves from one to the other, in words,
until one of them is integral, the direction drawn so that expectations stand. The words of a source are thus kept
exactly in each meeting. A source's documents are dealt to bounded chunks which run apart, largest document first, so
that what is left over is a small document where there are enough of these; the one residual of each chunk goes up a
reduction tree. Only the last residual of a source is rounded by a draw of its own: a source's words stray by less than
one document, and the expectation of every document is its share.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, placed, quoted, row_id, shared_dir, stored

WORD = r"[^\x20\x09-\x0D]+"
CHUNK, FAN_IN, MOST_BROADCAST = 4096, 64, 10_000
#: The rounds of draws that the last residuals have for themselves.
LAST_ROUND = 1 << 20


def _ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place, from 0, in an order: sorted by ranges, counted by part, no window over all."""
    at = F.monotonically_increasing_id()  # the part in the upper bits, the place in it in the lower 33
    held = rows.orderBy(*order).withColumn("_at", at).checkpoint()
    part = F.shiftright("_at", 33)
    counts = dict(held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row for each part of a sort
    ahead, sums = 0, {}
    for p in sorted(counts):
        sums[p], ahead = ahead, ahead + counts[p]
    first = F.create_map(*(F.lit(x) for p, n in sums.items() for x in (p, n))) if sums else F.create_map().cast("map<bigint,int>")
    return held.withColumn(name, F.element_at(first, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """From rows (source, size): each source's source_size, n, target and copies (target / source_size).

    Sources in order of code points, null last, weigh `weights`, repeating, and share all words; a target stops at
    `most` times its source and the excess is shared again by weight until none is above.
    """
    shared_dir(sizes.sparkSession)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = _ranked(by, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    by = rank.select("source", "source_size", "n", weight.alias("weight")).checkpoint()
    free, level = F.lit(True), 0.0
    while True:
        sums = by.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
            F.sum(F.when(~free, F.col("source_size") * most)).alias("held"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.count(F.when(free, 1)).alias("n"),
        ).first()
        if not sums["n"]:
            break
        level = (sums["words"] - (sums["held"] or 0.0)) / sums["weight"]
        still = free & (F.lit(level) * F.col("weight") <= F.col("source_size") * most)
        if by.where(free & ~still).isEmpty():
            break
        free = F.lit(level) * F.col("weight") <= F.col("source_size") * most  # levels only rise, so what was above stays above
    target = F.when(free, F.lit(level) * F.col("weight")).otherwise(F.col("source_size") * most).cast("double")
    return by.select("source", "source_size", "n", target.alias("target"), F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("copies")).checkpoint()


def pivotal(size: np.ndarray, share: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round shares in (0, 1) in the given order; the rounded shares, and the place of the one left fractional or -1.

    A meeting moves d words: the first gains d / its size and the second loses d / its size, or the reverse.
    """
    share = share.copy()
    at = -1
    for i in range(len(size)):
        if not 0 < share[i] < 1:
            continue
        if at < 0:
            at = i
            continue
        wa, wb, pa, pb = size[at], size[i], share[at], share[i]
        up, down = min((1 - pa) * wa, pb * wb), min(pa * wa, (1 - pb) * wb)
        if draws[i] * (up + down) < down:
            a_ends, b_ends = (1 - pa) * wa <= pb * wb, pb * wb <= (1 - pa) * wa
            share[at], share[i] = (1.0 if a_ends else pa + up / wa), (0.0 if b_ends else pb - up / wb)
        else:
            a_ends, b_ends = pa * wa <= (1 - pb) * wb, (1 - pb) * wb <= pa * wa
            share[at], share[i] = (0.0 if a_ends else pa - down / wa), (1.0 if b_ends else pb + down / wb)
        left = [x for x in (at, i) if 1e-12 < share[x] < 1 - 1e-12]
        for x in (at, i):
            if x not in left:
                share[x] = round(share[x])
        at = left[0] if left else -1
    return share, at


def _draw(seed: int, level: int, keys: np.ndarray) -> np.ndarray:
    """Uniform numbers that depend on seed, level and key only, so that reruns agree."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + level + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """_file, _row, doc_id, source, size, source_size, target, taken and copies for each row of docs.

    A document's size is its number of words; a null or empty text has none and takes none. A null source is a source of
    its own, the last. Repeated rows are separate documents; equal rows (id and text) of more than a chunk are dealt by
    their places in the files, all others by content alone, so that reruns over other files agree. taken is a whole
    number of copies times the size, at most `most` rounded up. Other columns play no part. An empty table gives none.
    """
    slim = placed(docs.select("doc_id", "text", "source"))
    key = F.xxhash64("doc_id", "text")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    base = stored(row_id(slim).select("doc_id", "source", size.alias("size"), key.alias("_key"), "_file", "_row"), "sizes")
    targets = source_targets(base, weights, most).withColumnRenamed("source", "_source")
    sums = targets.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    small = F.broadcast(targets) if sums["n"] <= MOST_BROADCAST else targets
    rows = base.join(small, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.floor(F.col("copies") + 1e-12)
    rows = rows.select("*", whole.cast("long").alias("whole"), F.greatest(F.col("copies") - whole, F.lit(0.0)).alias("share"))
    rows = rows.withColumn("share", F.when((F.col("share") < 1e-12) | (F.col("size") == 0), 0.0).otherwise(F.col("share")))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "whole", "share", "n", "_key", "_file", "_row")
    is_open = (F.col("share") > 0) & (F.col("share") < 1)
    done = [rows.where(~is_open).drop("n")]
    now = dealt(rows.where(is_open))
    level, groups = 0, math.ceil((sums["most"] or 0) / CHUNK)
    while True:
        last = groups <= 1
        met = _meet(now, seed, level, last)
        if last:
            done.append(met.drop("chunk"))
            break
        met = stored(met, f"level{level}")
        done.append(met.where(~is_open).drop("chunk"))
        now = met.where(is_open).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        level, groups = level + 1, math.ceil(groups / FAN_IN)
    taken = F.col("whole") + F.round("share").cast("long")
    made = reduce(DataFrame.unionByName, done)
    return made.select("_file", "_row", "doc_id", "source", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows (n: those of the source) with their chunk, of CHUNK rows on average."""
    chunks = F.ceil(F.col("n") / CHUNK)
    many = rows.groupBy("_key").agg(F.count("*").alias("_same")).where(F.col("_same") > CHUNK).checkpoint()
    if many.isEmpty():
        placing = F.xxhash64("_key")
    else:  # a chunk holds more than CHUNK rows of each, so there are few
        rows = rows.join(many if many.count() > MOST_BROADCAST else F.broadcast(many), "_key", "left")
        placing = F.when(F.col("_same").isNull(), F.xxhash64("_key")).otherwise(F.xxhash64("_key", "_file", "_row"))
    return rows.withColumn("chunk", F.pmod(placing, chunks).cast("long")).select("doc_id", "source", "size", "source_size", "target", "whole", "share", "_key", "_file", "_row", "chunk")


def _meet(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "_key", "_file", "_row"], ascending=[False, True, True, True], kind="stable")
        keys = rows["_key"].to_numpy(np.int64) + rows.groupby("_key").cumcount().to_numpy(np.int64)
        share, at = pivotal(rows["size"].to_numpy(float), rows["share"].to_numpy(float), _draw(seed, level, keys))
        if last and at >= 0:
            share[at] = float(_draw(seed, LAST_ROUND, keys[at : at + 1])[0] < share[at])
        return rows.assign(share=share)

    return rows.groupBy("source", "chunk").applyInPandas(run, rows.schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, rows of no words kept away; all columns pass, of any name."""
    docs = placed(docs)
    file, row, many, copy = fresh(docs.columns, "_file", "_row", "_many", "_copy")
    found = copies(docs, weights, most, seed).where("copies > 0").select(F.col("_file").alias(file), F.col("_row").alias(row), F.col("copies").alias(many))
    out = row_id(docs, file, row).join(found, [file, row]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int"))))
    return out.select(*map(quoted, docs.columns))
