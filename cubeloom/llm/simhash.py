"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. If two differ in at most two bits, at least six of their bytes agree at the same
positions: the guaranteed minimum. The index posts each distinct fingerprint under its bytes at every choice of START
positions. A list that is too long for pairs is split by each further position, up to six of them; both ways of reaching
a choice give the same list. What two members of a short list share is tallied by aggregation: the union of the positions
of all lists that hold both. A pair that agrees at m >= 6 positions stands together in a list for each of them, so its
tally is m; pairs are kept from the guaranteed minimum on and verified bit by bit. A long list of six positions, whose
members differ in two bytes at most, is split in the same way by the half bytes of these: of four, two agree in any pair
that differs in two bits. No list is cut, and no list of pairs has more than 256 members.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, components, fresh, join_hot, placed, quoted, row_id, shared_dir, small_batches

BITS, LEAST_BYTES = 2, 6
#: Positions of a first list, and the longest list whose members are paired.
START, PAIR_LIST = 3, 8
MOST_BROADCAST = 200_000


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 of all word shingles, as an unsigned integer."""
    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    hashes = np.fromiter((digest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_000):
        bits = np.unpackbits(hashes[i : i + 65_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """All columns of docs but the text, and fp: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != text_col]
    plain = [f"_c{i}" for i in range(len(kept))]  # names of any marks are set aside
    slim = docs.select(quoted(text_col).cast("binary").alias("_text"), *(quoted(f.name).alias(n) for f, n in zip(kept, plain)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, shingle) for x in batch.column(0).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], [*plain, "fp"])

    made = by_batch(slim, run, T.StructType([*(T.StructField(n, f.dataType) for f, n in zip(kept, plain)), T.StructField("fp", T.LongType())]))
    return made.select(*(F.col(n).alias(f.name) for f, n in zip(kept, plain)), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes_at(mask: int) -> int:
    """The bits of the bytes at a choice of positions, as a signed long."""
    return _signed(sum(0xFF << 8 * i for i in range(8) if mask >> i & 1))


def _choices(least: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(8), least)]


def index(fps: DataFrame, start: int = START) -> DataFrame:
    """The first posting lists: mask (the positions), key (the bytes there), fp."""
    posts = [F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(_bytes_at(m))).alias("key")) for m in _choices(start)]
    return fps.select("fp", F.inline(F.array(*posts)))


def _longer(members: DataFrame) -> DataFrame:
    """The lists of one more position that members of long lists (mask, fp) go to; a fingerprint is in one list of each choice."""
    every = F.array(*(F.lit(_bytes_at(m)) for m in range(256)))
    further = F.filter(F.array(*(F.lit(1 << i) for i in range(8))), lambda b: F.col("mask").bitwiseAND(b) == 0)
    own = members.select("fp", F.transform(further, lambda b: F.col("mask").bitwiseOR(b)).alias("masks")).groupBy("fp").agg(F.array_distinct(F.flatten(F.collect_set("masks"))).alias("masks"))
    return own.select("fp", F.explode("masks").alias("mask")).select("mask", F.col("fp").bitwiseAND(F.element_at(every, F.col("mask") + 1)).alias("key"), "fp")


def _by_halves(members: DataFrame) -> DataFrame:
    """The lists of half bytes (mask, half, key, fp) of members of long lists of six positions: two of the four half bytes left agree."""
    made = {}
    for m in _choices(LEAST_BYTES):
        halves = [8 * i + h for i in range(8) if not m >> i & 1 for h in (0, 4)]
        made[m] = [_signed((_bytes_at(m) & (1 << 64) - 1) | sum(0xF << h for h in two)) for two in combinations(halves, 2)]
    bits = F.create_map(*(x for m, v in made.items() for x in (F.lit(m), F.array(*map(F.lit, v)))))
    each = members.select("mask", "fp", F.posexplode(F.element_at(bits, F.col("mask"))).alias("half", "bits"))
    return each.select("mask", "half", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")


def _pairs(short: DataFrame, by: list[str]) -> DataFrame:
    """mask, u, v for each two members of the lists of short, whose length is bounded."""
    lists = short.groupBy(*by).agg(F.array_sort(F.collect_list("fp")).alias("l"))
    each = lists.select("mask", "l", F.posexplode("l").alias("i", "u"))
    return each.select("mask", "u", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("v"))


def candidates(fps: DataFrame, start: int = START, longest: int = PAIR_LIST) -> DataFrame:
    """u, v, shared: pairs that stand together in a list, with the number of positions of all lists that hold both."""
    shared_dir(fps.sparkSession)
    found, posted, by = [], index(fps, start), ["mask", "key"]
    for size in range(start, LEAST_BYTES + 1):
        lists = posted.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1").checkpoint()
        found.append(lists.where("n = 2").select("mask", "u", "v"))
        many = lists.where("n > 2").select(*by, "n")
        member = posted.join(F.broadcast(many) if many.count() <= MOST_BROADCAST else many, by).checkpoint()
        found.append(_pairs(member.where(F.col("n") <= longest), by))
        if lists.where(F.col("n") > longest).isEmpty():
            break
        members = member.where(F.col("n") > longest).select("mask", "fp")
        if size < LEAST_BYTES:
            posted = _longer(members).checkpoint()
        else:
            found.append(_pairs(_by_halves(members), ["mask", "half", "key"]))
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.groupBy("u", "v").agg(F.bit_count(F.bit_or("mask")).alias("shared"))


def links(fps: DataFrame, least: int = LEAST_BYTES, bits: int = BITS, start: int = START, longest: int = PAIR_LIST) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) that differ in at most two bits: candidates from the guaranteed minimum on, verified."""
    pairs = candidates(fps, start, longest).where(F.col("shared") >= least)
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).select("u", "v")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The columns of docs but the text, with fp, component_id (the smallest id reachable over links of two bits or fewer) and root.

    Null and empty texts have the fingerprint zero and link like any other. Fewer words than a shingle: the whole
    sequence is the one shingle. Null ids link but are never a component's name unless it has no other. Repeated rows
    stay, each with its component. Columns of docs named fp, component_id or root give way to these. An empty table gives none.
    """
    shared_dir(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in {"fp", "component_id", "root"} - {text_col.lower(), id_col.lower()}]
    fps = fingerprints(docs.select(*map(quoted, kept)), text_col).checkpoint()
    least, n = fresh(fps.columns, "_least", "_n")
    distinct = fps.groupBy("fp").agg(F.min(quoted(id_col)).alias(least), F.count("*").alias(n)).checkpoint()
    roots = components(links(distinct.select("fp"))).withColumnRenamed("u", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min(least).alias("component_id")), "root").select("fp", "component_id", "root", n).checkpoint()
    return join_hot(fps, named, "fp", n)


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component, the one of smallest id (then of first place in the files); all columns pass, of any name."""
    docs = placed(docs)
    file, row = fresh(docs.columns, "_file", "_row")
    marked = near_duplicates(row_id(docs.select(quoted(text_col).alias("_t"), quoted(id_col).alias("_i"))), "_t", "_i")
    order = F.struct(F.col("_i").isNull(), F.col("_i"), F.col("_file"), F.col("_row"))
    kept = marked.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k._file").alias(file), F.col("k._row").alias(row))
    return row_id(docs, file, row).join(kept, [file, row], "left_semi").select(*map(quoted, docs.columns))
