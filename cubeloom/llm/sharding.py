"""Shards of near-equal bytes by a k-d tree over metadata.

The root holds all rows and all shards. A node of m shards is cut along the dimension in which its rows spread widest, at
the weighted quantile that gives half of its shards (rounded up) their share of its bytes, until a leaf is one shard, which
then has the target bytes. All nodes of a level are cut in common passes: bytes are summed in bins of the nodes' ranges, the
bin that holds the wanted weight is found by a running sum over a node's bins, and its range is the next pass's. What reaches
the driver is a row for each node; after each level the slim rows are stored with their node.

Along a dimension rows are ordered by the coordinate, then by their text's hash, then by their id's, then by place. So equal
texts stand together wherever the dimensions say the same of them, and share a shard, unless a boundary of their group is
further than a WHOLE-th of a shard from the wanted weight: then the group is cut by ids. Long documents are never cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, placed, quoted, row_id, ship, stored

#: Bytes that a row takes beside its text; bins of a node in a pass; bits of a coordinate and of a text's hash in a key.
ROW_BYTES, BINS, COORDINATE, HASH = 16, 16_384, 22, 40
#: A cut this part of a shard from the wanted weight is near enough; a group of equal texts is cut where it would miss by more than the second.
NEAR, WHOLE = 1 / 1000, 1 / 64
#: Rows of the table of slots' beginnings that are broadcast at most.
MOST_BROADCAST = 200_000


@dataclass
class Node:
    """A node of the tree: its shards from first on, and once it is cut: the dimension, the last key triple of its left side, and the sides."""

    first: int
    shards: int
    dim: int = -1
    cut: list[int] = field(default_factory=list)
    sides: list[Node] = field(default_factory=list)


def text_dimensions(text: Column) -> list[Column]:
    """Metadata that the text alone says: its bytes (logarithm), bytes to a character, blanks and line ends to a byte."""
    size = F.octet_length(text).cast("double")
    rest = lambda mark: size - F.octet_length(F.replace(text, F.lit(mark)))
    return [F.log2(size + 1), size / F.greatest(F.char_length(text), F.lit(1)), rest(" ") / (size + 1), rest("\n") / (size + 1)]


def _number(dim: Column, kind: str) -> Column:
    """A dimension as a double that keeps its order, of strings by their first six bytes; null and not-a-number first."""
    if kind in ("string", "binary"):
        x = F.conv(F.rpad(F.hex(F.substring(dim.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        x = F.unix_micros(dim.cast("timestamp")).cast("double")
    else:
        x = dim.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def keyed(docs: DataFrame, text_col: str, id_col: str, dims: Sequence[Column] | None, keep: dict[str, Column]) -> tuple[DataFrame, int]:
    """A stored slim table of all rows: keep's columns, size, text_crc32, part (of the scan), seq, the keys x0, x1, ... of the dimensions, y (of the id); and the number of dimensions."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    dims = text_dimensions(text) if dims is None else list(dims)
    kinds = [t for _, t in docs.select(*(d.alias(f"d{k}") for k, d in enumerate(dims))).dtypes]
    slim = docs.select(
        *(c.alias(n) for n, c in keep.items()), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("seq"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - HASH).alias("same"), F.shiftrightunsigned(F.xxhash64(quoted(id_col).cast("string")), 1).alias("y"), *(_number(d, t).alias(f"x{k}") for k, (d, t) in enumerate(zip(dims, kinds))),
    )
    slim = stored(slim, "metadata")
    ends = slim.agg(*(f(f"x{k}") for k in range(len(dims)) for f in (F.min, F.max))).first() if dims else []

    def key(k: int) -> Column:
        low, high = ends[2 * k], ends[2 * k + 1]
        c = F.lit(0) if low is None or high <= low else F.coalesce(F.floor((F.col(f"x{k}") / 2 - low / 2) / (high / 2 - low / 2) * (2**COORDINATE - 1)), F.lit(0))
        return F.shiftleft(c.cast("long"), HASH) + F.col("same")

    keys = [key(k) for k in range(len(dims))] or [F.col("same")]
    part = F.shiftright("seq", 33).alias("part")
    return slim.select(*keep, "size", "text_crc32", part, "seq", "y", *(k.alias(f"x{i}") for i, k in enumerate(keys))), len(keys)


def _left(node: Node) -> Column:
    """Whether a row's key triple is at most the node's cut."""
    order = [f"x{node.dim}", "y", "seq"]
    last = F.lit(True)
    for name, value in reversed(list(zip(order, node.cut))):
        last = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & last)
    return last


@dataclass
class Range:
    """Where a node's cut is looked for: from low to high in the key of number k, behind keys that are fixed, with so many bytes before."""

    node: Node
    want: float
    low: int
    high: int
    fixed: list[int] = field(default_factory=list)
    below: int = 0


def _pass(rows: DataFrame, ranges: list[Range], slack: tuple[float, float]) -> list[Range]:
    """One pass over rows (with leaf: the first shard of the node): ranges that found no cut, narrowed; cuts are set on the nodes."""
    each = F.lit(None).cast("struct<key:long,bin:long>")
    for r in ranges:
        order = [f"x{r.node.dim}", "y", "seq"]
        key, width = F.col(order[len(r.fixed)]), -(-(r.high - r.low + 1) // BINS)
        inside = key.between(r.low, r.high) & (F.col("leaf") == r.node.first)
        for name, value in zip(order, r.fixed):
            inside &= F.col(name) == F.lit(value)
        each = F.when(inside, F.struct(key.alias("key"), F.floor((key - r.low) / width).alias("bin"))).otherwise(each)
    bins = rows.select("leaf", "size", each.alias("e")).where("e IS NOT NULL").groupBy("leaf", "e.bin").agg(F.sum("size").alias("w"), F.min("e.key").alias("a"), F.max("e.key").alias("b"), F.count("*").alias("n"))
    wants = F.create_map(*(x for r in ranges for x in (F.lit(r.node.first), F.lit(float(r.want - r.below)))))
    before = F.sum("w").over(Window.partitionBy("leaf").orderBy("bin")) - F.col("w")
    last = F.lead("bin").over(Window.partitionBy("leaf").orderBy("bin")).isNull()
    held = bins.withColumns({"before": before, "last": last, "want": F.element_at(wants, F.col("leaf"))}).where("(before < want OR before = 0) AND (before + w >= want OR last)")
    by = {}
    for f in held.collect():
        if f["leaf"] not in by or f["before"] < by[f["leaf"]]["before"]:
            by[f["leaf"]] = f
    left = []
    for r in ranges:
        f = by[r.node.first]
        less, more = r.want - r.below - f["before"], f["before"] + f["w"] - (r.want - r.below)
        single, k = f["a"] == f["b"], len(r.fixed)
        if min(abs(less), abs(more)) <= slack[0] or single and (min(abs(less), abs(more)) <= slack[1] or k == 2 or f["n"] == 1):
            last = f["b"] if abs(more) <= abs(less) else f["a"] - 1
            r.node.cut = [*r.fixed, last]
        elif single:
            left.append(Range(r.node, r.want, 0, 2**63 - 1, [*r.fixed, f["a"]], r.below + f["before"]))
        else:
            left.append(Range(r.node, r.want, f["a"], f["b"], r.fixed, r.below + f["before"]))
    return left


def grow(rows: DataFrame, dims: int, shards: int | None = None, target_bytes: int | None = None) -> tuple[Node, DataFrame]:
    """The tree over rows of keyed(), of so many shards, or of as many as make leaves of the target bytes; the rows, stored, with the shard in the column leaf."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, round(total / target_bytes))
    root = Node(0, shards)
    slack = (NEAR * total / shards, WHOLE * total / shards)
    level, rows = [root], stored(rows.withColumn("leaf", F.lit(0)), "leaves")
    while level := [n for n in level if n.shards > 1]:
        ends = [f(f"x{k}") for k in range(dims) for f in (F.min, F.max)]
        seen = {r["leaf"]: r for r in rows.groupBy("leaf").agg(F.sum("size").alias("w"), *ends).collect()}
        level, ranges = [n for n in level if n.first in seen], []
        for n in level:
            r = seen[n.first]
            span = [(r[2 + 2 * k], r[3 + 2 * k]) for k in range(dims)]
            n.dim = max(range(dims), key=lambda k: ((span[k][1] >> HASH) - (span[k][0] >> HASH), -k))
            more = (n.shards + 1) // 2
            ranges.append(Range(n, r["w"] * more / n.shards, *span[n.dim]))
        while ranges:
            ranges = _pass(rows, ranges, slack)
        leaf = F.col("leaf")
        for n in level:
            more = (n.shards + 1) // 2
            n.sides = [Node(n.first, more), Node(n.first + more, n.shards - more)]
            leaf = F.when((F.col("leaf") == n.first) & ~_left(n), n.first + more).otherwise(leaf)
        rows = stored(rows.withColumn("leaf", leaf), "leaves")
        level = [s for n in level for s in n.sides]
    return root, rows


def numbered(rows: DataFrame, shard: Column) -> DataFrame:
    """rows (part, seq) with shard and slot, the place in the shard from 0 on without gaps: what earlier parts of the scan have of a shard, and the place in the part."""
    dealt = rows.withColumn("shard", shard.cast("int"))
    counts = dealt.groupBy("part", "shard").agg(F.count("*").alias("m"))
    begun = counts.select("part", "shard", (F.sum("m").over(Window.partitionBy("shard").orderBy("part")) - F.col("m")).alias("begins")).checkpoint()
    begun = F.broadcast(begun) if begun.count() <= MOST_BROADCAST else begun
    at = F.row_number().over(Window.partitionBy("part", "shard").orderBy("seq")) - 1
    return dealt.withColumn("at", at).join(begun, ["part", "shard"]).withColumn("slot", (F.col("begins") + F.col("at")).cast("long")).drop("at", "begins")


def assigned(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, text_col: str = "text", id_col: str = "doc_id", dims: Sequence[Column] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """A slim row for each row of docs: keep's columns (the id), size, text_crc32, shard, slot.

    dims are the metadata columns to cut along: numbers, dates, strings; those of the text itself where none are given.
    Sizes of shards differ from the target by about a hundredth of it, or by a document that is larger than that. Null
    texts are empty, null dimensions stand first; null and repeated ids and repeated rows each have a slot; with fewer
    documents than shards some shards are empty; an empty table gives none.
    """
    ship(docs.sparkSession)
    keep = {"id": quoted(id_col)} if keep is None else keep
    rows, n = keyed(docs, text_col, id_col, dims, keep)
    _, leaves = grow(rows, n, shards, target_bytes)
    found = numbered(leaves, F.col("leaf"))
    return found.select(*keep, "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, text_col: str = "text", id_col: str = "doc_id", dims: Sequence[Column] | None = None) -> DataFrame:
    """docs with shard and slot (see assigned); all columns pass, of any name, and the new ones get underlines where docs has their names."""
    docs = placed(docs)
    file, row, shard, slot = fresh(docs.columns, "_file", "_row", "shard", "slot")
    marked = row_id(docs, file, row)
    found = assigned(marked, shards, target_bytes, text_col, id_col, dims, {"f": quoted(file), "r": quoted(row)})
    found = found.select(F.col("f").alias(file), F.col("r").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    return row_id(docs, file, row).join(found, [file, row]).select(*map(quoted, docs.columns), shard, slot)


def write(docs: DataFrame, path: str, rows_of_file: int = 1_000_000, **how) -> DataFrame:
    """Write sharded(docs, **how) as Parquet in a folder for each shard, in files of bounded runs of slots; returns what was written. An empty table leaves an empty one."""
    found = sharded(docs, **how)
    shard, slot = found.columns[-2:]
    run = F.floor(F.col(slot) / rows_of_file)
    files = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found.repartition(files, F.col(shard), run).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)
