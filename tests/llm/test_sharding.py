import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import queries, sharding
from cubeloom.llm.common import read


def check(rows, shards, total=None):
    """Rows of (size, shard, slot): slots without gaps, shards near the target or a document from it."""
    by = defaultdict(list)
    for size, shard, slot in rows:
        by[shard].append((slot, size))
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    target = sum(r[0] for r in rows) / shards
    off = max(abs(sum(s for _, s in by[k]) - target) for k in range(shards))
    assert off <= 0.04 * target + 2 * max(r[0] for r in rows)
    return off / target


def test_op13(spark):
    at = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in read(spark, at, "documents").select("doc_id", "text").collect()}
    got = queries.QUERIES["op13_sharding"](spark, at).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 16, zlib.crc32(docs[r["doc_id"]]), "bytes", None) for r in got)
    check([(r["size"], r["shard"], r["slot"]) for r in got], 40)
    again = queries.QUERIES["op13_sharding"](spark, at).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    rows = [(i, f"text {i} " + "word " * (i * 7919 % 60)) for i in range(3000)]
    rows += [(3000 + i, f"pair {i // 3} of some words") for i in range(900)]
    rows += [(4000 + i, "the same again and again " * 5) for i in range(2500)]  # more than ten shards hold
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.assigned(df, shards=24).join(df.withColumnRenamed("doc_id", "id"), "id").collect()
    assert check([(r["size"], r["shard"], r["slot"]) for r in got], 24) < 0.03
    where = defaultdict(set)
    for r in got:
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("the same"))
    most = 2500 * (125 + 16) / (sum(r["size"] for r in got) / 24)
    assert most < len(where["the same again and again " * 5]) <= most + 3


def test_dimensions_make_boxes(spark):
    rows = [(i, "x" * 10, i % 100, i // 100) for i in range(6400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int").repartition(3)
    got = sharding.sharded(df, shards=4, dims=[F.col("a"), F.col("b")]).collect()
    boxes = defaultdict(lambda: [set(), set()])
    for r in got:
        boxes[r["shard"]][0].add(r["a"])
        boxes[r["shard"]][1].add(r["b"])
    # a root cut along one dimension, then both sides along the other
    assert all(len(a) == 50 and len(b) == 32 for a, b in boxes.values()) and len(boxes) == 4


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, "a b") for i in range(n)], "doc_id long, text string")
    got = sharding.assigned(df, shards=8).collect()
    assert len(got) == n and len({r["shard"] for r in got}) == n and all(r["slot"] == 0 for r in got)


def test_edges_of_the_input(spark, tmp_path):
    rows = [(None, None, None, None)] * 40 + [(None, f"text {i % 9}", "é", float("nan")) for i in range(300)] + [(7, "same row", None, 1.0)] * 200 + [(8, "", "b", float("inf")), (9, "long " * 200_000, "c", -1.0), (10, "é" * 50, "c", 3.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, shard string, `x``0` double, _file int").repartition(5)
    for dims in (None, [F.col("shard"), F.col("`x``0`")], []):
        got = sharding.sharded(df, shards=6, dims=dims)
        assert got.columns == [*df.columns, "_shard", "slot"] and sorted(r["_file"] for r in got.collect()) == list(range(len(rows)))
        by = defaultdict(list)
        for r in got.collect():
            by[r["_shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) <= 6
    assert sharding.sharded(df.limit(0), shards=3).count() == 0
    many = sharding.assigned(df.where("doc_id IS NULL"), target_bytes=600)
    check([(r["size"], r["shard"], r["slot"]) for r in many.collect()], round(sum(len(r[1] or "") + 16 for r in rows[:340]) / 600))
    told = sharding.write(df, str(tmp_path / "out"), shards=3, rows_of_file=50)
    assert told.count() == len(rows) and sorted(told.columns) == sorted([*df.columns, "_shard", "slot"])
