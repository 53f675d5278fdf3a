import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cubeloom.llm import simhash
from cubeloom.llm.common import components

SCHEMA = "doc_id long, text string, fp string, lang string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_fingerprints_equal_brute_force():
    for text in (None, "", " \t", "A", "a b", "a b c", "Ä b c d  e\nf", "x " * 5000, "Ä É word " * 30 + "end"):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute(text), text


def spread(fps, bits=2):
    """Components by brute force: {fp: least fp}."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_links_find_every_component(spark):
    rng = random.Random(3)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    fps = set()
    for size in (1, 2, 3, 8, 150):  # the last fills posting lists beyond PAIR_LIST
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(size):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            if size < 10:
                base ^= 3 << rng.randrange(63)  # a chain
                fps.add(base)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = {signed(f) for f in fps}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert simhash.index(df).groupBy("mask", "key").count().agg(F.max("count")).first()[0] > simhash.PAIR_LIST
    want = spread(fps)
    for start, longest in ((simhash.START, simhash.PAIR_LIST), (2, 4), (6, 3)):  # short lists are split down to half bytes
        got = dict(components(simhash.links(df, start=start, longest=longest)).collect())
        assert {f: got.get(f, f) for f in fps} == want, (start, longest)


def test_tally_equals_the_bytes_that_agree(spark):
    rng = random.Random(4)
    base, fps = rng.getrandbits(64), {1, 2, 3}
    for _ in range(120):
        x = base
        for i in rng.sample(range(8), rng.randrange(5)):
            x ^= rng.randrange(1, 256) << 8 * i
        fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    same = lambda a, b: sum((a >> 8 * i & 255) == (b >> 8 * i & 255) for i in range(8))
    got = {(r["u"], r["v"]): r["shared"] for r in simhash.candidates(df, longest=len(fps)).collect()}  # no list is split
    assert all(n == same(u, v) for (u, v), n in got.items() if same(u, v) >= 6)
    assert {(u, v) for (u, v), n in got.items() if n >= 6} == {(u, v) for i, u in enumerate(fps) for v in fps[i + 1 :] if same(u, v) >= 6}
    assert any(n < 6 for n in got.values()) and all(n <= same(u, v) for (u, v), n in got.items())  # the count filter has work to do
    loose = simhash.links(df, least=1, bits=64)
    assert loose.count() > simhash.links(df, bits=64).count() > simhash.links(df).count()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (5, 6), (6, 5)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, long, "x", None), (3, long, None, "en"), (None, long, None, None), (9, None, None, None), (8, "", None, None), (7, "one", None, None), (7, "one", None, None), (1, "quite another text here", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).drop("fp")
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([(5, 3), (3, 3), (-1, 3), (9, 8), (8, 8), (7, 7), (7, 7), (1, 1)])
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "lang"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7, 8]
    clash = df.selectExpr("*", "1 as root", "2 as _file", "3 as ROW_", "4 as _n", "5 as _least", "6 as component_id")
    assert sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.near_duplicates(clash).collect()) == got
    assert sorted((r["doc_id"], r["root"], r["_file"], r["component_id"]) for r in simhash.keep_one(clash).collect()) == [(i, 1, 2, 6) for i in (1, 3, 7, 8)]
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none.drop("fp")).count() == 0 and simhash.keep_one(none).count() == 0


def test_majority_is_strict():
    assert simhash.majority(np.array([1, 2], np.uint64)) == 0
    assert simhash.majority(np.array([3, 3, 4], np.uint64)) == 3


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 2), (2, "a b c d", None, 3)]).toDF("doc_id", "text", "od`d", "a.b")
    assert [r["od`d"] for r in simhash.keep_one(df).collect()] == ["x"] and simhash.near_duplicates(df).count() == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).columns == df.columns
