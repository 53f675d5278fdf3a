import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cubeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], SCHEMA)


def targets(size, weights=(5, 2, 1), most=3):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(size.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(most * size[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        above = {s for s in free if level * w[s] > most * size[s]}
        if not above:
            return {s: most * size[s] if s in capped else level * w[s] for s in names}
        capped |= above


def test_targets_and_words(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * min(3000, int(rng.pareto(1.2) * 20 + 1))), ["a", "b", "Z", None, "é"][int(rng.integers(0, 5)) if i % 3 else 0]) for i in range(9000)]
    got = mixing.copies(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        size[s] += len(t.split())
    want = targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s]
    again = {r["doc_id"]: r["taken"] for r in mixing.copies(docs(spark, rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_pivotal_keeps_words_and_expectations():
    size = np.array([9.0, 5, 4, 4, 2, 1])
    share = np.full(6, 0.4)
    rng = np.random.default_rng(0)
    sums = np.zeros(6)
    for _ in range(4000):
        out, at = mixing.pivotal(size, share, rng.random(6))
        assert abs((out * size).sum() - (share * size).sum()) < 1e-9
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != at)
        sums += out
    assert np.abs(sums / 4000 - 0.4).max() < 0.03


def test_every_document_keeps_its_expectation():
    rng = np.random.default_rng(2)
    size = np.sort(np.minimum(20_000, np.exp(rng.normal(5, 1.5, 600))).astype(int) + 1.0)[::-1]
    lumps = np.array([50_000.0, 40_000] + [1] * 400)
    for size, share in ((size, 0.05), (size, 0.9), (size, 0.97), (lumps, 0.9)):
        n, sums, furthest = 800, np.zeros(len(size)), 0.0
        for _ in range(n):
            out, at = mixing.pivotal(size, np.full(len(size), share), rng.random(len(size)))
            if at >= 0:
                out[at] = float(rng.random() < out[at])
            sums += out
            furthest = max(furthest, abs((out - share) @ size))
        assert np.abs(sums / n - share).max() < 4.5 * np.sqrt(share * (1 - share) / n)
        assert furthest <= size[0]


def test_last_residual_has_a_draw_of_its_own():
    keys = np.arange(50_000)
    a, b = mixing._draw(7, 0, keys), mixing._draw(7, mixing.LAST_ROUND, keys)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and abs(b.mean() - 0.5) < 0.01


def test_tree_of_chunks_keeps_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "a" if i % 3 else "b") for i in range(900)]
    size, taken, most = defaultdict(int), defaultdict(int), 59
    target = {}
    for r in mixing.copies(docs(spark, rows)).collect():
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in {r["size"] * k for k in range(4)}
    assert all(abs(taken[s] - target[s]) <= most for s in size)


def test_equal_rows_are_dealt_to_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = docs(spark, [(None, "same words here", "a")] * 3000 + [(1, "b", "b")])
    base = mixing.stored(rows.selectExpr("doc_id", "source", "3L as size", "9L as source_size", "1d as target", "0L as whole", "0.5d as share", "3001L as n", "xxhash64(doc_id, text) as _key"), "t")
    chunks = [r["n"] for r in mixing.dealt(mixing.row_id(base)).groupBy("source", "chunk").agg(F.count("*").alias("n")).collect()]
    assert max(chunks) < 150
    got = mixing.copies(rows).collect()
    assert len(got) == 3001 and sum(r["taken"] for r in got if r["source"] == "a") % 3 == 0


def test_ranks_without_one_window(spark):
    names = [f"s{i:04d}" for i in range(500)] + [None]
    got = mixing._ranked(spark.createDataFrame([(n,) for n in names[::-1]], "source string"), [F.col("source").isNull(), F.col("source")], "r").collect()
    assert {r["source"]: r["r"] for r in got} == {n: i for i, n in enumerate(names)}


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "\x1fx", None), (None, "one two", "b"), (4, "one two", "b"), (4, "one two", "b"), (5, "w " * 30_000, "c")]
    got = mixing.copies(docs(spark, rows)).collect()
    assert len(got) == 7
    assert {r["doc_id"]: r["size"] for r in got} == {1: 0, 2: 0, 3: 1, None: 2, 4: 2, 5: 30_000}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert len(re.findall(mixing.WORD, "\x1fx y z")) == 2
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size", "copies"] and all(r["text"] for r in mixed.collect())
    clash = docs(spark, rows).selectExpr("*", "1 as _file", "2 as _ROW", "3 as _many", "4 as _copy", "5 as share")
    assert sorted(map(str, mixing.mix(clash).select("doc_id", "_file", "_ROW", "_many", "_copy").collect())) == sorted(str(r) for r in mixing.mix(docs(spark, rows)).selectExpr("doc_id", "1 as _file", "2 as _ROW", "3 as _many", "4 as _copy").collect())
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0
    assert all(r["taken"] == 0 for r in mixing.copies(docs(spark, [(1, None, None), (2, " ", "a")])).collect())
