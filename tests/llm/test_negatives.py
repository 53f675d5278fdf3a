import numpy as np
import pytest

from cubeloom.llm import negatives
from cubeloom.llm.search import NO_ID


def brute(anchors, rows, positives=5, k=10, low=30, high=90):
    out = []
    for a, la, v in anchors:
        if a is None or la is None or v is None:
            continue
        found = sorted((-int(np.dot(v, w)), i is None, i or 0, l == la) for i, l, w in rows if w is not None and l is not None and len(w) == len(v) and i != a)
        for s, no, i, _ in [f for f in found if f[3]][:positives]:
            fit = [f for f in found if not f[3] and low * -s <= 100 * -f[0] <= high * -s][:k]
            out += [(a, None if no else i, r + 1, None if f[1] else f[2], -s, -f[0]) for r, f in enumerate(fit)]
    return sorted(out, key=str)


def some_rows(seed=3, n=900, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (12, d))
    v = centres[rng.integers(0, 12, n)] + rng.integers(-6, 7, (n, d))
    v[n // 2 : n // 2 + n // 3] = v[0]  # a third of all rows have one vector
    return [(int(i), int(rng.integers(0, 4)), x.astype(float).tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("sizes", [{}, {"per_list": 20, "piece": 16, "block": 3}])
def test_equals_brute_force(spark, sizes):
    rows = some_rows()
    rows += [(20, 1, rows[20][2]), (20, 1, rows[20][2]), (None, 2, rows[5][2]), (None, 1, rows[40][2]), (901, None, rows[0][2]), (902, 1, None), (903, 1, [1.0, 2.0]), (920, 1, [2.0, 2.0]), (904, 2, [1.0, 1.0]), (905, 1, []), (940, 1, []), (906, 2, [])]
    rows += [(960, 3, [0.0] * 6), (961, 3, [1.0] * 6), (962, 1, [-1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, vector array<double>, n string, copies int")
    got = negatives.mine(df.where("id % 20 = 0 OR id IS NULL OR id > 900"), df, **sizes)
    want = brute([r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] > 900], rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 300
    assert negatives.mine(df.limit(0), df).count() == 0 and negatives.mine(df, df.limit(0)).count() == 0
    few = df.where("id IN (1, 2)")
    assert sorted(map(tuple, negatives.mine(few, few).collect()), key=str) == brute(rows[1:3], rows[1:3])


class Held(negatives.Lists):
    """Lists in memory: (centre, ids, labels, x) each."""

    def __init__(self, lists):
        self.lists, self.centres = lists, np.array([c for c, *_ in lists])
        self.radius = np.array([np.sqrt(((x - c) ** 2).sum(axis=1)).max() for c, _, _, x in lists])

    def pieces(self, at):
        _, ids, labels, x = self.lists[at]
        yield {"ids": ids, "labels": labels, "x": x, "copies": np.ones(len(ids), np.int64)}


def test_bounds_skip_lists():
    rng = np.random.default_rng(4)
    centres = rng.integers(-300, 300, (40, 8))
    lists = []
    for k, c in enumerate(centres):
        x = (c + rng.integers(-3, 4, (50, 8))).astype(float)
        lists.append((c.astype(float), np.arange(50) + 50 * k, rng.integers(0, 3, 50), x))
    rows = [(int(i), int(l), v.tolist()) for _, ids, labels, x in lists for i, l, v in zip(ids, labels, x)]
    anchors = [r for r in rows if r[0] % 100 == 0]
    near, far, (first, second) = negatives.search_block(Held(lists), np.array([a[0] for a in anchors]), np.array([a[1] for a in anchors]), np.array([a[2] for a in anchors]), 5, 10, (30, 90))
    a, r = np.nonzero(far.score > -np.inf)
    got = sorted(((anchors[i // 5][0], int(near.id[i // 5, i % 5]), int(j) + 1, int(far.id[i, j]), int(near.score[i // 5, i % 5]), int(far.score[i, j])) for i, j in zip(a, r)), key=str)
    assert got == brute(anchors, rows) and NO_ID not in near.id
    assert first < 0.1 * len(anchors) * len(lists) and second < 0.5 * len(anchors) * len(lists)


class Counted(Held):
    """Lists that count how often they are read."""

    reads = 0

    def pieces(self, at):
        self.reads += 1
        return super().pieces(at)


def test_anchors_of_a_block_share_products():
    """Where bounds hold back little, a list is scored with all anchors of a round at once."""
    rng = np.random.default_rng(6)
    x = rng.integers(-30, 31, (64, 40, 16)).astype(float)
    lists = Counted([(v.mean(axis=0), np.arange(40) + 40 * k, rng.integers(0, 3, 40), v) for k, v in enumerate(x)])
    rows = [(int(i), int(l), v.tolist()) for _, ids, labels, x in lists.lists for i, l, v in zip(ids, labels, x)]
    anchors = rows[::20]
    near, far, visits = negatives.search_block(lists, *(np.array(c) for c in zip(*anchors)), 5, 10, (30, 90))
    a, r = np.nonzero(far.score > -np.inf)
    got = sorted(((anchors[i // 5][0], int(near.id[i // 5, i % 5]), int(j) + 1, int(far.id[i, j]), int(near.score[i // 5, i % 5]), int(far.score[i, j])) for i, j in zip(a, r)), key=str)
    assert got == brute(anchors, rows)
    assert min(visits) > 0.3 * len(anchors) * 64 and lists.reads <= 2 * 64 * 7


def test_long_vectors_are_exact(spark):
    """Products beyond single precision, beside those within, and copies beyond what is kept."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, (rng.integers(-9, 10, 4) * (100_000 if i % 5 == 0 else 1) + 1).astype(float).tolist()) for i in range(300)] + [(400 + i, i % 2, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = negatives.mine(df.where("id % 20 = 0"), df, per_list=40, piece=32)
    assert sorted(map(tuple, got.collect()), key=str) == brute([r for r in rows if r[0] % 20 == 0], rows)


def test_centroids():
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.1, (50, 3)) for c in (0, 10, 20)])
    assert {round(c[0], -1) for c in negatives.lloyd(x, 9)} == {0, 10, 20}
    assert len(negatives.lloyd(np.ones((9, 2)), 4)) == 1 and negatives.lloyd(np.zeros((3, 0)), 2).shape == (1, 0)
