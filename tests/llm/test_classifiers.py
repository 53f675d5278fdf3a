import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import quality, toxicity
from cubeloom.llm.common import fold, in_task, read

SF = "/root/testdata/sf0.01"


def plain_kernel(s, t, n=3, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel_equals_its_definition():
    pairs = [("idiot", "idiot"), ("idxiot", "idiot"), ("ab", "abc"), ("stupid", "sxtxupid"), ("banana", "ananas"), ("é" * 4, "éaé"), ("abcabc", "cba")]
    got = toxicity.subsequence_kernel([p[0] for p in pairs], [p[1] for p in pairs])
    assert np.allclose(got, [plain_kernel(*p) for p in pairs])


def test_kernel_with_landmarks_equals_its_definition(monkeypatch):
    strings = ["idiot", "scum", "banana", "éaéoé"]
    words = ["idiot", "i.d", "ixdxixoxt", "ab", "", "éoaé", "xyz", "scuscum", "ana" * 10]
    want = [[plain_kernel(w, t) for t in strings] for w in words]
    assert np.allclose(toxicity.Landmarks(strings).values(words), want)
    monkeypatch.setattr(toxicity.Landmarks, "most_table", 0)  # the way for large alphabets
    assert np.allclose(toxicity.Landmarks(strings).values(words), want)
    model = toxicity.Model(strings)
    assert np.allclose(np.diag(model.values(strings)), 1)
    for w in words:
        k = toxicity.NOT_LETTER.sub("", w)
        if len(k) < 33:
            norm = [np.sqrt(sum(toxicity.DECAY ** (2 * (j - i + 1)) * (j - i - 1) for i in range(len(x)) for j in range(i + 2, len(x))) or 1) for x in (k, *strings)]
            plain = [(plain_kernel(k, t) / norm[0] / (plain_kernel(t, t) / norm[j + 1])) ** toxicity.POWER for j, t in enumerate(strings)]
            assert np.allclose(model.values([w])[0], plain if k else 0)
    model.learn({"alpha", "idiot"})
    model.learn(set(words), most=5)  # what was kept makes room
    assert all(np.allclose(model.rows[model.known[w]], model.values([w])[0], atol=1e-5) for w in words)


def test_landmarks_are_counted_alike_with_any_table(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(400)]
    clean = [set(rng.choice(words, 30).tolist()) for _ in range(60)]
    toxic = [set(rng.choice(words, 30).tolist()) | {["zorkling", "vexmuff", "grumbolt"][i % 3]} for i in range(60)]
    whole = toxicity.choose_landmarks(toxic, clean)
    monkeypatch.setattr(toxicity, "SEEN_BITS", 3)
    assert whole and toxicity.choose_landmarks(toxic, clean) == whole


def test_toxicity_holds_out(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.withColumn("score", F.lit("clash")).drop("score"), model).join(labels, "doc_id").withColumn("held", fold(F.col("doc_id"), 5) == 0).select("held", "toxic", "score").collect()
    held = [(r["toxic"], r["score"]) for r in got if r["held"]]
    assert sum((s >= 0.5) == bool(t) for t, s in held) / len(held) > 0.93
    assert sum(s >= 0.5 for t, s in held if not t) <= 0.02 * len(held)


def test_toxicity_recall_by_language():
    """On the larger tables, held-out rows only; half of what is missed or flagged there has no sign of its label."""
    import pyarrow.parquet as pq
    import zlib

    at = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{at}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    known = docs.merge(labels.dropna(subset=["toxic"]), on="doc_id")
    held = known["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    train, test = known[~held], known[held]
    model = toxicity.fit(train["text"].tolist(), train["toxic"].astype(int).tolist())
    flagged = model.scores(test["text"].tolist()) >= 0.5
    toxic = (test["toxic"] == 1).to_numpy()
    assert flagged[toxic].mean() >= 0.85 and flagged[~toxic].mean() <= 0.012
    for lang, least in (("en", 0.85), ("fr", 0.9), ("de", 0.65), ("es", 0.9)):
        assert flagged[toxic & (test["lang"] == lang).to_numpy()].mean() >= least, lang


def test_toxicity_finds_stems_by_their_share():
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnoprstuvw")
    word = lambda a, b: "".join(rng.choice(letters, rng.integers(a, b)))
    words = [word(2, 9) for _ in range(3000)]

    def make(n, k):
        found = rng.choice(words, n).tolist() + [f"grozzik{word(1, 6)}" for _ in range(k)]
        rng.shuffle(found)
        return " ".join(found) + "."

    sizes = rng.integers(60, 400, 900)
    texts = [make(n, int(rng.random() < 0.2)) for n in sizes[:800]] + [make(n, 2 + n // 40) for n in sizes[800:]]
    model = toxicity.fit(texts, [0] * 800 + [1] * 100)
    assert model.stems >= 1 and any(s in "grozzik" for s in model.landmarks[model.first :])
    assert (model.scores([make(200, 8) for _ in range(40)]) > 0.5).mean() >= 0.95
    assert (model.scores([make(n, int(n % 2)) for n in rng.integers(60, 400, 100)]) > 0.5).mean() <= 0.03
    assert model.scores([make(600, 1), None, ""]).max() < 0.5


def test_toxicity_finds_gapped_and_padded_insults():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(3000)]
    make = lambda *bad: " ".join(rng.choice(words, 40).tolist() + list(bad)) + "."
    insults = ["wretchling", "gobsnik", "dunderfop"]
    texts = [make() for _ in range(300)] + [make(insults[i % 3]) for i in range(90)]
    model = toxicity.fit(texts, [0] * 300 + [1] * 90)
    clean = model.scores([make() for _ in range(100)])
    assert (clean < 0.5).mean() > 0.97 and len(set(clean.round(9))) > 50  # a text without any landmark has its own score
    for bad in (*insults, "w-r-e-t-c-h-l-i-n-g", "gob.snik", "dunderrfop", "GOBSNIK", "d u n d e r f o p", "wretchxling", "dunderfp", "goxbsnik"):
        assert model.scores([make(bad)])[0] > 0.5, bad


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, module):
    schema = "doc_id long, text string, quality string, s string"
    rows = [(1, None, "q", ""), (2, "", "q", ""), (3, "x" * 200_000, None, ""), (None, "the word " * 30_000, "", ""), (4, "same", "", ""), (4, "same", "", "")]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, none)
    got = module.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and all(abs(r["score"] - 0.5) < 1e-9 for r in got)
    one = module.train(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, None, None), (None, 0, 1)], none.schema))
    assert module.score(docs, one).count() == 6
    assert module.score(spark.createDataFrame([], schema), model).count() == 0
    clash = docs.selectExpr("*", "1 as _statistics", "2 as label", "'x' as score")
    some = module.score(clash, one).collect()
    assert all(r["_statistics"] == 1 and r["label"] == 2 and 0 <= r["score"] <= 1 for r in some) and len(some) == 6


def test_quality_rules_equal_their_column(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 300
    rows = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "text", "quality", "score", (fold(F.col("doc_id"), 4) == 2).alias("held")).collect()
    held = [r for r in rows if r["held"]]
    assert sum((r["score"] >= 0.7) == bool(r["quality"]) for r in held) / len(held) > 0.95
    for r in rows[:40]:
        x = dict(zip(quality.STATISTICS, quality.statistics_of(r["text"])))
        z = model.intercept + sum(w for bounds, w in model.rules if all((x[n] > b) if up else (x[n] <= b) for n, up, b in bounds))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_a_fit_in_a_task_sees_all_rows_or_none(spark):
    rows = spark.range(2500).repartition(7)
    assert in_task(rows, lambda x: (len(x), int(x["id"].sum()))) == (2500, 2500 * 2499 // 2)
    assert in_task(rows.where("id < 0"), lambda x: (len(x), list(x.columns))) == (0, ["id"])
