import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import mixing, simhash
from cubeloom.llm.common import read, stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark):
    docs = read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        rows, before = out.collect(), {r["doc_id"]: r for r in now.collect()}
        assert rows and all(before[r["doc_id"]] == r for r in rows)
        if name == "near_duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(now.select("doc_id", "text")).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(set(groups.values()))
        if name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.copies(now).collect() if r["copies"]}
            assert {i: sum(r["doc_id"] == i for r in rows) for i in want} == want
        now = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0] > 0


def awkward(spark, n=30):
    """Rows with nulls in any column, empty and very long texts, repeated rows, and further columns with clashing and odd names."""
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they".split()
    rows = [(i, " ".join(words[(i * 7 + k * (i + 3)) % len(words)] for k in range(40 + i)) + ".", "en", "abc"[i % 3], 10) for i in range(n)]
    rows += [(None, None, None, None, None), (100, "", "en", "a", 0), (101, "   \n ", None, None, 4), (102, "word " * 200_000, "en", "a", 1_000_000), (7, rows[7][1], "en", "b", 10), (7, rows[7][1], "en", "b", 10), (103, None, "en", "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = {n: F.lit(i) for i, n in enumerate(("score", "fp", "root", "_id", "size", "taken", "copies", "queue", "_file", "_t", "component_id"))}
    return df.withColumns(more)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows_and_none(spark, stage):
    sf = "/root/testdata/sf0.001"
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = stored(awkward(spark), "awkward")
    got = run(spark, docs, sf)
    if stage == "packing":
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert run(spark, docs.limit(0), sf).count() == 0
        return
    assert got.columns == docs.columns
    kept = got.collect()
    told = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in kept} <= told and all(r["root"] == 2 for r in kept)
    if stage == "near_duplicates":
        assert sum(r["doc_id"] == 7 for r in kept) == 1 and sum(not (r["text"] or "").strip() for r in kept) == 1
    if stage == "toxicity":
        assert len(kept) == docs.count()  # none is toxic
    assert run(spark, docs.limit(0), sf).count() == 0
