"""Each query of this subpackage as it is registered, against SQL or a plain computation of its columns."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pandas as pd
import pytest

from cubeloom.llm import html, licenses, media, queries
from cubeloom.llm.common import read

from .test_search_scan_revisit import words_of
from .test_simhash import brute, spread

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return read(spark, SF, "documents").toPandas()


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = rows(spark, name), con.sql(queries.SQL[name]).df()
    plain = lambda f: sorted(map(str, f[sorted(want.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want) and len(got)


@pytest.mark.parametrize(("name", "parts", "held", "edge", "label"), [("op2_toxicity", 5, 0, 0.5, "toxic"), ("op3_quality", 4, 2, 0.7, "quality")])
def test_classifiers(spark, documents, name, parts, held, edge, label):
    got = rows(spark, name)
    assert sorted(got["doc_id"]) == sorted(documents["doc_id"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= edge) for r in got.itertuples())
    known = got.merge(read(spark, SF, "labels").toPandas(), on="doc_id").dropna(subset=[label])
    assert (known["predicted"] == known[label]).mean() > 0.85


def test_op4(spark, documents):
    got = rows(spark, "op4_mixing").set_index("doc_id")
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents.itertuples()}
    assert got["size"].to_dict() == size
    source = {r.doc_id: r.source for r in documents.itertuples()}
    totals = defaultdict(int)
    for i, n in size.items():
        totals[source[i]] += n
    from .test_mixing import targets

    want = targets(totals)
    assert all(r.source_size == totals[source[i]] and abs(r.target - want[source[i]]) < 1e-6 * max(1, r.target) for i, r in got.iterrows())
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for _, r in got.iterrows())
    for s in totals:
        mine = [i for i in size if source[i] == s]
        assert abs(got.loc[mine, "taken"].sum() - want[s]) <= max(size[i] for i in mine)
    assert got["taken"].to_dict() == rows(spark, "op4_mixing").set_index("doc_id")["taken"].to_dict()


def test_op5(spark, documents):
    got = rows(spark, "op5_media").set_index("doc_id")
    for r in documents.itertuples():
        payload, g = media.payload_of((r.text or "").encode()), got.loc[r.doc_id]
        stored = media.encode_png(payload)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((r.text or "").encode()), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (g.media_bytes, g.media_sha256) == (len(stored), sha256(stored).hexdigest()) and media.decode_png(stored) == payload
    assert len(got) == len(documents)


def test_op6(spark, documents):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, ids = rows(spark, "op6_packing"), {}
    for r in documents.itertuples():
        ids[r.doc_id] = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
    for i, pieces in got.sort_values("start").groupby("doc_id"):
        assert pieces["start"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]] and pieces["length"].sum() == len(ids[i])
        assert all(p.doc_tokens == len(ids[i]) and p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes()) for p in pieces.itertuples())
    assert set(got["doc_id"]) == set(ids)
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces["offset"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]] and pieces["length"].sum() <= 2048


def test_op7(spark, documents):
    got = rows(spark, "op7_licenses").set_index("doc_id")
    for r in documents.itertuples():
        w, g, at, labels = words_of(r.text), got.loc[r.doc_id], [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert (g.n_words, g.n_base, g.base_labels) == (len(w), len(at), ",".join(sorted(labels))) and labels <= set(g.labels.split(","))
        assert [None if pd.isna(x) else int(x) for x in (g.first_word, g.last_word)] == ([min(at), max(at)] if at else [None, None]) and 0 <= g.score <= 1


def test_op8(spark, documents):
    got = rows(spark, "op8_simhash").set_index("doc_id")
    fps = {r.doc_id: brute(r.text) for r in documents.itertuples()}
    root = spread(fps.values())
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert all(got.loc[i, "fingerprint"] == f"{f:016x}" and got.loc[i, "component_id"] == least[root[f]] for i, f in fps.items()) and len(got) == len(fps)


def test_op10(spark):
    pages = read(spark, SF, "pages").toPandas()
    got = rows(spark, "op10_html").set_index("page_id")
    assert len(got) == len(pages)
    for r in pages.itertuples():
        g = got.loc[r.page_id]
        assert g.url == r.url and g.n_chars == len(g.text) and g.text == html.extract(r.html)  # all pages hold an article
