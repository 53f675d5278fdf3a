import re

import numpy as np

from cubeloom.llm import licenses, search, warc


def brute_top_k(queries, candidates, k=5):
    """(query_id, rank, id, score) by all inner products; a null id is last in a tie."""
    out = []
    for q, v in queries:
        found = [(-int(np.dot(v, w)), i is None, i) for i, w in candidates if w is not None and len(w) == len(v) and i != q]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return sorted(out, key=str)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.integers(-40, 40, (1200, 6)), np.tile(rng.integers(-40, 40, (1, 6)), (700, 1)), rng.integers(-2, 2, (300, 6))])
    rows = [(int(i), v[i].astype(float).tolist()) for i in range(len(v))]
    rows += [(5, v[5].astype(float).tolist()), (5, v[700].astype(float).tolist()), (50, v[3].astype(float).tolist()), (None, [90.0] * 6), (None, [1.0] * 6), (9000, None), (9001, [1.0, 2.0]), (9002, []), (9003, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, vector array<double>, q string, n int")
    got = search.top_k(df.where("id % 50 = 0 OR id > 9000"), df, ball=300, most=150, most_queries=16).collect()
    asked = [(i, x) for i, x in rows if i is not None and x is not None and (i % 50 == 0 or i > 9000)]
    assert sorted(map(tuple, got), key=str) == brute_top_k(asked, rows)
    assert search.top_k(df.limit(0), df).count() == 0 and search.top_k(df, df.limit(0)).count() == 0
    assert search.top_k(df.where("id = 60"), df.where("id < 3")).count() == 3


def test_pairs_of_fragments_are_dropped_by_their_radii(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (24, 8))
    v = np.vstack([c + rng.integers(-3, 4, (60, 8)) for c in centres])
    rows = [(int(i), x.astype(float).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    pairs = []
    plain = search.search_pairs
    search.search_pairs = lambda p, *rest: pairs.append(p.count()) or plain(p, *rest)
    try:
        got = search.top_k(df.where("id % 7 = 0"), df, ball=60).collect()
    finally:
        search.search_pairs = plain
    assert sorted(map(tuple, got), key=str) == brute_top_k([r for r in rows if r[0] % 7 == 0], rows)
    fragments = pairs[0]
    assert fragments > 10 and sum(pairs) < 0.5 * fragments * fragments


def test_cover_tree_invariants():
    rng = np.random.default_rng(6)
    for v in (rng.normal(size=(2000, 5)), np.tile(rng.normal(size=(1, 5)), (700, 1)), (1.3 ** np.arange(900.0))[:, None] * np.ones((1, 2)), np.zeros((3, 0))):
        t = search.cover_tree(v, leaf=20, fanout=6)
        assert sorted(t.rows) == list(range(len(v))) and np.array_equal(v[t.rows], t.points)
        far = lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=-1))
        for i in range(len(t.lo)):
            assert far(t.points[t.lo[i] : t.hi[i]], t.centres[i]).max() <= t.radius[i] * (1 + 1e-9)
            c = t.children(i)
            if c:
                assert t.lo[c[0]] == t.lo[i] and [t.hi[x] for x in c[:-1]] == [t.lo[x] for x in c[1:]] and t.hi[c[-1]] == t.hi[i]
                assert t.centre[c[0]] == t.centre[i]  # nesting
                assert all(t.radius[x] <= t.scale[i] * (1 + 1e-9) for x in c)  # covering
                assert all(far(t.centres[x], t.centres[y]) >= t.scale[i] * (1 - 1e-9) for x in c for y in c if x < y)  # separation


def test_units(spark):
    df = spark.sql("SELECT array(0.5F, -0.001F) v UNION ALL SELECT array(1F, NULL) UNION ALL SELECT NULL UNION ALL SELECT array(float('nan')) UNION ALL SELECT array(float('inf')) UNION ALL SELECT array(-0.5F)")
    assert sorted(r[0] for r in df.select(search.whole_units(df["v"])).collect() if r[0] is not None) == [[-128.0], [128.0, -1.0]]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_licenses_equal_brute_force(spark):
    texts = [
        None, "", "CC BY", "cc-by cc by-nc CC", "All rights... RESERVED! all rights reserved all Rights reserved", "x general public License v3", "general publiK license general public licenſe", "Éall rights reserved", "rights reserved",
        "licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "noise " * 3000 + "Permission is hereby granted, free of charge, to any person obtaining really a copy of this software & associated documentation files", "word " * 60_000,
    ]
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(2, "CC BY", "", 0)], "doc_id long, text string, labels string, n_words int")
    got = {r["doc_id"] or 0: r for r in licenses.scan(df).collect()}
    assert licenses.scan(df).count() == len(texts) + 1
    for i, t in enumerate(texts):
        w, at, labels = words_of(t), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), t
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[9]["labels"] == "cc-by,cc-by-nc" and got[10]["labels"] == "gpl,gpl-3.0" and got[11]["labels"] == "mit" and got[11]["score"] >= 0.8
    assert licenses.scan(df.limit(0)).count() == 0


RECORD = "id long, url string, at long, kind string, status int, headers map<string,string>, digest string, outcome_ string"


def test_revisits(spark):
    rows = [
        (1, "http://www.A.org/x/?utm_source=f#top", 10, "response", 200, {"ETag": '"1"', "Content-Type": "text/html", "Date": "a"}, "d1", ""),
        (2, "https://a.org/x", 20, "revisit", 304, {"etag": 'W/"1"', "Date": "b", "Server": "s"}, None, ""),
        (3, "https://a.org/x", 20, "response", 200, {"ETag": '"2"'}, "d2", ""),
        (4, "https://a.org:443/x", 21, "revisit", 304, {"ETag": '"1"'}, None, ""),
        (5, "https://a.org/x", 500, "revisit", 304, None, "d2", ""),
        (6, "https://a.org/x", 5, "revisit", 304, None, "d2", ""),
        (7, None, 30, "revisit", 304, {}, None, ""), (8, None, 29, "response", 200, {}, None, ""),
        (9, "https://a.org/y", 40, "response", 404, {"ETag": '"1"'}, "d", ""), (10, "https://a.org/y", 41, "revisit", 304, {"ETag": '"1"'}, None, ""),
        (11, "https://a.org/z", 40, "response", 200, {"Last-Modified": "m"}, "d", ""), (12, "https://a.org/z", 900, "revisit", 304, {"Last-Modified": "m", "Vary": "v"}, None, ""),
        (12, "https://a.org/z", 900, "revisit", 304, {"Last-Modified": "m", "Vary": "v"}, None, ""),
    ]
    df = spark.createDataFrame(rows, RECORD)
    for stretch in (1, 7, 100_000):
        got = warc.resolve(df, stretch)
        out = {r["id"]: (r["outcome"], r["refers_to"]) for r in got.collect()}
        assert out == {1: ("response", None), 2: ("resolved", 1), 3: ("response", None), 4: ("mismatch", None), 5: ("resolved", 3), 6: ("missing", None), 7: ("missing", None), 8: ("response", None), 9: ("response", None), 10: ("missing", None), 11: ("response", None), 12: ("resolved", 11)}
        assert got.count() == len(rows) and "outcome_" in got.columns
    merged = {r["id"]: r["headers"] for r in got.collect()}
    assert merged[2] == {"etag": 'W/"1"', "content-type": "text/html", "date": "b"} and merged[12] == {"last-modified": "m", "vary": "v"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    one = warc.write_record("response", "http://a.org/", "2024-01-01T00:00:00Z", {"ETag": '"1"'}, b"<p>\r\n\r\nhi</p>", "a")
    two = warc.write_record("revisit", "http://a.org", "2024-01-02T00:00:00Z", {"ETag": '"1"'}, None, "b", "304 Not Modified")
    (tmp_path / "x.warc.gz").write_bytes(one + two)
    records = warc.read_warc(spark, str(tmp_path)).cache()
    done = {r["id"]: r for r in warc.fetch(warc.resolve(records), records).collect()}
    assert bytes(done["<urn:uuid:b>"]["payload"]) == b"<p>\r\n\r\nhi</p>" and done["<urn:uuid:b>"]["outcome"] == "resolved"


def test_warc_files_that_are_cut_or_odd(spark, tmp_path):
    one = warc.write_record("response", "http://a.org/", "2024-01-01T00:00:00Z", {"ETag": '"1"', "etag": '"2"'}, b"whole", "a")
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: n\r\nWARC-Date: soon\r\n\r\nHTTP/1.1 200 OK\r\nA: 1\r\n\r\nno length\r\n\r\n"
    plain += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: m\r\nContent-Length: 9000\r\nWARC-Date: 2024-01-01T00:00:00\r\n\r\nHTTP/1.1 200 OK\r\n\r\ncut"
    assert [r[0] for r in warc.parse(one + one[: len(one) // 2])][0] == "<urn:uuid:a>"
    found = list(warc.parse(plain))
    assert [(r[0], r[2], r[5], r[6]) for r in found] == [("n", None, {"a": "1"}, b"no length"), ("m", 1704067200, {}, b"cut")]
    assert list(warc.parse(iter([plain[i : i + 7] for i in range(0, len(plain), 7)]))) == found
    assert list(warc.parse(b"")) == list(warc.parse(b"WARC/1.0\r\nContent-")) == list(warc.parse(b"\x1f\x8bnot gzip")) == []
    (tmp_path / "a.warc.gz").write_bytes(one * 3 + one[:40])
    (tmp_path / "b.warc").write_bytes(plain)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in rows) == ["<urn:uuid:a>"] * 3 + ["m", "n"] and {r["headers"].get("etag") for r in rows} == {'"1", "2"', None}


def test_revisits_with_clashing_and_missing_values(spark):
    rows = [(1, "http://a/x", 1, "response", 200, {"ETag": "1", "etag": "1", "X": None}, "d", "k", b"p"), (2, "http://a/x", 2, "revisit", 304, {"etag": "1"}, None, "k", None), (2, "http://a/x", 3, "revisit", 304, None, "d", "k", None)]
    rows += [(None, None, None, "revisit", None, None, None, None, None)] * 3 + [(4, "http://a/x", None, "revisit", 304, {"etag": "1"}, None, "k", None)]
    df = spark.createDataFrame(rows, "id long, url string, at long, kind string, status int, headers map<string,string>, digest string, key string, payload binary")
    df = df.selectExpr("*", "1 as _stretch", "2 as row", "3 as outcome", "4 as canonical_url", "5 as _of", "6 as base", "7 as `a.b`")
    done = warc.resolve(df)
    assert len(set(done.columns)) == len(done.columns)
    got = done.collect()
    assert sorted((r["id"] or 0, r["at"] or 0, r["outcome"]) for r in got) == [(0, 0, "missing")] * 3 + [(1, 1, "response"), (2, 2, "resolved"), (2, 3, "resolved"), (4, 0, "missing")]
    assert all((r["_stretch"], r["row"], r["_of"], r["base"], r["a.b"]) == (1, 2, 5, 6, 7) for r in got)
    fetched = warc.fetch(done, df)
    assert fetched.count() == len(rows) and sum(r["payload"] == b"p" for r in fetched.collect()) == 3
