import re
import zlib
from collections import Counter, defaultdict

import pytest

from cubeloom.llm import queries, spelling
from cubeloom.llm.common import read

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, damage=97, length=5, least=3):
    """Words and their counts, run by run."""
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= length and n >= least}


def one_apart(words):
    """Pairs one edit apart: by all texts with one character left out, each pair looked at itself."""
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    pairs = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in pairs:
                    same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
                    less, more = sorted((a, b), key=len)
                    if same or len(more) == len(less) + 1 and any(more[:i] + more[i + 1 :] == less for i in range(len(more))):
                        pairs.add((a, b))
    return pairs


def forms(words):
    near = defaultdict(set)
    for a, b in one_apart(words):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


def of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11(spark, sf):
    at = f"/root/testdata/{sf}"
    want = forms(counted([(r["doc_id"], r["text"]) for r in read(spark, at, "documents").select("doc_id", "text").collect()]))
    got = queries.QUERIES["op11_spelling"](spark, at)
    assert of(got) == want and len(want) > 100
    assert [t for _, t in got.select("form_n", "n", "n_near").dtypes] == ["bigint"] * 3


def test_pairs_equal_all_edits(spark):
    some = [a + b + c for a in ("aab", "aba", "bbb", "éab", "") for b in ("aa", "ab", "b", "ÿ", "") for c in ("aaa", "bba", "abab", "b")]
    some += ["x" * n for n in range(1, 9)] + ["q" + x for x in some[:20]] + ["lonely", "z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1500]
    words = {w: 3 + len(w) for w in some if w}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == one_apart(words)
    assert of(spelling.forms(df)) == forms(words)


def test_terminals_are_few(spark):
    from itertools import product

    words = ["".join(p) for p in product("abcd", repeat=5)]  # every node has four children
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    made = spelling.terminals(df)
    assert made.count() <= 4 * 10 * len(words) + len(words)  # four for each light edge, log2(1024) of these at most
    assert spelling.pairs(df).count() == len(words) * 5 * 3 // 2


def test_chains(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("a", "w000"), ("b", "w039")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, root string")).collect()}
    assert set(got.values()) == {"w040"} and len(got) == len(links)


def test_edges_of_the_input(spark):
    rows = [(1, "Hello hello HELLO hallo Àhello"), (None, "hello world world world worlld worlld worlld"), (2, None), (3, ""), (3, "hello"), (3, "hello"), (4, "ab " * 5), (5, "k" * 20_000), (6, "k" * 20_000 + " " + "k" * 20_000), (7, "k" * 19_999), (8, "1234 中文 __")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, `n``` int")
    assert of(spelling.forms(spelling.words(df, damage=97))) == forms(counted(rows))
    assert of(spelling.forms(spelling.words(df))) == forms(counted(rows, None))
    assert spelling.forms(spelling.words(df.limit(0))).count() == 0
    seen = {(r["doc_id"], tuple(map(tuple, r["variants"]))) for r in spelling.grouped(df).collect()}
    assert (2, ()) in seen and (8, ()) in seen and spelling.grouped(df).columns == [*df.columns, "variants"] and spelling.grouped(df.limit(0)).count() == 0
    few = [("hello", 20), ("hallo", 4), ("hullo", 3)]
    assert {r["word"]: r["root"] for r in spelling.forms(spark.createDataFrame(few, "word string, n long")).collect()} == dict.fromkeys(("hello", "hallo", "hullo"), "hello")
