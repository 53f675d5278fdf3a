"""Spelling variants: words one edit apart, found by merging the light subtrees of their trie.

All counted words make one trie; a node is a prefix. The child of a node with the most words below it is heavy, the others
are light, so a word has at most log2(words) light edges above it. At each of them, and there only, the errata trie gets
terminals: what stands below the light edge is merged into the rest of the node's subtree with the edge's character
replaced by the heavy one, with it skipped, with the heavy one put before it, and with a wildcard in its place, which
meets the other light subtrees. The smaller side is moved in every merge, so there are O(n log n) terminals, and those that
coincide with a word, or with each other below a wildcard, are exactly the pairs one inserted, deleted or replaced character apart.

Two words that differ by a replaced character part at one node: if one takes the heavy edge, the other's terminal is that
word; if none does, both have the same wildcard. Of two that differ by a skipped character, take the last place where
skipping makes them equal; there the longer takes a light edge (and is found by skipping it), or the shorter does, or the
shorter ends there (and both are found by putting the heavy character in). Each pair comes up once.
Nodes are named by rolling hashes. Two nodes of one name share a heavy character, which costs terminals, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, join_hot, quoted, shared_dir, small_batches, stored

RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word's least code points and occurrences; a form has at least so many times the occurrences of its word.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
WILDCARD = "*"


def _without(word: Column, at: Column) -> Column:
    """The word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, at.cast("int") + 2, F.length(word)))


def words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the letter runs of all whole texts, A-Z lower-cased, of a least length that occur often enough.

    damage d: a run whose crc32 of `<id>:<run>` is divisible by d loses one character, at that crc32 modulo its length.
    Null and empty texts have no runs; a null id stands as the empty text; repeated rows count each; other columns play no part.
    """
    bare = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("i"), F.translate(quoted(text_col), UPPER, LOWER).alias("t"))
    each = bare.select("i", F.explode(F.regexp_extract_all("t", F.lit(f"({RUN})"), F.lit(1))).alias("w"))
    word = F.col("w")
    if damage:
        each = each.select("w", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")).alias("h"))
        word = F.when(F.col("h") % damage == 0, _without(word, F.col("h") % F.length(word))).otherwise(word)
    found = each.select(word.alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def edges(known: DataFrame) -> DataFrame:
    """id, i, node, ch of the trie's edges above each word (id binary, word): from the node of its first i characters by its next; ch is null at the word's end."""
    factor = np.uint64(0x9E3779B97F4A7C15)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        size = np.array([len(x) for x in texts], np.int64) + 1  # one more for the end
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), size)
        i = np.arange(len(points)) - start[row]
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()) - 1, factor))))
        z = (points ^ (points << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.concatenate(([np.uint64(0)], np.cumsum((z ^ (z >> np.uint64(27))) * power[i])))
        node = total[:-1] - total[start][row] + i.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        ch = pd.Series([c for x in texts for c in (*x, None)], dtype=object)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(i.astype(np.int32)), pa.array((node ^ (node >> np.uint64(31))).view(np.int64)), pa.array(ch, pa.string(), from_pandas=True)], ["id", "i", "node", "ch"]
        )

    return by_batch(known.select("id", "word"), run, "id binary, i int, node long, ch string")


def light_edges(paths: DataFrame) -> DataFrame:
    """id, i, heavy: the light edges of edges(), and the ends of words that have words below, with the heavy character of their node."""
    child = paths.where(F.col("ch").isNotNull()).groupBy("node", "ch").agg(F.count("*").alias("m"))
    heavy = child.groupBy("node").agg(F.min(F.struct(-F.col("m"), "ch")).alias("h"), F.sum("m").alias("below")).select("node", F.col("h.ch").alias("heavy"), "below").checkpoint()
    return join_hot(paths, heavy, "node", "below").where(F.col("ch").isNull() | (F.col("ch") != F.col("heavy"))).select("id", "i", "heavy")


def terminals(counted: DataFrame) -> DataFrame:
    """word, n, terminal: what words (word, n) put into the errata trie; one with the wildcard meets its like, any other a word."""
    spark = counted.sparkSession
    shared_dir(spark)
    small_batches(spark, 2000)
    known = counted.select("word", "n", F.unhex(F.md5("word")).alias("id"))
    light = light_edges(stored(edges(known), "edges")).groupBy("id").agg(F.collect_list(F.struct("i", "heavy")).alias("at"))  # log2(n) of a word at most
    each = known.join(light, "id").select("word", "n", F.inline("at"))
    head, rest = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 1, F.length("word"))
    own, tail = F.substring(rest, 1, 1), F.substring(rest, F.lit(2), F.length("word"))
    inside = F.array(
        F.concat(head, "heavy", tail),
        F.when(own != F.substring(tail, 1, 1), F.concat(head, tail)),  # of equal characters the last is skipped
        F.concat(head, "heavy", rest),
        F.concat(head, F.lit(WILDCARD), tail),
    )
    made = F.when(F.col("i") < F.length("word"), inside).otherwise(F.array(F.concat("word", "heavy")))
    return each.select("word", "n", F.explode(F.filter(made, lambda t: t.isNotNull())).alias("terminal"))


def _wild(made: DataFrame) -> DataFrame:
    """The groups of words below one wildcard: best (words by falling n), as many as there are letters at most."""
    groups = made.where(F.contains("terminal", F.lit(WILDCARD))).groupBy("terminal").agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")).alias("best"))
    return groups.where(F.size("best") > 1).select(F.array_sort("best").alias("best"))


def _met(made: DataFrame, counted: DataFrame) -> DataFrame:
    """u, un, v, vn: words whose terminal is another word."""
    plain = made.where(~F.contains("terminal", F.lit(WILDCARD))).select(F.col("word").alias("u"), F.col("n").alias("un"), F.col("terminal").alias("v"))
    return plain.join(counted.select(F.col("word").alias("v"), F.col("n").alias("vn")), "v")


def pairs(counted: DataFrame) -> DataFrame:
    """u, v (u < v): every two distinct words (word, n) one inserted, deleted or replaced code point apart, once."""
    counted = stored(counted, "words")
    made = stored(terminals(counted), "terminals")
    wild = _wild(made).select(F.posexplode("best").alias("p", "a"), "best")
    two = wild.select(F.col("a.word").alias("u"), F.explode(F.slice("best", F.col("p") + 2, F.size("best"))).alias("b")).select("u", F.col("b.word").alias("v"))
    both = _met(made, counted).select("u", "v").unionByName(two)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def forms(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """Of words (word, n): word, n, n_near (words one edit away), form, form_n, root.

    The form is the near word of the largest n, ties to the first in code-point order, if it has `times` n at least; root is
    the last of the forms from form to form, the word itself if it has none. Other columns give way. Words are distinct and
    not null, of letters only, of any length; an empty table gives none. Counts of near words come from the groups of the errata trie;
    pairs are not made of the groups below a wildcard.
    """
    counted = stored(counted.select("word", "n"), "words")
    made = stored(terminals(counted), "terminals")
    seen = F.struct((-F.col("n")).alias("less"), "word")
    met = _met(made, counted)
    one = met.select(F.col("u").alias("word"), F.lit(1).alias("k"), F.struct((-F.col("vn")).alias("less"), F.col("v").alias("word")).alias("b"))
    other = met.select(F.col("v").alias("word"), F.lit(1).alias("k"), F.struct((-F.col("un")).alias("less"), F.col("u").alias("word")).alias("b"))
    wild = _wild(made).select("best", F.explode("best").alias("a")).select(
        F.col("a.word").alias("word"), (F.size("best") - 1).alias("k"), F.when(F.col("a.word") == F.col("best")[0]["word"], F.col("best")[1]).otherwise(F.col("best")[0]).alias("b")
    )
    near = one.unionByName(other).unionByName(wild).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("b").alias("b"))
    enough = -F.col("b.less") >= times * F.col("n")
    named = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("b.word")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")
    )
    named = stored(named, "forms")
    root = roots(named.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return named.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(chains: DataFrame) -> DataFrame:
    """word, root of (word, root) without cycles: each step joins chains with themselves and doubles what they span."""
    now = chains.checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        now = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return now


def grouped(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int | None = None) -> DataFrame:
    """docs with variants: an array of (word, root) of the words of each text that have a form. Null and empty texts have none; all columns pass.

    Repeated rows keep an array each. The runs of a text are matched by aggregation over its words, so no group is larger than one text's distinct words.
    """
    changed = forms(words(docs, text_col, id_col, damage)).where(F.col("form").isNotNull()).select("word", "root")
    at, name = fresh(docs.columns, "_at", "variants")
    marked = stored(docs.withColumn(at, F.monotonically_increasing_id()), "rows")
    own = marked.select(F.col(at), F.explode(F.array_distinct(F.regexp_extract_all(F.translate(quoted(text_col), UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1)))).alias("word"))
    found = own.join(changed, "word").groupBy(at).agg(F.array_sort(F.collect_list(F.struct("word", "root"))).alias(name))
    empty = F.array().cast("array<struct<word:string,root:string>>")
    return marked.join(found, at, "left").select(*map(quoted, docs.columns), F.coalesce(F.col(name), empty).alias(name))
