"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every text is hashed and joined to the k-grams of the templates. A match at word p of the
text and word t of the template votes for the diagonal p - t. Votes are counted by diagonal, neighbouring diagonals are
merged (words inserted or left out move the rest of a notice by a few), and a merged span is verified by the share of
the template's k-grams that it covers. The template table is fixed and small; it is what the join broadcasts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever all of their words stand in a row, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that are found with changes, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
K, REACH, COVER = 2, 2, 0.8
#: Notices of LONG k-grams or more may drift further: words inserted at several places add up.
LONG, LONG_REACH = 12, 6


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case. lower() maps no other character to an ASCII one but the Kelvin sign, which is set aside."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, NOT_WORD), "")


def grams(array: Column, k: int = K) -> Column:
    """The hash of each k words in a row."""
    return F.transform(
        F.when(F.size(array) >= k, F.sequence(F.lit(1), F.size(array) - (k - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.element_at(array, i + j) for j in range(k))),
    )


def templates(spark: SparkSession, base: tuple = BASE, notices: tuple = NOTICES, k: int = K) -> DataFrame:
    """template, label, is_base, n (its k-grams), hash and at (the k-gram's place); templates have at most 64 k-grams."""
    rows = [(i, text, label, i < len(base)) for i, (text, label) in enumerate([*base, *notices])]
    for _, text, _, _ in rows:
        if not k <= len(text.split()) <= 63 + k or not re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", text):
            raise ValueError(f"a template needs {k} to {63 + k} words in lower case: {text}")
    values = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(t).alias("text"), F.lit(x).alias("label"), F.lit(b).alias("is_base")) for i, t, x, b in rows))
    table = spark.range(1).select(F.explode(values).alias("r")).select("r.*")
    table = table.withColumn("grams", grams(F.split("text", " "), k))
    return table.select("template", "label", "is_base", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "hash"))


def votes(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES, k: int = K) -> DataFrame:
    """Votes by diagonal: _id, doc_id, n_words, template, diagonal, votes, places (bits). Each document has a row of template -1."""
    said = docs.select(F.monotonically_increasing_id().alias("_id"), "doc_id", words(F.col("text")).alias("w"))
    # hash 0 stands first in each document's list and meets the template -1, so that documents without a match stay
    hashes = said.select("_id", "doc_id", F.size("w").alias("n_words"), F.concat(F.array(F.lit(0).cast("long")), grams(F.col("w"), k)).alias("h"))
    each = hashes.select("_id", "doc_id", "n_words", F.posexplode("h").alias("p", "hash"))
    table = templates(docs.sparkSession, base, notices, k).select("template", "at", "hash")
    none = docs.sparkSession.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("hash"))
    found = each.join(F.broadcast(table.unionByName(none)), "hash").where((F.col("template") >= 0) | (F.col("p") == 0))
    return found.groupBy("_id", "doc_id", "n_words", "template", (F.col("p") - 1 - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("places")
    )


def spans(voted: DataFrame, base: tuple = BASE, notices: tuple = NOTICES, k: int = K, reach: int = REACH) -> DataFrame:
    """voted with cover: the share of the template's k-grams on a diagonal and those up to `reach` (long templates: LONG_REACH) beside it, and exact: all on the one diagonal."""
    about = F.create_map(*(x for i, (t, _) in enumerate([*base, *notices]) for x in (F.lit(i), F.lit(len(t.split()) - k + 1))))
    near, far = (Window.partitionBy("_id", "template").orderBy("diagonal").rangeBetween(-r, r) for r in (reach, max(reach, LONG_REACH)))
    n = F.element_at(about, F.col("template"))
    real = F.col("template") >= 0
    return voted.withColumn("merged", F.when(n >= LONG, F.bit_or("places").over(far)).otherwise(F.bit_or("places").over(near))).select(
        "_id", "doc_id", "n_words", "template", "diagonal",
        F.when(real, F.bit_count("merged") / n).otherwise(0.0).alias("cover"),
        F.when(real, F.bit_count("places") == n).otherwise(False).alias("exact"),
    )


def scan(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    score: the best share of a template's k-grams found in one place. Null and empty texts have no words and no labels.
    Null ids and repeated rows keep their rows; a text of any length is scanned whole. Overlapping places of a phrase
    all count. An empty table gives none.
    """
    label = F.element_at(F.create_map(*(x for i, (_, name) in enumerate([*base, *notices]) for x in (F.lit(i), F.lit(name)))), F.col("template"))
    own = F.col("exact") & (F.col("template") < len(base)) & (F.col("template") >= 0)
    # of notices that differ by a word or two and so are found at one place, the best stays
    place = Window.partitionBy("_id").orderBy("diagonal").rangeBetween(-REACH - 1, REACH + 1)
    known = spans(votes(docs, base, notices), base, notices).withColumn("label", F.when(F.col("template") >= 0, label))
    known = known.withColumn("best", F.max(F.when(F.col("template") >= len(base), F.col("cover"))).over(place))
    more = (F.col("template") >= len(base)) & (F.col("cover") >= cover) & (F.col("cover") >= F.col("best"))
    joined = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("label")))), ",")
    return known.groupBy("_id", "doc_id", "n_words").agg(
        F.count(F.when(own, 1)).alias("n_base"),
        F.min(F.when(own, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(own, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(own | more).alias("labels"),
        F.max("cover").alias("score"),
    ).drop("_id").withColumn("n_words", F.col("n_words").cast("long"))
