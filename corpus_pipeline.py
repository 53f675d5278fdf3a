"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that calls one operator over all that its predecessor kept; all but the
last return the columns of documents. Between stages the rows are written as Parquet and read again.

Every stage takes nulls in any column (a null or empty text is a text without words; a null id is no labelled row), texts
of any length, repeated rows (each is scored, linked, mixed and packed) and empty tables (the result is empty). Further
columns pass, of any name, up to the last stage, whose columns are those of the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import mixing, packing, quality, simhash, toxicity
from cubeloom.llm.common import fresh, quoted, read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.7 go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return quality.score(docs, model, score).where(F.col(score) >= 0.7).select(*map(quoted, docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine scores at 0.5 or more go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*map(quoted, docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources' words meet their targets."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, each sequence with the sources in the proportions of the mix."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("mixing", mix_sources), ("packing", pack_tokens)]
#: The stages train models and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
