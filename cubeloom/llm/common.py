"""What the operators of this subpackage share: reading, shared storage, row identity, components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach; a temporary one only where none is set, as in tests."""
    ship(spark)
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        set_already = context._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cubeloom-")
        context.setCheckpointDir(at)
        return context._jsc.sc().getCheckpointDir().get()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def filesystem(uri: str):
    """The file system of a path or URI, for tasks, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Run f on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def in_task(rows: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """What fit makes of all rows, which the caller bounds, in one task, so that the driver holds neither rows nor the fit's memory."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = list(frames)
        yield pd.DataFrame({"made": [pickle.dumps(fit(pd.concat(some, ignore_index=True) if some else pd.DataFrame(columns=names)))]})

    made = rows.repartition(1).mapInPandas(run, "made binary").collect()
    return pickle.loads(made[0]["made"]) if made else fit(pd.DataFrame(columns=names))  # an empty frame may have no partition


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory stays bounded."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fresh(columns: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, with underlines put before them until no column has them (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


def quoted(name: str) -> Column:
    """The column of this very name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def of_files(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a Parquet file: a scan with filters and projections only."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty() and plan.nodeName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


def placed(docs: DataFrame) -> DataFrame:
    """docs, if its rows have lasting places in Parquet files; else a stored copy of it, so that two scans see the same rows."""
    return docs if of_files(docs) else stored(docs, "rows")


def row_id(docs: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """Add file and row, which name a row of the files that docs (see placed) reads, the same in every scan of them."""
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(at["file_path"]).alias(file), at["row_index"].alias(row))


#: A key with more than this part of all rows is hot; there are fewer hot keys than its inverse.
HOT_PART = 1 / 1000


def join_hot(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with known, which has one row for each key and the number of the key's rows in `count`.

    Rows of hot keys, of which there are at most 1 / HOT_PART, meet their row of known by broadcast and are not moved.
    """
    total = known.agg(F.sum(count)).first()[0] or 0
    hot = known.where(F.col(count) > max(1, total * HOT_PART)).drop(count)
    names = F.broadcast(hot.select(key))
    cold = rows.join(names, key, "left_anti").join(known.drop(count), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: long): each node with the smallest node it reaches (u, root).

    Alternating large-star and small-star steps, so that the number of rounds grows with the logarithm of a
    component's size; each round is checkpointed. Loops and repeated edges are allowed; an empty frame gives none.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
