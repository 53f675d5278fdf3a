"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import html, licenses, media, mixing, negatives, packing, quality, search, sharding, simhash, spelling, toxicity, warc
from .common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media(read(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height", "depth"), "histogram")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", feature.alias("feature"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), search.whole_units(F.col("embedding")).alias("vector"))
    found = search.top_k(vectors.where("id % 50 = 0"), vectors)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a capture at the time page_id. A URL with a query string was asked for with validators and counts as a
    revisit; the entity tag is made of the canonical URL and of whether the html's length is odd."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    asked = F.coalesce(F.contains("url", F.lit("?")), F.lit(False))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(warc.canonical(F.col("url")), F.lit(""))), F.lit("-"), (F.length(F.coalesce("html", F.lit(""))) % 2).cast("string"), F.lit('"'))
    records = pages.select(
        F.col("page_id").alias("id"), "url", F.col("page_id").alias("at"), F.when(asked, "revisit").otherwise("response").alias("kind"),
        F.when(asked, 304).otherwise(200).alias("status"),
        F.when(asked, F.create_map(F.lit("ETag"), tag, F.lit("Date"), F.col("page_id").cast("string"), F.lit("Server"), F.lit("edge")))
        .otherwise(F.create_map(F.lit("ETag"), tag, F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Type"), F.lit("text/html"))).alias("headers"),
        F.when(asked, None).otherwise(F.md5("html")).alias("digest"),
    )
    done = warc.resolve(records, stretch=4096)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return done.select(F.col("id").alias("page_id"), "canonical_url", "kind", "outcome", "refers_to", said.alias("headers"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.forms(spelling.words(read(spark, sf_dir, "documents").select("doc_id", "text"), damage=97))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), search.whole_units(F.col("embedding")).alias("vector"))
    return negatives.mine(vectors.where("id % 100 = 0"), vectors)


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is `bytes`: leaves of the k-d tree have near-equal bytes."""
    found = sharding.assigned(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL["op1_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
SQL["op9_warc"] = r"""
WITH bare AS (
  SELECT page_id, url, html, contains(coalesce(url, ''), '?') AS asked,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM bare),
named AS (
  SELECT page_id, asked, CASE WHEN url IS NULL THEN NULL ELSE host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url,
         length(coalesce(html, '')) % 2 AS odd
  FROM parts),
tagged AS (SELECT *, '"' || md5(coalesce(canonical_url, '')) || '-' || odd || '"' AS tag FROM named),
joined AS (
  SELECT r.*, b.page_id AS base_id, b.tag AS base_tag
  FROM tagged r ASOF LEFT JOIN (SELECT * FROM tagged WHERE NOT asked AND canonical_url IS NOT NULL) b
    ON r.canonical_url = b.canonical_url AND r.page_id > b.page_id)
SELECT page_id, canonical_url, CASE WHEN asked THEN 'revisit' ELSE 'response' END AS kind,
       CASE WHEN NOT asked THEN 'response' WHEN base_id IS NULL THEN 'missing' WHEN tag = base_tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN asked AND tag = base_tag THEN base_id END AS refers_to,
       CASE WHEN NOT asked OR (asked AND tag = base_tag) THEN 'content-type=text/html;date=' || page_id || ';etag=' || tag
            ELSE 'date=' || page_id || ';etag=' || tag || ';server=edge' END AS headers
FROM joined
"""
SQL["op12_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
