"""WARC records and the resolution of not-modified revisits.

A revisit record says that a resource had not changed; it holds validators and a few headers, no payload. It is resolved
by an as-of join on the canonical URL to the latest earlier full response: the validators must agree, and of the revisit's
headers those that a 304 may carry replace the response's. The join runs in two steps, within stretches of time and over
the stretches' last responses, so that a URL with very many captures is no single task's work.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh, quoted

#: Headers that a not-modified response may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visit, not a resource.
VISIT_PARAMETERS = ("utm_[a-z]+", "ref", "fbclid", "gclid", "sessionid")
RECORD = "id string, url string, at long, kind string, status int, headers map<string,string>, payload binary"


def canonical(url: Column) -> Column:
    """Scheme, user, port 80/443, leading www., fragment, visit parameters and a trailing slash go; the host is in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), rf"(^|&)(?:{'|'.join(VISIT_PARAMETERS)})=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.when(url.isNull(), None).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _header(name: str) -> Column:
    return F.element_at("headers", F.lit(name))


def _opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _lower(headers: Column) -> Column:
    """Headers by names in lower case; of names that so become one, the different values in order, joined by commas as HTTP allows."""
    entries = F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    of = lambda k: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == k), lambda e: e["value"]))), ", ")
    return F.map_from_arrays(names, F.transform(names, of))


#: What resolve gives anew.
MADE = ("headers", "digest", "canonical_url", "outcome", "refers_to")


def resolve(records: DataFrame, stretch: int = 86_400, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """records (id, url, at, kind, status, headers, digest and what else there is) with canonical_url, refers_to, outcome and merged headers.

    A full response is of kind response and status 200. outcome: 'response' for records that are no revisit; 'resolved' if
    the latest earlier full response (by at, then id) has the revisit's entity tag, or lacking one on either side its
    last-modified, or lacking these too its digest; 'mismatch' if these differ or no validator is shared; 'missing' if
    there is no such response. Records without URL or time are never full responses of another nor have one; header names
    are taken in lower case, headers without value go. Ties in time: a response of the same time and smaller id is
    earlier. Repeated rows stay. Other columns pass, of any name; those named as what is made here give way. An empty table gives none.
    """
    taken = [c for c in records.columns if c.lower() not in MADE]
    known = records.select(F.struct(*map(quoted, taken)).alias("row"), "id", "at", "kind", "digest", canonical(F.col("url")).alias("canonical_url"), _lower(F.col("headers")).alias("headers"), F.floor(F.col("at") / stretch).alias("stretch"), "status")
    alone = F.col("canonical_url").isNull() | F.col("at").isNull()
    full = (F.col("kind") == "response") & (F.col("status") == 200) & ~alone
    known = known.withColumn("full", F.when(full, F.struct("at", "id", "headers", "digest")))
    known = known.withColumn("key", F.when(alone, F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("canonical_url")))
    step = Window.partitionBy("key", "stretch").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("near", F.last("full", ignorenulls=True).over(step))
    # per URL and stretch one row: its last full response; then the last of all stretches before
    ends = known.where(~alone).groupBy("key", "stretch").agg(F.max_by("full", F.when(full, F.struct("at", "id"))).alias("end"))
    span = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "stretch", F.last("end", ignorenulls=True).over(span).alias("before"))
    both = inside.join(ends, ["key", "stretch"], "left").withColumn("base", F.coalesce("near", "before"))
    base = lambda name: F.element_at("base.headers", F.lit(name))
    agrees = F.coalesce(_opaque(_header("etag")) == _opaque(base("etag")), _header("last-modified") == base("last-modified"), F.col("digest") == F.col("base.digest"), F.lit(False))
    outcome = F.when(~F.col("kind").eqNullSafe("revisit"), "response").when(F.col("base").isNull(), "missing").when(agrees, "resolved").otherwise("mismatch")
    allowed = F.array(*map(F.lit, permitted))
    newer = F.map_filter("headers", lambda k, v: F.array_contains(allowed, k))
    older = F.map_filter("base.headers", lambda k, v: ~F.map_contains_key(newer, k))
    both = both.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return both.select(*(F.col("row").getField(c).alias(c) for c in taken), "digest", "canonical_url", "outcome", F.when(done, F.col("base.id")).alias("refers_to"), F.when(done, F.map_concat(older, newer)).otherwise(F.col("headers")).alias("headers"))


def fetch(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """resolved (see resolve) with payload: of a resolved revisit that of the response it refers to, of others their own.

    Records of one id have one payload, the least that is not null; rows without id or without such a record have none.
    """
    of, payload = fresh(resolved.columns, "_of", "_payload")
    own = records.groupBy(F.col("id").alias(of)).agg(F.min("payload").alias(payload))
    rest = [c for c in resolved.columns if c.lower() != "payload"]
    return resolved.select(*map(quoted, rest)).join(own, F.coalesce("refers_to", "id") == F.col(of), "left").select(*map(quoted, rest), F.col(payload).alias("payload"))


def write_record(kind: str, url: str, date: str, headers: dict[str, str], payload: bytes | None, record_id: str, status: str = "200 OK") -> bytes:
    """One gzip member with a WARC/1.1 record of an HTTP response or revisit."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    body = f"HTTP/1.1 {status}\r\n{lines}\r\n".encode() + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", mtime=0)


def unzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of chunks; of gzip members the unpacked ones, as far as they go."""
    first, packed, tail = True, None, b""
    for chunk in chunks:
        if first:
            first, packed = False, zlib.decompressobj(31) if chunk[:2] == b"\x1f\x8b" else None
        if packed is None:
            yield chunk
            continue
        tail = chunk
        while tail:
            try:
                yield packed.decompress(tail)
            except zlib.error:
                return
            if not packed.eof:
                break
            tail, packed = packed.unused_data.lstrip(b"\0"), zlib.decompressobj(31)


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple]:
    """(id, url, at, kind, status, headers, payload) of the response and revisit records of a WARC file, plain or gzip.

    A file that is cut off is read as far as it goes: its last record has what is there of it. A record without a usable
    length reaches to the next record's first line, one without a usable date has none. One record is held at a time.
    """
    chunks = unzipped(iter([data]) if isinstance(data, bytes) else data)
    held, over = bytearray(), False

    def more() -> bool:
        nonlocal over
        chunk = next(chunks, None)
        over = chunk is None
        held.extend(chunk or b"")
        return not over

    while True:
        while (start := held.find(b"WARC/")) < 0 and more():
            pass
        if start < 0:
            return
        while (stop := held.find(b"\r\n\r\n", start)) < 0 and more():
            pass
        if stop < 0:
            return
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[start:stop].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(head["content-length"]) if re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")) else None
        if size is None:
            while (end := held.find(b"\r\n\r\nWARC/", stop + 2)) < 0 and more():
                pass
            end = len(held) if end < 0 else max(end, stop + 4)
        else:
            end = stop + 4 + size
            while len(held) < end and more():
                pass
        body = bytes(held[stop + 4 : end])
        del held[:end]
        if head.get("warc-type") in ("response", "revisit"):
            yield _record(head, body)


def _record(head: dict[str, str], body: bytes) -> tuple:
    from datetime import UTC, datetime

    lines, _, payload = body.partition(b"\r\n\r\n")
    first, *rest = lines.decode("latin-1").split("\r\n")
    headers: dict[str, str] = {}
    for k, _, v in (x.partition(":") for x in rest):
        k, v = k.strip().lower(), v.strip()
        headers[k] = f"{headers[k]}, {v}" if k in headers else v
    try:
        when = datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00"))
        at = int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())
    except ValueError:
        at = None
    status = int(first.split()[1]) if len(first.split()) > 1 and re.fullmatch("[0-9]{1,9}", first.split()[1]) else None
    return head.get("warc-record-id"), head.get("warc-target-uri"), at, head["warc-type"], status, headers, payload if head["warc-type"] == "response" else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files, with digest. A file is read as a stream by one task, one record in
    memory at a time; a folder without files gives no rows, a file that is cut off what it holds (see parse)."""
    import pandas as pd

    def chunks(at: str) -> Iterator[bytes]:
        system, name = filesystem(at)
        with system.open_input_file(name) as f:
            while chunk := f.read(1 << 20):
                yield bytes(chunk)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame["path"]:
                for r in parse(chunks(at)):
                    yield pd.DataFrame([r], columns=["id", "url", "at", "kind", "status", "headers", "payload"]).astype({"at": "Int64", "status": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, RECORD).withColumn("digest", F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)))
