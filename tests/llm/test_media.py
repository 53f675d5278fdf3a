import hashlib
import io
import tarfile
import zlib

from cubeloom.llm import media
from cubeloom.llm.common import stored

SCHEMA = "doc_id long, text string, digest string, shard string"


def test_payload_and_png_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        text = b"x" * n
        payload = media.payload_of(text)
        assert len(payload) % 576 == 0 and payload and payload[:n] == text and set(payload[n:]) <= {255} and len(payload) - n <= 576
        data = media.encode_png(payload)
        assert media.decode_png(data) == payload and media.decode_header(data[:33]) == (576, len(payload) // 576, 8)


def test_rows_read_back_what_was_stored(spark, tmp_path):
    rows = [(1, "abc", "d", "s"), (2, "abc", None, None), (None, "abc", "d", "s"), (3, None, "", ""), (4, "", "", ""), (5, "é" * 200_000, "", ""), (5, "z" * 576, "", ""), (5, "z" * 576, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = media.media(df, str(tmp_path / "shards")).collect()
    assert len(got) == len(rows)
    texts = {(i, len((t or "").encode())): (t or "").encode() for i, t, *_ in rows}
    for r in got:
        payload = media.payload_of(texts[r["doc_id"], r["n_bytes"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["digest"] == r["payload_sha256"] and (r["width"], r["height"], r["depth"]) == (576, len(payload) // 576, 8)
        with open(tmp_path / "shards" / r["shard"], "rb") as f:
            f.seek(r["offset"])
            assert hashlib.sha256(f.read(r["length"])).hexdigest() == r["media_sha256"]
    assert len({(r["shard"], r["offset"]) for r in got}) == len({r["digest"] for r in got})
    for shard in (tmp_path / "shards").iterdir():
        for m in tarfile.open(fileobj=io.BytesIO(shard.read_bytes())):
            assert m.name.endswith(".png")
    assert media.media(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0


def test_metadata_reads_headers_only(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "abc" * 1000, "", "")], SCHEMA)
    index = stored(media.write_shards(df, str(tmp_path / "s")), "index")
    row = media.fill_metadata(media.objects(index), str(tmp_path / "s")).first()
    assert (row["width"], row["height"]) == (576, 6) and media.HEADER_BYTES == 33
