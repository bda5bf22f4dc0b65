import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from versoline.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 12288, 100_000])
def test_round_trip(n):
    payload = media.padded(bytes(k % 251 for k in range(n)))
    found = media.probe(media.store(payload))
    assert len(payload) % 64 == 0 and payload
    assert media.read_back(media.store(payload), found[0]["keyframe_ranges"]) == payload
    assert (found[0]["codec"], found[0]["handler"], found[0]["n_samples"], found[0]["timescale"]) == ("raw ", "soun", len(payload), media.SAMPLE_RATE)
    assert len(found[0]["keyframe_ranges"]) == 1


def video(sizes, chunk_runs, offsets, keys, wide=False):
    """A track whose samples, chunks and sync samples are set out by hand."""
    pack = lambda kind, rows: struct.pack(">I", len(rows)) + b"".join(struct.pack(kind, *(r if isinstance(r, tuple) else (r,))) for r in rows)
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
        media.full(b"stts", pack(">II", [(len(sizes), 40)])),
        media.full(b"stss", pack(">I", keys)),
        media.full(b"stsc", pack(">III", chunk_runs)),
        media.full(b"stsz", struct.pack(">I", 0), pack(">I", sizes)),
        media.full(b"co64", pack(">Q", offsets)) if wide else media.full(b"stco", pack(">I", offsets)),
    )
    mdhd = media.full(b"mdhd", struct.pack(">QQIQ", 0, 0, 1000, 7), bytes(4), version=1)
    mdia = media.box(b"mdia", mdhd, media.full(b"hdlr", bytes(4), b"vide", bytes(12), b"v\0"), media.box(b"minf", stbl))
    return media.box(b"ftyp", b"isom", bytes(4)) + media.box(b"free", bytes(100)) + media.box(b"moov", media.box(b"trak", mdia)) + media.box(b"mdat", bytes(2000))


@pytest.mark.parametrize("wide", [False, True])
def test_sample_tables(wide):
    found = media.probe(video([10, 20, 30, 40, 50], [(1, 2, 1), (2, 3, 1)], [500, 700], [1, 3, 4], wide))[0]
    assert found["error"] is None
    assert (found["codec"], found["duration"], found["n_samples"], found["n_keyframes"], found["media_bytes"]) == ("avc1", 200, 5, 3, 150)
    assert found["keyframe_ranges"] == [{"first_byte": 500, "end_byte": 510}, {"first_byte": 700, "end_byte": 770}]


def test_broken():
    whole = media.store(media.padded(b"x" * 500))
    assert media.probe(None) == []
    for cut in range(0, len(whole) - 1, 7):
        found = media.probe(whole[:cut])
        assert len(found) == 1 and (found[0]["error"] or cut > len(whole) - 512)
    assert media.probe(video([10], [(1, 2, 1)], [500], [1]))[0]["error"]
    assert media.probe(video([10], [(1, 1, 1)], [99_999], [1]))[0]["error"]


def test_columns(spark):
    rows = [(1, b"a" * 64), (2, None), (3, b""), (3, b"")]
    df = media.probe_column(media.store_column(spark.createDataFrame(rows, "id int, media binary"), "media", "file"), "file", "tracks")
    got = {r["id"]: r for r in df.collect()}
    assert df.count() == 4 and got[2]["file"] is None and got[2]["tracks"] == []
    assert got[3]["tracks"][0]["n_samples"] == 64 and got[1]["media"] == b"a" * 64


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = media.op8_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.padded(texts[r["doc_id"]])
        assert r["n_bytes"] == len(texts[r["doc_id"]]) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.store(payload)).hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, media binary")
    assert media.with_round_trip(empty.withColumn("payload", F.lit(1)), "media").count() == 0


def test_hostile_boxes():
    """Boxes in boxes to any depth, and counts that no file backs."""
    heads = [struct.pack(">I4s", 8 * (k + 1), b"moov") for k in range(100_000)]
    deep = b"".join(reversed(heads))
    assert media.probe(deep) == [{"error": "ValueError: no track"}]
    whole = media.store(bytes(640))
    for kind, skip in ((b"stsz", 12), (b"stco", 8), (b"stsc", 8), (b"stts", 8)):
        at = whole.index(kind)
        for value in (0, 0xFFFFFFFF, 0x7FFFFFFF):
            bad = bytearray(whole)
            bad[at + skip : at + skip + 4] = struct.pack(">I", value)
            assert media.probe(bytes(bad))[0]["error"], (kind, value)
    at = whole.index(b"stsz")
    each = bytearray(whole)
    each[at + 8 : at + 16] = struct.pack(">II", 0, 0xFFFFFFFF)
    assert media.probe(bytes(each))[0]["error"]


def test_memory_is_that_of_chunks():
    import tracemalloc

    payload = bytes(50 << 20)
    tracemalloc.start()
    whole = media.store(payload)
    stored = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    found = media.probe(whole)
    probed = tracemalloc.get_traced_memory()[1] - len(whole)
    tracemalloc.stop()
    assert found[0]["n_samples"] == len(payload) and len(found[0]["keyframe_ranges"]) == 1
    assert stored < 1.2 * len(payload) and probed < 0.1 * len(payload)
