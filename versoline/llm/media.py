"""Media columns in ISO base media containers.

store() puts bytes into a container as 8-bit unsigned samples; probe() walks any such container's
nested boxes and decodes its sample tables into codec, duration and keyframe byte ranges. It never
decodes a payload: the byte ranges say where one lies, and read_back() copies it from there.
Sample tables stay as they are kept, by chunk and by run, so probing needs memory for a file's tables, not for its samples;
counts are held against the bytes that are there before anything is allocated for them.

Defined cases: null bytes give null media and no tracks; empty bytes become one block of zeros; bytes of any length are
whole; equal bytes give equal containers; what is not a sound container, nested to whatever depth, gives one track with only
error set; an empty table gives no rows; other columns stay, and columns of the names that are added are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices, table

#: The box types that hold other boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf")

SAMPLE_RATE = 8000
CHUNK_SAMPLES = 4096
PAD_TO = 64

TRACK = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("handler", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("n_keyframes", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("keyframe_ranges", T.ArrayType(T.StructType([T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType())]))),
    T.StructField("error", T.StringType()),
])


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes, to: int = PAD_TO) -> bytes:
    """data and zeros up to a positive multiple."""
    return data + bytes(-len(data) % to or (to if not data else 0))


def store(payload: bytes) -> bytes:
    """A container with payload as one track of 8-bit mono samples, all of them sync samples."""
    n = len(payload)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    chunks = -(-n // CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES if chunks else 0
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 or last == CHUNK_SAMPLES else []
    if chunks and last != CHUNK_SAMPLES:
        runs.append((chunks, last, 1))

    def head(first: int) -> bytes:
        at = np.arange(chunks, dtype=np.uint64) * CHUNK_SAMPLES + first
        offsets = full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes()) if first + n < 1 << 32 else full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes())
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, SAMPLE_RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1) if n else struct.pack(">I", 0)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", 1, n)),
            offsets,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        wide = n >= 1 << 32
        times = struct.pack(">QQIQ", 0, 0, SAMPLE_RATE, n) if wide else struct.pack(">IIII", 0, 0, SAMPLE_RATE, n)
        mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=int(wide)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        track = struct.pack(">QQIIQ", 0, 0, 1, 0, n) if wide else struct.pack(">IIIII", 0, 0, 1, 0, n)
        tkhd = full(b"tkhd", track, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=int(wide), flags=7)
        mvhd = full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=int(wide))
        return ftyp + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = 16 if n + 8 >= 1 << 32 else 8
    guess = head(0)
    exact = head(len(guess) + start)
    if len(exact) != len(guess):
        exact = head(len(exact) + start)
    long = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((exact, mdat, payload))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of the boxes in a range; ValueError where sizes don't fit."""
    while start < end:
        if start + 8 > end:
            raise ValueError("box header is cut")
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            if start + 16 > end:
                raise ValueError("box header is cut")
            n, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif n == 0:
            n = end - start
        if n < body - start or start + n > end:
            raise ValueError(f"box {kind.decode('latin-1')} does not fit")
        if kind == b"uuid":
            body += 16
        yield kind, body, start + n
        start += n


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int | None, int, int]]:
    """(type, track, start and end of the body) of every box at any depth; track counts the tracks in boxes of the top level."""
    open_boxes: list[tuple[Iterator, int | None]] = [(boxes(data, start, end), None)]
    tracks = 0
    while open_boxes:
        inner, track = open_boxes[-1]
        if (found := next(inner, None)) is None:
            open_boxes.pop()
            continue
        kind, a, b = found
        if kind == b"trak" and len(open_boxes) == 2:
            track, tracks = tracks, tracks + 1
        yield kind, track, a, b
        if kind in CONTAINERS:
            open_boxes.append((boxes(data, a, b), track))


def column(data: memoryview, at: int, end: int, rows: int, width: int, kind: str = ">u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    if at + rows * width * size > end:
        raise ValueError("a sample table is cut")
    return np.frombuffer(data, kind, rows * width, at).astype(np.int64).reshape(rows, width)


def probe_track(data: memoryview, parts: dict[bytes, tuple[int, int]]) -> dict:
    """Decodes one track's sample tables. parts: the bodies of its boxes by type."""

    def rows(kind: bytes, width: int, skip: int = 4, wide: str = ">u4") -> np.ndarray:
        if kind not in parts:
            return np.zeros((0, width), np.int64)
        a, b = parts[kind]
        return column(data, a + skip + 4, b, struct.unpack_from(">I", data, a + skip)[0], width, wide)

    a, b = parts[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, b = parts[b"stsd"]
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1") if struct.unpack_from(">I", data, a + 4)[0] else ""
    a, b = parts[b"hdlr"]
    handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    a, b = parts[b"stsz"]
    each, n = struct.unpack_from(">II", data, a + 4)
    if each * n > len(data):
        raise ValueError("samples lie outside the file")
    chunks = rows(b"co64", 1, wide=">u8")[:, 0] if b"co64" in parts else rows(b"stco", 1)[:, 0]
    runs = rows(b"stsc", 3)
    # chunks from the first of a run up to the next run's hold so many samples each
    stops = np.append(runs[1:, 0] - 1, len(chunks)) if len(runs) else np.zeros(0, np.int64)
    lengths = stops - (runs[:, 0] - 1)
    if (lengths < 0).any() or (len(runs) and runs[0, 0] < 1) or (chunks < 0).any():
        raise ValueError("chunks are out of order")
    per_chunk = np.concatenate([np.zeros(len(chunks) - lengths.sum(), np.int64), np.repeat(runs[:, 1], lengths)])
    if per_chunk.sum() != n:
        raise ValueError("chunks and samples do not agree")
    first_of = np.concatenate([[0], np.cumsum(per_chunk)])
    if each:
        bytes_before = lambda sample: sample * each
    else:
        sums = np.concatenate([[0], np.cumsum(column(data, a + 12, b, n, 1)[:, 0])])
        bytes_before = lambda sample: sums[sample]
    if b"stss" in parts:
        # a sample starts where its chunk starts, plus the sizes of those before it there
        key = rows(b"stss", 1)[:, 0] - 1
        if len(key) and (key.min() < 0 or key.max() >= n):
            raise ValueError("there is no such keyframe")
        of = np.searchsorted(first_of, key, side="right") - 1
        lo = chunks[of] + bytes_before(key) - bytes_before(first_of[of])
        hi, n_keyframes = lo + bytes_before(key + 1) - bytes_before(key), len(key)
    else:
        lo, n_keyframes = chunks, n
        hi = lo + bytes_before(first_of[1:]) - bytes_before(first_of[:-1])
    if len(hi) and hi.max() > len(data):
        raise ValueError("samples lie outside the file")
    lo, hi = lo[hi > lo], hi[hi > lo]
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] != hi[:-1]  # neighbours become one range
    first = np.flatnonzero(new)
    ends = hi[np.append(first[1:], len(lo)) - 1] if len(lo) else hi
    stts = rows(b"stts", 2)
    if stts[:, 0].sum() != n:
        raise ValueError("times and samples do not agree")
    if (stts[:, 0] * stts[:, 1].astype(float)).sum() >= 1 << 62:
        raise ValueError("the duration is out of range")
    return {"codec": codec, "handler": handler, "timescale": timescale, "duration": int((stts[:, 0] * stts[:, 1]).sum()) or duration, "n_samples": n, "n_keyframes": n_keyframes, "media_bytes": int(bytes_before(np.int64(n))), "keyframe_ranges": [{"first_byte": int(x), "end_byte": int(y)} for x, y in zip(lo[new], ends, strict=True)], "error": None}


def probe(media: bytes | None) -> list[dict]:
    """A row per track: codec, duration, counts and keyframe byte ranges; none for null.

    What is not a sound container gives one row with only error set.
    """
    if media is None:
        return []
    try:
        data, tracks = memoryview(media), {}
        for kind, track, a, b in walk(data, 0, len(data)):
            if track is not None:
                tracks.setdefault(track, {}).setdefault(kind, (a, b))
        if not tracks:
            raise ValueError("no track")
        return [probe_track(data, parts) for _, parts in sorted(tracks.items())]
    except (ValueError, KeyError, struct.error, IndexError) as e:
        return [{"error": f"{type(e).__name__}: {e}"[:200]}]


def read_back(media: bytes, ranges: list[dict]) -> bytes:
    return b"".join(media[r["first_byte"] : r["end_byte"]] for r in ranges)


def store_column(df: DataFrame, data: str, out: str) -> DataFrame:
    """Adds a container that holds each row's bytes, padded to a multiple of 64; null stays null."""
    return with_media(df, data, out)


def probe_column(df: DataFrame, media: str, out: str) -> DataFrame:
    """Adds an array with a struct per track; broken containers get one with an error, null gets none."""
    return with_tracks(df, media, out)


def added(df: DataFrame, by: str, fields: list[T.StructField], make) -> DataFrame:
    """Adds columns that make(bytes or None) gives as a tuple; columns of the same names are replaced."""
    names = {f.name for f in fields}
    held = T.StructType([f for f in df.schema.fields if f.name not in names] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [make(x) for x in batch.column(batch.schema.get_field_index(by)).to_pylist()]
        keep = [n for n in batch.schema.names if n not in names]
        new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + new, keep + [f.name for f in fields])

    return in_slices(df, by, work, held, 2 << 20)


def with_media(df: DataFrame, data: str, out: str) -> DataFrame:
    return added(df, data, [T.StructField(out, T.BinaryType())], lambda x: (None if x is None else store(padded(x)),))


def with_tracks(df: DataFrame, media: str, out: str) -> DataFrame:
    return added(df, media, [T.StructField(out, T.ArrayType(TRACK))], lambda x: (probe(x),))


def with_round_trip(df: DataFrame, data: str) -> DataFrame:
    """Adds media, its tracks, and the payload copied out of it at the ranges that its boxes give."""

    def make(x: bytes | None) -> tuple:
        if x is None:
            return None, [], None
        tracks = probe(media := store(padded(x)))
        return media, tracks, read_back(media, tracks[0]["keyframe_ranges"])

    return added(df, data, [T.StructField("media", T.BinaryType()), T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("payload", T.BinaryType())], make)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes through a container and back; the feature is what the boxes say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("bytes"))
    read = with_round_trip(docs.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), "bytes"), "bytes")
    t = F.col("tracks")[0]
    ranges = F.array_join(F.transform(t["keyframe_ranges"], lambda r: F.concat_ws("-", r["first_byte"], r["end_byte"])), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -PAD_TO, PAD_TO)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("codec="), t["codec"], F.lit(";rate="), t["timescale"], F.lit(";duration="), t["duration"], F.lit(";samples="), t["n_samples"], F.lit(";keyframes="), t["n_keyframes"], F.lit(";ranges="), ranges).alias("feature"),
    )
