"""Media columns: ISO base media containers, written, walked and read back.

`pack` stores a payload as the frames of a raw video track ('raw ', 8 x 8 pixels
of 8 bits) in an ISO media file: ftyp, moov with nested trak, mdia, minf and
stbl, then mdat.  Sync samples are the first frame, every frame after one with a
line feed, and every GROUP-th frame.  `inspect` walks the nested boxes of any such file,
decodes the sample tables (stts, stsc, stsz, stco or co64, stss) and returns
codec, duration and the byte ranges of the sync samples ("keyframes") without
decoding a payload; `payload` follows the same tables to the stored bytes.

Nulls: a null file gives null features.  A file without a movie box, or with a
truncated box, gives a ValueError in `inspect` and null features in
`features_of`.  Empty payloads have no samples and zero duration.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import trimmed

#: Boxes that hold boxes (fixed values of the format).
NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Frames a second, pixels along a frame's side, bytes of a frame.
RATE, SIDE, FRAME = 25, 8, 64
#: Frames between sync samples at most, and frames in each chunk of the container.
GROUP, CHUNK = 16, 256


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def _full(kind: bytes, flags: int, *body: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def sync_frames(data: bytes) -> np.ndarray:
    """Numbers (from 0) of the sync samples of a payload."""
    frames = -(-len(data) // FRAME)
    after = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) // FRAME + 1
    return np.union1d(np.arange(0, frames, GROUP), after[after < frames])


def pack(data: bytes, rate: int = RATE) -> bytes:
    """An ISO media file whose only track holds `data`; a last, incomplete frame stays short."""
    n = -(-len(data) // FRAME)
    chunks = -(-n // CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = len(data) >= 1 << 31
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", SIDE, SIDE, 72 << 16, 72 << 16), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1))
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or (chunks > 1 and last != CHUNK))
    whole = len(data) % FRAME == 0
    sizes = b"" if whole else np.minimum(FRAME, len(data) - FRAME * np.arange(n)).astype(">u4").tobytes()
    sync = (sync_frames(data) + 1).astype(">u4").tobytes()

    def movie(start: int) -> bytes:
        places = start + CHUNK * FRAME * np.arange(chunks, dtype=np.int64)
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">I", bool(n)), struct.pack(">II", n, 1) if n else b""),
            _full(b"stss", 0, struct.pack(">I", len(sync) // 4), sync),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, struct.pack(">II", FRAME if whole else 0, n), sizes),
            _full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, rate, n & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, n & 0xFFFFFFFF), bytes(8), bytes(8), UNITY, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = _full(b"mvhd", 0, struct.pack(">IIII", 0, 0, rate, n & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 256), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(movie(0)) + (16 if wide else 8)
    return ftyp + movie(head) + _box(b"mdat", data)


def walk(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, first byte of the body, end) of every box, parents first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("truncated box")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, start + size
        if kind in NESTED:
            yield from walk(data, body, start + size, name)
        start += size
    if not path and start != end:
        raise ValueError("truncated box")


def _table(data: bytes, at: int, fields: int) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, dtype=">u4", count=n * fields, offset=at + 8).astype(np.int64).reshape(n, fields)


def _tracks(data: bytes) -> list[dict]:
    found: list[dict] = []
    for path, at, end in walk(data):
        if path == "/moov/trak":
            found.append({})
        elif path.startswith("/moov/trak/") and found:
            found[-1][path.rpartition("/")[2]] = (at, end)
    return found


class Track:
    """Sample table of one track: where each sample is, how long, which are sync samples.

    A constant sample size (as raw frames have) is kept as one number.
    """

    def __init__(self, data: bytes, boxes: dict) -> None:
        at = boxes["mdhd"][0]
        version = data[at]
        self.scale, ticks = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
        self.codec = data[boxes["stsd"][0] + 12 : boxes["stsd"][0] + 16].decode("latin-1")
        stts = _table(data, boxes["stts"][0], 2)
        self.duration = int((stts[:, 0] * stts[:, 1]).sum()) / self.scale if self.scale else 0.0
        self.constant, self.count = struct.unpack_from(">II", data, boxes["stsz"][0] + 4)
        if not self.constant:
            self.sizes = np.frombuffer(data, dtype=">u4", count=self.count, offset=boxes["stsz"][0] + 12).astype(np.int64)
        if "co64" in boxes:
            at = boxes["co64"][0]
            self.places = np.frombuffer(data, dtype=">u8", count=struct.unpack_from(">I", data, at + 4)[0], offset=at + 8).astype(np.int64)
        else:
            self.places = _table(data, boxes["stco"][0], 1)[:, 0]
        stsc = _table(data, boxes["stsc"][0], 3)
        per = np.zeros(len(self.places), dtype=np.int64)
        if len(stsc):
            until = np.append(stsc[1:, 0], len(self.places) + 1)
            per = np.repeat(stsc[:, 1], until - stsc[:, 0])
        if per.sum() != self.count:
            raise ValueError("sample tables disagree")
        self.last = np.cumsum(per)
        self.per = per
        #: None: every sample is a sync sample (no stss box).
        self.sync = _table(data, boxes["stss"][0], 1)[:, 0] - 1 if "stss" in boxes else None

    def chunk_sizes(self) -> np.ndarray:
        if self.constant:
            return self.per * self.constant
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        return ends[self.last] - ends[self.last - self.per]

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges of sync samples; neighbouring ranges are merged."""
        if self.sync is None:
            starts, stops = self.places, self.places + self.chunk_sizes()
        else:
            sizes = np.full(self.count, self.constant, dtype=np.int64) if self.constant else self.sizes
            chunk = np.searchsorted(self.last, self.sync, side="right")
            ends = np.concatenate(([0], np.cumsum(sizes)))
            starts = self.places[chunk] + ends[self.sync] - ends[self.last[chunk] - self.per[chunk]]
            stops = starts + sizes[self.sync]
        out: list[list[int]] = []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if out and out[-1][1] == a:
                out[-1][1] = b
            elif b > a:
                out.append([a, b])
        return [(a, b) for a, b in out]


def inspect(data: bytes) -> list[Track]:
    """Tracks of a file, from its boxes alone."""
    tracks = [Track(data, boxes) for boxes in _tracks(data)]
    if not tracks:
        raise ValueError("no movie box")
    return tracks


def payload(data: bytes, track: int = 0) -> bytes:
    """Stored bytes of a track, chunk after chunk."""
    own = inspect(data)[track]
    return b"".join(data[a : a + n] for a, n in zip(own.places.tolist(), own.chunk_sizes().tolist(), strict=True))


def features_of(data: bytes | None) -> str | None:
    """Codec, duration, samples and keyframe ranges of each track as JSON; null for null or unreadable files."""
    if data is None:
        return None
    try:
        tracks = inspect(data)
    except (ValueError, KeyError, struct.error, IndexError):
        return None
    return json.dumps([{"codec": t.codec, "duration": round(t.duration, 6), "samples": int(t.count), "keyframes": t.keyframes()} for t in tracks], separators=(",", ":"))


def pad(data: bytes, to: int = 64) -> bytes:
    """data and zeros up to a positive multiple of `to`."""
    return data + bytes(-len(data) % to or (0 if data else to))


def store(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Adds each padded text (null: empty) as a media file; a clashing column is replaced."""
    kept = [c for c in df.columns if c != into]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + [f"`{into}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                made = pa.array([pack(pad((t or "").encode())) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [made], names=[*kept, into])

    return df.mapInArrow(trimmed(run), schema)


#: Columns that `digest` adds.
DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration double"


def digest(texts: pa.Array) -> Iterator[tuple]:
    """Stores, reads back and describes each text."""
    for text in texts.to_pylist():
        raw = (text or "").encode()
        media = pack(pad(raw))
        track = inspect(media)[0]
        back = payload(media)
        yield (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features_of(media), track.codec, track.duration)


def describe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's media form without keeping the files."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split() for f in DIGEST.split(",")]
        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = list(zip(*digest(part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, types[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[key] + [n for n, _ in names])

    return df.select(key, text).mapInArrow(trimmed(run), f"`{key}` {kind}, {DIGEST}")
