"""Media columns: ISO base media containers written and walked box by box.

``store_media`` keeps a byte payload losslessly as uncompressed 8-bit frames in one video
track; ``read_media`` walks the nested boxes, decodes the sample tables of all tracks (sizes,
chunks, times, key frames) and what movie fragments add to them, and gives codec, duration and
the byte ranges of the key frames. It touches the payload only where
``read_back`` asks for it. Both work on any binary column, one row at a time, without a
shuffle.

Defined results: a null text is an empty payload; every payload is padded with bytes 32 to a
positive multiple of 192; a container that can't be walked gives a row with ``error`` set and
nulls elsewhere. Repeated rows give repeated results; equal payloads give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.common import Batcher

#: One frame: 16 x 12 grey samples of 8 bits.
WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
TIMESCALE = 25
FRAMES_A_CHUNK = 32
PAD = b"\x20"


def padded(payload: bytes, unit: int = FRAME) -> bytes:
    """The payload with spaces up to a positive multiple of ``unit``."""
    n = max(unit, -(-len(payload) // unit) * unit)
    return payload + PAD * (n - len(payload))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes) -> bytes:
    """An ISO media file with one raw grey video track; the length is a multiple of FRAME."""
    n = len(payload) // FRAME
    if n * FRAME != len(payload) or not n:
        raise ValueError(f"the payload has to be a positive multiple of {FRAME} bytes")
    chunks = -(-n // FRAMES_A_CHUNK)
    last = n - (chunks - 1) * FRAMES_A_CHUNK
    entry = _box(
        b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1),
        b"\0" * 32, struct.pack(">Hh", 40, -1),
    )
    runs = [(1, FRAMES_A_CHUNK, 1)] if chunks > 1 or last == FRAMES_A_CHUNK else []
    if last != FRAMES_A_CHUNK:
        runs.append((chunks, last, 1))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    wide = len(payload) + 4096 + 8 * chunks >= 1 << 32

    def moov(base: int) -> bytes:
        starts = base + np.arange(chunks, dtype=np.int64) * (FRAMES_A_CHUNK * FRAME)
        offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            offsets,
        )
        minf = _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            _full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"frames\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQ", 0, 0, 1, 0, n, 0), b"\0" * 8, _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    base = len(ftyp) + len(moov(0)) + head
    return b"".join((ftyp, moov(base), _box(b"mdat", payload)))


def walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of each box between two offsets, not of those inside."""
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            raise ValueError(f"box {kind!r} at {at} has length {n}")
        yield kind, at + head, at + n
        at += n


def _find(data: memoryview, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for kind, a, b in walk(data, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _find(data, a, b, *path[1:])
    return None


@dataclass
class Track:
    handler: str
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray
    #: Ticks that each sample lasts.
    durations: np.ndarray

    def ranges(self, which: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Byte ranges (start, end) of the chosen samples, neighbours merged."""
        starts, sizes = (self.offsets, self.sizes) if which is None else (self.offsets[which], self.sizes[which])
        if not len(starts):
            return []
        ends = starts + sizes
        cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
        return list(zip(starts[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist(), strict=True))


def _table(data: memoryview, stbl: tuple[int, int], kind: bytes, fields: int, width: str = ">u4") -> np.ndarray | None:
    at = _find(data, *stbl, kind)
    if at is None:
        return None
    n = struct.unpack_from(">I", data, at[0] + 4)[0]
    if at[0] + 8 + n * fields * np.dtype(width).itemsize > at[1]:
        raise ValueError(f"table {kind!r} is cut off")
    return np.frombuffer(data, width, n * fields, at[0] + 8).astype(np.int64).reshape(n, fields)


def _sizes(data: memoryview, stbl: tuple[int, int]) -> np.ndarray:
    """Sample sizes: all alike, 32 bits each, or packed in 4, 8 or 16 bits."""
    if (at := _find(data, *stbl, b"stsz")) is not None:
        fixed, n = struct.unpack_from(">II", data, at[0] + 4)
        if not fixed and at[0] + 12 + 4 * n > at[1]:
            raise ValueError("table b'stsz' is cut off")
        return np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at[0] + 12).astype(np.int64)
    if (at := _find(data, *stbl, b"stz2")) is None:
        raise ValueError("no sample sizes")
    width, n = data[at[0] + 7], struct.unpack_from(">I", data, at[0] + 8)[0]
    if width not in (4, 8, 16) or at[0] + 12 + -(-n * width // 8) > at[1]:
        raise ValueError("table b'stz2' can't be read")
    if width == 4:
        pairs = np.frombuffer(data, np.uint8, -(-n // 2), at[0] + 12)
        return np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, ">u1" if width == 8 else ">u2", n, at[0] + 12).astype(np.int64)


def _samples(data: memoryview, stbl: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Offsets, sizes, key frames and durations of a track's samples by its tables."""
    none = np.zeros(0, np.int64)
    sizes = _sizes(data, stbl)
    n = len(sizes)
    starts = _table(data, stbl, b"stco", 1)
    if starts is None:
        starts = _table(data, stbl, b"co64", 1, ">u8")
    stsc, stts = _table(data, stbl, b"stsc", 3), _table(data, stbl, b"stts", 2)
    if starts is None or stsc is None or stts is None:
        raise ValueError("no chunk or time tables")
    if not n:
        return none, none, none, none
    starts = starts[:, 0]
    per_chunk = np.repeat(stsc[:, 1], np.diff(np.r_[stsc[:, 0] - 1, len(starts)]))
    if per_chunk.sum() != n or stts[:, 0].sum() != n:
        raise ValueError(f"chunks hold {per_chunk.sum()} samples, times {stts[:, 0].sum()}, sizes are {n}")
    first = np.r_[0, np.cumsum(per_chunk)[:-1]]  # first sample of each chunk
    before = np.r_[0, np.cumsum(sizes)]
    offsets = np.repeat(starts - before[first], per_chunk) + before[:-1]
    sync = _table(data, stbl, b"stss", 1)
    return offsets, sizes, np.arange(n) if sync is None else sync[:, 0] - 1, np.repeat(stts[:, 1], stts[:, 0])


#: Flags of fragment boxes: which optional fields stand there (fixed values of ISO/IEC 14496-12).
_TFHD_BASE, _TFHD_ENTRY, _TFHD_DURATION, _TFHD_SIZE, _TFHD_FLAGS, _TFHD_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
_TRUN_OFFSET, _TRUN_FIRST, _TRUN_DURATION, _TRUN_SIZE, _TRUN_FLAGS, _TRUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
_NOT_SYNC = 0x10000


def _fragments(data: memoryview, defaults: dict[int, tuple[int, int, int]]) -> dict[int, list[np.ndarray]]:
    """Of each track number: rows (offset, size, key frame, duration) of its samples in fragments."""
    out: dict[int, list[np.ndarray]] = {}
    begin, after = 0, 0  # boxes follow each other, whatever the size of their heads
    for kind, a, b in walk(data, 0, len(data)):
        begin, after = after, b
        if kind != b"moof":
            continue
        moof, end = begin, None  # where the fragment begins; where the data of the track before ended
        for inner, c, d in walk(data, a, b):
            if inner != b"traf":
                continue
            head = _find(data, c, d, b"tfhd")
            if head is None:
                raise ValueError("a fragment lacks tfhd")
            flags, track = struct.unpack_from(">II", data, head[0])
            flags, at = flags & 0xFFFFFF, head[0] + 8
            base = moof if end is None or flags & _TFHD_MOOF else end
            if flags & _TFHD_BASE:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(flags & _TFHD_ENTRY)
            own = list(defaults.get(track, (0, 0, 0)))
            for k, bit in enumerate((_TFHD_DURATION, _TFHD_SIZE, _TFHD_FLAGS)):
                if flags & bit:
                    own[k], at = struct.unpack_from(">I", data, at)[0], at + 4
            end = base
            for run, e, f in walk(data, c, d):
                if run != b"trun":
                    continue
                flags, n = struct.unpack_from(">II", data, e)
                flags, at, start, first = flags & 0xFFFFFF, e + 8, end, None
                if flags & _TRUN_OFFSET:
                    start, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                if flags & _TRUN_FIRST:
                    first, at = struct.unpack_from(">I", data, at)[0], at + 4
                present = [bit for bit in (_TRUN_DURATION, _TRUN_SIZE, _TRUN_FLAGS, _TRUN_SHIFT) if flags & bit]
                if at + 4 * n * len(present) > f:
                    raise ValueError("table b'trun' is cut off")
                fields = np.frombuffer(data, ">u4", n * len(present), at).astype(np.int64).reshape(n, len(present))
                duration, size, marks = (fields[:, present.index(bit)] if bit in present else np.full(n, own[k], np.int64) for k, bit in enumerate((_TRUN_DURATION, _TRUN_SIZE, _TRUN_FLAGS)))
                if first is not None and n:
                    marks = np.r_[first, marks[1:]]
                offsets = start + np.r_[0, np.cumsum(size)[:-1]] if n else np.zeros(0, np.int64)
                end = start + int(size.sum())
                out.setdefault(track, []).append(np.stack((offsets, size, (marks & _NOT_SYNC) == 0, duration), 1))
    return out


def read_tracks(media: bytes) -> list[Track]:
    """Walk a container and decode the sample tables of its tracks, and what fragments add to them."""
    data = memoryview(media)
    moov = _find(data, 0, len(data), b"moov")
    if moov is None:
        raise ValueError("no moov box")
    defaults: dict[int, tuple[int, int, int]] = {}
    if (mvex := _find(data, *moov, b"mvex")) is not None:
        for kind, a, _ in walk(data, *mvex):
            if kind == b"trex":
                number, _, *own = struct.unpack_from(">IIIII", data, a + 4)
                defaults[number] = tuple(own)
    more, tracks = _fragments(data, defaults), []
    for kind, a, b in walk(data, *moov):
        if kind != b"trak":
            continue
        tkhd, mdhd, hdlr = _find(data, a, b, b"tkhd"), _find(data, a, b, b"mdia", b"mdhd"), _find(data, a, b, b"mdia", b"hdlr")
        stbl = _find(data, a, b, b"mdia", b"minf", b"stbl")
        if tkhd is None or mdhd is None or hdlr is None or stbl is None:
            raise ValueError("a track lacks tkhd, mdhd, hdlr or stbl")
        number = struct.unpack_from(">I", data, tkhd[0] + (20 if data[tkhd[0]] == 1 else 12))[0]
        timescale = struct.unpack_from(">I", data, mdhd[0] + (20 if data[mdhd[0]] == 1 else 12))[0]
        stsd = _find(data, *stbl, b"stsd")
        codec = bytes(data[stsd[0] + 12 : stsd[0] + 16]).decode("latin-1") if stsd else ""
        offsets, sizes, keys, durations = _samples(data, stbl)
        if rows := more.get(number):
            late = np.concatenate(rows)
            keys = np.r_[keys, len(sizes) + np.flatnonzero(late[:, 2])]
            offsets, sizes, durations = np.r_[offsets, late[:, 0]], np.r_[sizes, late[:, 1]], np.r_[durations, late[:, 3]]
        if len(offsets) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        tracks.append(Track(bytes(data[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1"), codec, timescale, int(durations.sum()), offsets, sizes, keys, durations))
    return tracks


def read_back(media: bytes, track: Track) -> bytes:
    """The bytes of all samples of a track, in order."""
    return b"".join(media[a:b] for a, b in track.ranges())


def feature(track: Track) -> str:
    """Codec, duration and key-frame ranges as text."""
    keys = ",".join(f"{a}-{b}" for a, b in track.ranges(track.keyframes))
    return f"handler={track.handler};codec={track.codec.strip()};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={len(track.keyframes)};ranges={keys}"


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as UTF-8, padded and kept in a container."""
    kind = dict(df.dtypes)[id_col]
    schema = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                payload = text.as_py() or b""
                media = write_container(padded(payload))
                yield from out.add((key, len(payload), media), len(media))
        yield out.flush()

    wide = df.selectExpr(f"cast(`{id_col}` as string) as id", f"`{text_col}` as text").mapInArrow(write, "id string, n_bytes long, media binary")
    return wide.selectExpr(f"cast(id as {kind}) as `{id_col}`", "n_bytes", "media")


def read_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of (id, n_bytes, media): what the container holds, with the payload's digests.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, codec, duration_s, keyframe_ranges, feature, error; these are the first track's.
    tracks has handler, codec, duration_s and keyframe_ranges of every track.
    """
    kind = dict(df.dtypes)[id_col]
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([
        ("id", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframe_ranges", ranges), ("feature", pa.string()), ("error", pa.string()), ("tracks", pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframe_ranges", ranges)]))),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for batch in batches:
            for key, n, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = stored.as_py()
                try:
                    tracks = read_tracks(media or b"")
                    track = tracks[0]  # the payload is the first track's; the others are in ``tracks``
                    payload = read_back(media, track)
                    others = [(x.handler, x.codec.strip(), x.duration / max(1, x.timescale), [{"start": a, "end": b} for a, b in x.ranges(x.keyframes)]) for x in tracks]
                    others = [dict(zip(("handler", "codec", "duration_s", "keyframe_ranges"), x, strict=True)) for x in others]
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), track.codec.strip(), track.duration / max(1, track.timescale), [{"start": a, "end": b} for a, b in track.ranges(track.keyframes)], feature(track), None, others)
                except (ValueError, IndexError, struct.error) as e:
                    row = (None,) * 9 + (str(e)[:200] or "can't be walked", None)
                yield from out.add((key, n, *row), 512)
        yield out.flush()

    wide = df.selectExpr(f"cast(`{id_col}` as string) as id", "n_bytes", "media").mapInArrow(
        read,
        "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, keyframe_ranges array<struct<start:bigint,end:bigint>>, feature string, error string, tracks array<struct<handler:string,codec:string,duration_s:double,keyframe_ranges:array<struct<start:bigint,end:bigint>>>>",
    )
    return wide.selectExpr(f"cast(id as {kind}) as `{id_col}`", *[f"`{c}`" for c in wide.columns[1:]])
