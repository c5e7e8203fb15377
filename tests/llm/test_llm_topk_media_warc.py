import base64
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import media, topk, warc


@pytest.mark.parametrize("scale", [1, 10**6])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i) - 20, [float(x) for x in rng.normal(0, scale, 6)]) for i in range(300)]
    rows += [(50, rows[3][1]), (50, rows[4][1]), (777, rows[3][1]), (1000, None), (1050, [1.0, float("nan")] + [0.0] * 4), (1100, [1.0, None] + [0.0] * 4), (1150, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (1200, [0.0] * 6), (1250, [1.0, 2.0]), (1300, [3.0, 4.0]), (1350, [])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, id string").repartition(3)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (qi, q) in enumerate(good):
        if qi % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(good) if b != a and len(v) == len(q))[:5]
            want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    got = [tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_reading_stops_early_on_separated_lists():
    cells = np.zeros((4096, 4), np.int64)
    cells[:10] = 1000 + np.arange(10)[:, None]
    lists = topk.SortedLists(np.arange(4096), cells)
    (ids, scores), = lists.top(np.array([[1, 2, 3, 4]]), np.array([9]), 5, [np.zeros(0, np.int64)])
    assert ids.tolist() == [8, 7, 6, 5, 4] and scores.tolist() == [10 * (1000 + i) for i in (8, 7, 6, 5, 4)]


TEXTS = [None, "", "a", "x" * 192, "x" * 193, "é" * 5000, "a", "long " * 40000]


def test_media_round_trip(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id int, text string, media string")
    got = {r.doc_id: r for r in media.read_media(media.store_media(df)).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.error is None and r.codec == "raw" and r.duration_s == len(payload) / 192 / 25
        assert sum(x.end - x.start for x in r.keyframe_ranges) == len(payload)
    assert got[2][1:] == got[6][1:]
    assert media.read_media(media.store_media(df.limit(0))).count() == 0


def test_media_errors_and_sync_samples(spark):
    whole = media.write_container(b"\1" * 192 * 70)
    bad = [b"", b"junk", whole[:300], whole.replace(b"moov", b"moof", 1)]
    rows = media.read_media(spark.createDataFrame([(i, 0, bytearray(b)) for i, b in enumerate(bad)], "doc_id long, n_bytes long, media binary")).collect()
    assert all(r.error and r.feature is None for r in rows)
    table = struct.pack(">I4sII2I", 24, b"stss", 0, 2, 1, 65)
    at = whole.index(b"stbl") - 4
    grown = bytearray(whole)
    insert = at + struct.unpack_from(">I", whole, at)[0]
    grown[insert:insert] = table
    for name in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        k = grown.index(name) - 4
        struct.pack_into(">I", grown, k, struct.unpack_from(">I", grown, k)[0] + len(table))
    track = media.read_tracks(bytes(grown))[0]
    assert track.keyframes.tolist() == [0, 64] and len(track.ranges(track.keyframes)) == 2


def test_walk_reads_long_and_open_boxes():
    data = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + struct.pack(">I4s", 0, b"mdat") + b"xyz"
    assert list(media.walk(memoryview(data), 0, len(data))) == [(b"free", 16, 20), (b"mdat", 28, 31)]


def track(number, codec, stbl, handler=b"vide"):
    tkhd = media._full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), b"\0" * 60)
    mdhd = media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0x55C4, 0))
    stsd = media._full(b"stsd", struct.pack(">I", 1), media._box(codec, b"\0" * 16))
    return media._box(b"trak", tkhd, media._box(b"mdia", mdhd, media._full(b"hdlr", b"\0" * 4, handler, b"\0" * 12), media._box(b"minf", media._box(b"stbl", stsd, *stbl))))


def tables(sizes, starts, packed=None):
    """Sample tables of one chunk for each sample; times 1, 1, 5."""
    n = len(sizes)
    size = media._full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)) if packed is None else media._full(b"stz2", struct.pack(">II", packed[0], n), packed[1])
    return [size, media._full(b"stts", struct.pack(">IIIII", 2, n - 1, 1, 1, 5)), media._full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), media._full(b"stco", struct.pack(f">I{n}I", n, *starts)), media._full(b"stss", struct.pack(">II", 1, 2))]


def test_all_tracks_packed_sizes_and_times():
    sizes, starts = [3, 7, 5], [40, 50, 60]
    movie = media._box(b"moov", track(1, b"avc1", tables(sizes, starts)), track(2, b"mp4a", tables(sizes, starts, (4, bytes([0x37, 0x50]))), b"soun"), track(3, b"abcd", tables(sizes, starts, (16, struct.pack(">3H", *sizes)))))
    tracks = media.read_tracks(movie)
    assert [(t.handler, t.codec) for t in tracks] == [("vide", "avc1"), ("soun", "mp4a"), ("vide", "abcd")]
    for t in tracks:
        assert (t.sizes.tolist(), t.offsets.tolist(), t.durations.tolist(), t.duration, t.ranges(t.keyframes)) == (sizes, starts, [1, 1, 5], 7, [(50, 57)])
    short = media._box(b"moov", track(1, b"avc1", tables(sizes, [1, 2, 3])[:1] + tables(sizes, [1, 2, 3])[2:]))
    with pytest.raises(ValueError):  # without times
        media.read_tracks(short)
    with pytest.raises(ValueError):  # a sample outside the file
        media.read_tracks(media._box(b"moov", track(1, b"avc1", tables(sizes, [10**6] * 3))))


def test_fragments_add_samples():
    empty = [media._full(b"stsz", struct.pack(">II", 0, 0)), *(media._full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco"))]
    trex = media._full(b"trex", struct.pack(">IIIII", 1, 1, 9, 4, 0x10000))
    head = media._box(b"moov", track(1, b"avc1", empty), media._box(b"mvex", trex))
    run = media._full(b"trun", struct.pack(">IiI", 3, 200, 0), struct.pack(">3I", 4, 6, 8), flags=0x1 | 0x4 | 0x200)  # offset, first flags, sizes
    plain = media._full(b"trun", struct.pack(">I", 2))  # all by default, after the run before
    moof = media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 1)), run, plain))
    data = head + moof + media._box(b"mdat", b"\7" * 200)
    (t,) = media.read_tracks(data)
    start = len(head) + 200
    assert t.sizes.tolist() == [4, 6, 8, 4, 4] and t.offsets.tolist() == [start, start + 4, start + 10, start + 18, start + 22]
    assert t.durations.tolist() == [9] * 5 and t.keyframes.tolist() == [0]


def pages(spark):
    rng = random.Random(1)
    html = ["<p>a</p>", "", None, "é" * 100, "<p>" + "z" * 50_000, "only"]
    rows = [(i, f"http://h/{i} x\n", rng.choice(html), "x") for i in range(200)] + [(300, None, "alone", "x"), (None, "u", "<p>a</p>", "x"), (None, "u", "two", "x"), (None, "v", "two", "x"), (301, "w", "same", "x"), (301, "w", "same", "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives_round_trip(spark, min_bytes):
    rows, df = pages(spark)
    last = {}
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= min_bytes:
            last[raw] = max(last.get(raw, i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = raw in last and i != last[raw]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[raw] if again else None))
    got = warc.read_archives(warc.write_archives(df, min_bytes=min_bytes)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    full = warc.read_archives(warc.write_archives(df), with_payload=True).where("page_id = 300").first()
    assert bytes(full.payload) == b"alone" and full.url == "urn:page:300"
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def reader(raw):
    return pa.PythonFile(io.BytesIO(raw), "r")


class File:
    """A file in memory with the two calls that the reader makes."""

    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_zip_directories(tmp_path):
    out = io.BytesIO()
    records = [(i, f"u{i}", warc.record(i, f"u{i}", b"x" * i, "response", None)) for i in range(5)]
    warc.write_archive(out, iter(records))
    raw = out.getvalue()
    spans = warc.index(File(raw))
    assert [gzip.decompress(raw[a : a + n]) for a, n in spans] == [r[2] for r in records]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX]
        data = z.read(warc.DATA)
    plain = io.BytesIO()  # without an index, with a comment, the members are walked
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr(warc.DATA, data)
        z.comment = b"PK\5\6 not the end"
    assert [n for _, n in warc.index(File(plain.getvalue()))] == [n for _, n in spans]
    end = raw.rindex(b"PK\5\6")  # the same directory told by a ZIP64 end record
    entries, length, start = struct.unpack_from("<HII", raw, end + 10)
    far = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, length, start)
    wide = raw[:end] + far + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.index(File(wide)) == spans
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, data)
    with pytest.raises(ValueError):
        warc.index(File(packed.getvalue()))
    with pytest.raises(ValueError):
        warc.directory(File(b"nothing"))


def test_archives_of_other_writers(spark, tmp_path):
    """Several members by any name, plain ones too, an index deflated and gzipped, a member that no index names."""
    first, second, third = ([warc.record(i, f"u{i}", b"x" * i, "response", None) for i in range(a, a + 3)] for a in (0, 10, 20))
    at, lines, packed = 0, [], b""
    for i, raw in enumerate(first):
        one = gzip.compress(raw)
        lines.append(f'u{i} 2020 {json.dumps({"offset": str(at), "length": str(len(one)), "filename": "a.warc.gz"})}')
        at, packed = at + len(one), packed + one
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/a.warc.gz", packed)
        z.writestr("archive/b.warc", b"".join(second))
        z.writestr("archive/sub/c.warc.gz", b"".join(map(gzip.compress, third)))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()), zipfile.ZIP_DEFLATED)
    got = warc.read_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, i) for i in (0, 1, 2, 10, 11, 12, 20, 21, 22)]


def test_broken_archives_say_where(spark, tmp_path):
    good = gzip.compress(warc.record(1, "u", b"hello", "response", None))
    bad = {"cut": [("archive/d.warc.gz", good[:-20])], "none": [("readme.txt", b"")], "digest": [("archive/d.warc.gz", gzip.compress(warc.record(1, "u", b"hello", "response", None).replace(b"hello", b"jello")))]}
    for name, members in bad.items():
        path = tmp_path / f"{name}.wacz"
        with zipfile.ZipFile(path, "w") as z:
            for m in members:
                z.writestr(*m)
        with pytest.raises(Exception, match=f"{name}.wacz"):
            warc.read_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
