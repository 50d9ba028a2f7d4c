"""Media columns: ISO base media files built, stored, walked and probed without decoding payloads.

A document's bytes, padded with spaces to a positive multiple of 192, are the 8-bit samples of one raw audio track; 192 of them make an access
unit, 32 units a chunk, and every 16th unit counts as a keyframe. Files are written as a column of a staged table and probed as they are read back. The probe walks nested boxes
and decodes the sample tables of every track (stsd, stts, stsc, stsz or stz2, stco or co64, stss) and of its fragments (trex, tfhd, trun); codec, timescale,
duration and the byte ranges of keyframes are those of the first track that has samples; payload bytes are only sliced.

null text: empty. Broken and null files: null features and payload. Repeated rows are files of their own, with equal values; null doc_ids stay; an empty table gives an empty result;
other columns of the input are left out. A file is handled whole, so memory follows the largest text (about six times its bytes).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, stage, table

UNIT, PER_CHUNK, PER_KEY, RATE = 192, 32, 16, 8000
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (struct.pack(">I4s", 8 + len(body), kind) if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body))) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def write_media(payload: bytes) -> bytes:
    """An ISO media file whose one track holds ``payload`` (a positive multiple of 192 bytes) as raw 8-bit mono samples."""
    units = len(payload) // UNIT
    chunks, rest = -(-units // PER_CHUNK), units % PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1 or not rest) + [(chunks, rest, 1)] * bool(rest)
    keys = range(1, units + 1, PER_KEY)
    length = units * UNIT
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    wide = len(payload) > 2**32 - 2**20

    def moov(base: int) -> bytes:
        at = [base + k * PER_CHUNK * UNIT for k in range(chunks)]
        entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *at)) if wide else full(b"stco", struct.pack(f">I{chunks}I", chunks, *at)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), full(b"hdlr", struct.pack(">4x4s12x", b"soun"), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIHH8x", 0, 0, RATE, length, 0x10000, 0x100, 0), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    base = len(head) + len(moov(0)) + (16 if len(payload) >= 2**32 - 8 else 8)
    return head + moov(base) + box(b"mdat", payload)


def walk(data: bytes, at: int = 0, to: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, box start, body start, body end) of all boxes, outer before inner; 64-bit and to-the-end sizes included."""
    to = len(data) if to is None else to
    while at + 8 <= to:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = to if size == 0 else at + size
        if end < body or end > to:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield (*path, kind), at, body, end
        if kind in NESTS:
            yield from walk(data, body, end, (*path, kind))
        at = end


def numbers(data: bytes, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    """``n`` big-endian numbers; more than the file holds are an error."""
    return np.frombuffer(data, kind, n, at).astype(np.int64)


class Track:
    """Sample table of one track: byte range, duration and sync flag of every sample, fragments after the movie's own."""

    def __init__(self):
        self.boxes: dict[bytes, tuple[int, int]] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # start, size, duration, sync

    def read(self, data: bytes) -> None:
        """Header and movie tables."""
        at = {k: a for k, (a, _) in self.boxes.items()}
        count = lambda kind: int(numbers(data, at[kind] + 4, 1)[0])
        self.id = int(numbers(data, at[b"tkhd"] + (20 if data[at[b"tkhd"]] else 12), 1)[0]) if b"tkhd" in at else 0
        self.scale = int(numbers(data, at[b"mdhd"] + (20 if data[at[b"mdhd"]] else 12), 1)[0])
        self.codec = data[at[b"stsd"] + 12 : at[b"stsd"] + 16].decode("latin-1")
        if b"stsz" in at:
            same, units = numbers(data, at[b"stsz"] + 4, 2).tolist()
            size = np.full(units, same) if same else numbers(data, at[b"stsz"] + 12, units)
        elif b"stz2" in at:  # 4, 8 or 16 bits a size
            field, units = data[at[b"stz2"] + 7], int(numbers(data, at[b"stz2"] + 8, 1)[0])
            raw = numbers(data, at[b"stz2"] + 12, -(-units // 2) if field == 4 else units, {4: ">u1", 8: ">u1", 16: ">u2"}[field])
            size = np.stack([raw >> 4, raw & 15], 1).ravel()[:units] if field == 4 else raw
        else:
            size = np.zeros(0, np.int64)
        chunk = numbers(data, at[b"co64"] + 8, count(b"co64"), ">u8") if b"co64" in at else numbers(data, at[b"stco"] + 8, count(b"stco")) if b"stco" in at else size[:0]
        runs = numbers(data, at[b"stsc"] + 8, 3 * count(b"stsc")).reshape(-1, 3) if b"stsc" in at else np.zeros((0, 3), np.int64)
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1)))
        if per.sum() != len(size) or (len(per) and len(per) != len(chunk)):
            raise ValueError("sample tables do not agree")
        before = np.cumsum(size) - size
        head = np.cumsum(per) - per  # the first sample of each chunk
        start = np.repeat(chunk - before[head], per) + before if len(size) else size
        times = numbers(data, at[b"stts"] + 8, 2 * count(b"stts")).reshape(-1, 2) if b"stts" in at else np.zeros((0, 2), np.int64)
        lasts = np.repeat(times[:, 1], times[:, 0])
        if len(lasts) != len(size):
            raise ValueError("samples and durations do not agree")
        sync = np.ones(len(size), bool)
        if b"stss" in at:
            sync[:] = False
            sync[numbers(data, at[b"stss"] + 8, count(b"stss")) - 1] = True
        self.parts.append((start, size, lasts, sync))


def fragment(data: bytes, runs: list[int], head: int, base: int, defaults: tuple[int, int, int]):
    """Samples of a track fragment: ``head`` and ``runs`` are where the bodies of tfhd and trun begin, ``base`` the start of its moof, ``defaults`` duration, size and flags."""
    flags, at = int(numbers(data, head, 1)[0]) & 0xFFFFFF, head + 8
    if flags & 1:
        base, at = int(numbers(data, at, 1, ">u8")[0]), at + 8
    at += 4 * bool(flags & 2)
    given = list(defaults)
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            given[k], at = int(numbers(data, at, 1)[0]), at + 4
    pos = base
    for run in runs:
        flags, n = (int(x) for x in numbers(data, run, 2))
        at = run + 8
        if flags & 1:
            pos, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        first, at = (int(numbers(data, at, 1)[0]), at + 4) if flags & 4 else (None, at)
        fields = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
        table_ = numbers(data, at, n * len(fields)).reshape(n, len(fields))
        lasts, size, mark = (table_[:, fields.index(k)] if k in fields else np.full(n, given[k]) for k in range(3))
        mark = mark.copy()
        if first is not None and n:
            mark[0] = first
        start = pos + np.cumsum(size) - size
        pos += int(size.sum())
        yield start, size, lasts, mark & 0x10000 == 0


def probe_media(data: bytes) -> dict:
    """Codec, timescale, duration, keyframe byte ranges and all sample ranges of the first track with samples, from its tables alone; and how many tracks there are."""
    tracks, extends, moof, head, loose = [], {}, 0, None, []
    for path, box_at, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1].boxes.setdefault(kind, (a, b))
        elif kind == b"trex":
            who, _, *defaults = numbers(data, a + 4, 5).tolist()
            extends[who] = tuple(defaults)
        elif kind == b"moof":
            moof = box_at
        elif kind == b"tfhd":
            head = a
            loose.append((int(numbers(data, a + 4, 1)[0]), moof, head, []))
        elif kind == b"trun" and loose:
            loose[-1][3].append(a)
    for t in tracks:
        t.read(data)
    for who, base, head, runs in loose:
        t = next(t for t in tracks if t.id == who)
        t.parts += fragment(data, runs, head, base, extends.get(who, (0, 0, 0)))
    whole = [(t, [np.concatenate(x) for x in zip(*t.parts, strict=True)]) for t in tracks]
    track, (start, size, lasts, sync) = next((t, x) for t, x in whole if len(x[0]))
    if (start < 0).any() or (start + size).max() > len(data):
        raise ValueError("samples lie outside of the file")
    ranges = list(zip(start.tolist(), (start + size).tolist(), strict=True))
    return {"codec": track.codec, "timescale": track.scale, "duration": int(lasts.sum()), "keyframes": [ranges[k] for k in np.flatnonzero(sync)], "samples": ranges, "tracks": len(tracks)}


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text as a stored ISO media file."""

    def kernel(batch: pa.RecordBatch) -> dict:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "n_bytes": [len(x) for x in raw], "media": [write_media(padded(x)) for x in raw]}

    return mapped(docs.selectExpr(f"cast({id_col} as bigint) id", f"{text_col} text"), kernel, "id bigint, n_bytes bigint, media binary", "text")


def media_features(stored: DataFrame) -> DataFrame:
    """(id, n_bytes, codec, timescale, duration, keyframes, digests of payload and file) from the stored bytes; nulls where a file is broken or null."""

    def kernel(batch: pa.RecordBatch) -> dict:
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "timescale", "n_keyframes")
        rows = []
        for key, n, media in zip(batch.column("id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                got = probe_media(media or b"")
            except (ValueError, KeyError, struct.error, IndexError, StopIteration, RecursionError):
                rows.append((key, n, None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), *[None] * 5))
                continue
            payload = b"".join(media[a:b] for a, b in got["samples"])
            feature = f"{got['codec']};{got['duration']}/{got['timescale']};" + ",".join(f"{a}-{b}" for a, b in got["keyframes"])
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, got["codec"], got["duration"], got["timescale"], len(got["keyframes"])))
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return mapped(stored, kernel, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration bigint, timescale bigint, n_keyframes bigint", "media")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as an ISO media file, then probed from the stored bytes."""
    return media_features(stage(encode_media(table(spark, sf_dir, "documents")), "media"))
