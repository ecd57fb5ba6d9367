"""Media columns: MPEG audio.  Bytes go losslessly into a playable (silent) MPEG-1 layer III stream and come back.

Method: the reader resynchronises on frame headers (a header counts if its fields are possible and if it goes on where a
frame of the same kind has ended, or one of the same kind, or the end, follows where it says), parses the tag before and after the stream and the variable-bitrate table, verifies the
checksum of each layer III frame, and stores the exact duration (samples and rate) and the byte offset of each frame.

The writer makes an ID3v2.4 tag with the payload's length, a frame with the variable-bitrate table (frames, bytes, and
the hundred seek points), frames with a checksum, empty side information and the payload in their ancillary bytes, the
last with the lowest bitrate that holds the rest, and an ID3v1 tag.  The reader takes any layer and version for
durations and offsets, also with junk between frames, but doesn't verify checksums of layers I and II and reads only
frames and bytes of the table, not its seek points; payloads are read from layer III frames of this form.

Defined cases: null text counts as empty, and empty text has a payload of 64 zero bytes; media of any length go frame
by frame; null or foreign media have no payload (null) and what frames they have; equal texts give equal media; repeated
rows give a row each; an empty table gives an empty result; further columns are carried along, except those named as a
result column, which it replaces.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.scratch import bounded_batches

UNIT = 64
# Fixed values of the format: kbit/s by index, Hz by index, bytes of side information.
_RATES_1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_RATES_2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}


class Header(NamedTuple):
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    kbit: int
    hz: int
    length: int
    samples: int
    side: int

    @property
    def kind(self) -> tuple[int, int, bool, int]:
        return self.version, self.layer, self.checked, self.hz


@functools.lru_cache(1 << 12)
def _header(b: bytes) -> Header | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or b[3] & 3 == 2:
        return None
    kbit, hz, pad = (_RATES_1 if version == 3 else _RATES_2)[layer][rate - 1], _HZ[version][hz], b[2] >> 1 & 1
    if layer == 1:
        samples, length = 384, (12000 * kbit // hz + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * 1000 * kbit // hz + pad
    return Header(version, layer, not b[1] & 1, kbit, hz, length, samples, _SIDE[version == 3, b[3] >> 6 == 3] if layer == 3 else 0)


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


@functools.lru_cache(1 << 12)
def crc16(b: bytes) -> int:
    """The format's checksum, of the last two header bytes and the side information."""
    c, table = 0xFFFF, _crc_table()
    for x in b:
        c = (c << 8 ^ table[c >> 8 ^ x]) & 0xFFFF
    return c


def _frame_head(rate: int) -> bytes:
    head = bytes([0xFF, 0xFA, rate << 4, 0xC0])  # MPEG-1 layer III, checked, 44100 Hz, mono
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_HEADS = [b"", *map(_frame_head, range(1, 15))]
_ROOM = [0, *(_header(h[:4]).length - len(h) for h in _HEADS[1:])]


def _safe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_mpeg(payload: bytes) -> bytes:
    """A stream that holds ``payload``."""
    said = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _safe(len(said)) + b"\0\0" + said
    tag = b"ID3\x04\0\0" + _safe(len(tag)) + tag
    frames, at, top = [], 0, len(_ROOM) - 1
    while at < len(payload):
        rest = len(payload) - at
        rate = top if rest >= _ROOM[top] else next(r for r in range(1, top + 1) if _ROOM[r] >= rest)
        frames.append(_HEADS[rate] + payload[at : at + _ROOM[rate]].ljust(_ROOM[rate], b"\0"))
        at += _ROOM[rate]
    first = _HEADS[5]
    ends, total = [], _ROOM[5] + len(first)
    for f in frames:
        ends.append(total)
        total += len(f)
    toc = bytes(min(255, 256 * ends[i * len(frames) // 100] // total) if frames else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([tag, first, table.ljust(_ROOM[5], b"\0"), *frames, b"TAG" + b"payload".ljust(125, b"\0")])


class Media(NamedTuple):
    payload: bytes | None
    frames: int
    samples: int
    hz: int
    offsets: list[int]
    bad_checksums: int
    skipped: int
    table_frames: int | None
    table_bytes: int | None

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.hz if self.hz else 0


def _tags(b: bytes) -> tuple[int, int, int | None]:
    """Where the stream begins and ends, and the payload's length that the tag before it gives."""
    at, end, said = 0, len(b), None
    while b[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((x & 127) << s for x, s in zip(b[at + 6 : at + 10], (21, 14, 7, 0)))
        i, stop = at + 10, min(end, at + 10 + size)
        while i + 10 <= stop and b[i] >= 65:
            n = sum((x & 127) << s for x, s in zip(b[i + 4 : i + 8], (21, 14, 7, 0)))
            name, _, value = b[i + 11 : i + 10 + n].partition(b"\0")
            if b[i : i + 4] == b"TXXX" and name == b"payload_bytes" and value.isdigit():
                said = int(value)
            i += 10 + n
        at = min(end, at + 10 + size + 10 * (b[at + 5] >> 4 & 1))
    if end - at >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
    return at, end, said


def read_mpeg(b: bytes) -> Media:
    """What a stream has."""
    at, end, said = _tags(b)
    offsets, parts, samples, hz, bad, skipped, table_frames, table_bytes = [], [], 0, 0, 0, 0, None, None
    before = None  # the kind of the frame that ends here
    while at + 4 <= end:
        h = _header(b[at : at + 4])
        known = h is not None and before == h.kind
        if h is not None and not known and at + h.length + 4 <= end:
            after = _header(b[at + h.length : at + h.length + 4])
            known = after is not None and after.kind == h.kind
        elif h is not None:
            known = True
        if not known or at + h.length > end:
            before = None
            new = b.find(b"\xff", at + 1, end)
            new = end if new < 0 else new
            skipped += new - at
            at = new
            continue
        before = h.kind
        side = at + 4 + 2 * h.checked
        body = side + h.side
        if h.layer == 3 and h.checked:
            bad += crc16(b[at + 2 : at + 4] + b[side:body]) != int.from_bytes(b[at + 4 : at + 6], "big")
        if not offsets and table_frames is None and h.layer == 3 and b[body : body + 4] in (b"Xing", b"Info"):
            flags, i = int.from_bytes(b[body + 4 : body + 8], "big"), body + 8
            if flags & 1:
                table_frames, i = int.from_bytes(b[i : i + 4], "big"), i + 4
            if flags & 2:
                table_bytes = int.from_bytes(b[i : i + 4], "big")
        elif not offsets and table_frames is None and h.layer == 3 and b[at + 36 : at + 40] == b"VBRI":
            table_bytes, table_frames = struct.unpack(">II", b[at + 46 : at + 54])
        else:
            offsets.append(at)
            samples, hz = samples + h.samples, hz or h.hz
            if h.layer == 3 and said is not None:
                parts.append(b[body : at + h.length])
        at += h.length
    skipped += max(0, end - at)
    payload = b"".join(parts) if said is not None else None
    payload = None if payload is None or len(payload) < said else payload[:said]
    return Media(payload, len(offsets), samples, hz, offsets, bad, skipped, table_frames, table_bytes)


def feature(m: Media) -> str:
    seek = zlib.crc32(struct.pack(f"<{len(m.offsets)}q", *m.offsets))
    return f"hz={m.hz};frames={m.frames};samples={m.samples};duration_us={m.duration_us};table_frames={m.table_frames};table_bytes={m.table_bytes};bad_checksums={m.bad_checksums};skipped={m.skipped};seek_crc32={seek}"


_FIELDS = "media_frames int, media_samples long, media_hz int, duration_us long, seek_offsets array<long>, bad_checksums int, skipped_bytes long, feature string"


def store(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``), ``n_bytes`` and the stored form ``media``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "media")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(place)[i].as_py() or "").encode()
                media = write_mpeg(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([len(raw)], pa.int64()), pa.array([media], pa.binary())], [*batch.schema.names, "n_bytes", "media"])

    return docs.mapInArrow(_gathered(run), docs.select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


def _gathered(run):
    """Puts the rows that ``run`` makes together to batches of some megabytes."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 1 << 22:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    return out


def load(df: DataFrame, payload: bool = True) -> DataFrame:
    """All columns of ``df`` (which needs ``media``), what the media have, and digests of the payload as read back
    (``payload`` adds the bytes themselves)."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", *(f.split()[0] for f in _FIELDS.split(", ")), *["payload"] * payload]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    df = df.drop(*names)
    place, rest = df.columns.index("media"), [i for i, c in enumerate(df.columns) if c != "media" or payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(place):
                media = x.as_py()
                m = read_mpeg(media or b"")
                p = m.payload
                own = (None, None, None) if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]))
                of = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                rows.append((*own, *of, m.frames, m.samples, m.hz, m.duration_us, m.offsets, m.bad_checksums, m.skipped, feature(m), *[p] * payload))
            made = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *made], [*(batch.schema.names[i] for i in rest), *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "media" or payload)
    return df.mapInArrow(run, f"{head}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, {_FIELDS}" + ", payload binary" * payload)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    media = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    return load(media, payload=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
