"""WARC archives: pages written as records, equal payloads as revisits, and read back by a reader that salvages what it can.

Writing.  Which record of equal payloads is the response is decided by an aggregation over digests (128 of the 256 bits of
SHA-2, and the length), so texts that many pages share don't meet anywhere.  Each task writes gzip files of one
member a record into the shared folder, a new file every ``ROLL`` bytes.  A file is written under a hidden name of its
own attempt and moved when it is complete; what counts is the table of files that the successful attempts return, so a lost
executor or a second attempt leaves neither half files nor records twice.

Reading.  Salvage: at each place a member is decompressed and its checksum and length verified, or a plain record is read;
the record's framing (version line, headers, length, end) and its block digest are verified as well.  After a failed check
the reader searches for the next place where a whole member or a version line with a sound record stands, goes on from there, and
logs the bytes between as a gap with the reason.  If only a record's contents are damaged and its framing is sound, just that
record is the gap.  A task streams its files through a window of ``CHUNK`` bytes and holds one member at a time.  Digests are
of what was read, not what headers say, except for revisits, which have no payload of their own.

Known limit: where a damaged record holds whole records in its payload (an archive in an archive), those are found
instead.

Defined cases: a null payload is empty; rows with a null id are no other's response, they revisit one with an id if there is one, and are
read back with a null id; rows that repeat an id and a payload are responses alike; an empty table gives no archive and no rows; line feeds, blanks and other
control characters of an url are written as %XX; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.scratch import bounded_batches, cut, keep_only, scope, shared_dir, written

#: Bytes of a payload from which on it is written once; of a file; that the reader takes at once; of a record's headers at most.
LEAST, ROLL, CHUNK, HEADERS = 1000, 1 << 26, 1 << 18, 1 << 20
#: Bytes of a member that are taken first; most members are no longer.
PIECE = 1 << 12
#: A row holds no more.
MOST = (1 << 31) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
_ID = "urn:row:"


# Writing


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, date: str, headers: dict[str, str], block: bytes) -> bytes:
    """A WARC 1.1 record."""
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **headers, "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items()) + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def page_record(row_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """The response with this payload or, with ``refers_to``, the revisit of the record of that row."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), url or ""), "WARC-Payload-Digest": _sha1(payload), "Content-Type": "application/http;msgtype=response"}
    named = _ID + quote(str(row_id), safe="") if row_id is not None else f"urn:uuid:{uuid.uuid4()}"
    if refers_to is None:
        return record("response", named, date, headers, http + payload)
    return record("revisit", named, date, {**headers, "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_ID}{quote(str(refers_to), safe='')}>"}, http)


class Archives:
    """Files of gzip members in a folder, each there under its name only when it is complete."""

    def __init__(self, folder: str, name: str, date: str) -> None:
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.date = name, date
        self.out, self.at, self.records, self.made = None, 0, 0, 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.file = f"{self.name}-{self.made:05}-{uuid.uuid4().hex}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/_{self.file}", compression=None, buffer_size=CHUNK)  # members are made here
            self._put(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", self.date, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> tuple[str, int, int] | None:
        """Put the open file in its place: its name, bytes and pages."""
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(f"{self.folder}/_{self.file}", f"{self.folder}/{self.file}")
        done = (self.file, self.at, self.records)
        self.out, self.at, self.records, self.made = None, 0, 0, self.made + 1
        return done

    def drop(self) -> None:
        """Delete the file that isn't complete, if there is one."""
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(f"{self.folder}/_{self.file}")
            self.out = None


def first_of(pages: DataFrame, row_id: str, payload: str, least: int = LEAST) -> DataFrame:
    """``pages`` with ``refers_to``: the largest id with an equal payload of at least ``least`` bytes, if it is another."""
    known = set(pages.columns)
    key, size, top, own = (next(f"{n}_{i}" for i in range(len(known) + 1) if f"{n}_{i}" not in known) for n in ("key", "size", "top", "own"))
    data = F.coalesce(F.col(payload), F.lit("").cast(pages.schema[payload].dataType)).cast("binary")
    keyed = pages.withColumns({key: F.substring(F.unhex(F.sha2(data, 256)), 1, 16), size: F.octet_length(data)})
    # Ids and digests are kept, so payloads are read once for them and once to be written.
    light = cut(keyed.where(F.col(size) >= least).groupBy(key, size, F.col(row_id).alias(own)).agg(F.count("*").alias(top)))
    groups = light.groupBy(key, size).agg(F.max(own).alias(top), F.sum(top).alias("n")).where(f"n > 1 and `{top}` is not null").drop("n")
    revisits = light.drop(top).join(groups, [key, size]).where(~F.col(own).eqNullSafe(F.col(top))).select(F.col(key).alias("k"), F.col(size).alias("s"), own, top)
    on = (keyed[key] == revisits["k"]) & (keyed[size] == revisits["s"]) & keyed[row_id].eqNullSafe(revisits[own])
    # Hashed, so rows with payloads aren't sorted.
    return keyed.join(revisits.hint("shuffle_hash"), on, "left").select(*(keyed[c] for c in pages.columns if c != "refers_to"), revisits[top].alias("refers_to"))


def write(pages: DataFrame, folder: str, row_id: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """Write a record for each row and return the archives: ``path``, ``length`` (bytes) and ``pages``."""
    bounded_batches(pages.sparkSession)
    rows = first_of(pages.select(row_id, url, payload), row_id, payload, least).select(row_id, url, payload, "refers_to")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = None
        try:
            done = []
            for batch in batches:
                archives = archives or Archives(folder, f"part-{TaskContext.get().partitionId():05}", date)
                for i in range(batch.num_rows):
                    of, at, data, refers_to = (c[i].as_py() for c in batch.columns)
                    archives.add(page_record(of, at, data.encode() if isinstance(data, str) else data or b"", refers_to, date))
                    if archives.at >= ROLL:
                        done.append(archives.close())
            done += [archives.close()] if archives and archives.out else []
            if done:
                names, sizes, counts = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "length", "pages"])
        finally:
            if archives:
                archives.drop()

    return cut(rows.mapInArrow(run, "path string, length long, pages long"))


# Reading


class Broken(Exception):
    """What a check says; ``end`` is where the damage ends for certain, if that is known."""

    def __init__(self, reason: str, end: int | None = None) -> None:
        super().__init__(reason)
        self.end = end


@dataclass
class Found:
    """A record, or (without headers) a gap and its reason."""

    offset: int
    length: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str | None = None


class _Window:
    """Random reads of a file through one window."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + min(n, self.size - at) <= self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, 8 * CHUNK))
        return self.data[at - self.at : at - self.at + n]


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    """Names (lower case) and values of a record's headers, and where its block begins."""
    end = data.find(b"\r\n\r\n", 0, HEADERS)
    if not _VERSION.match(data):
        raise Broken("no version line")
    if end < 0:
        raise Broken("headers don't end")
    lines = re.sub(rb"\r\n[ \t]+", b" ", data[:end]).split(b"\r\n")[1:]
    if not all(re.match(rb"[!-9;-~]+[ \t]*:", x) for x in lines):
        raise Broken("no header line")
    named = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    if not re.fullmatch("[0-9]{1,18}", named.get("content-length", "")):
        raise Broken("no length")
    return named, end + 4


def _digest_fits(said: str, data: bytes) -> bool:
    """Whether a digest as headers give it is that of the data; algorithms that aren't known here count as fitting."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(name, data, usedforsecurity=False).digest()
    return value.strip().lower() == own.hex() or value.strip().upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _plain(w: _Window, at: int) -> Found:
    """The record that begins at this place of an uncompressed archive."""
    head = w.read(at, 1 << 13)
    if b"\r\n\r\n" not in head:
        head = w.read(at, HEADERS)
    headers, begin = _headers(head)
    length = int(headers["content-length"])
    end = at + begin + length + 4
    if length > MOST or end > w.size:
        raise Broken("record ends early")
    if w.read(end - 4, 4) != b"\r\n\r\n":
        raise Broken("record doesn't end where it says")
    block = w.read(at + begin, length)
    if not _digest_fits(headers.get("warc-block-digest", ""), block):
        after = w.read(end, 10)
        raise Broken("block digest doesn't fit", end if not after or _VERSION.match(after) or after.startswith(_MAGIC) else None)
    return Found(at, end - at, headers, block)


def _unpacked(w: _Window, at: int) -> list[Found]:
    """The records of the gzip member that begins at this place."""
    gz, data, pos, rest, piece = zlib.decompressobj(31), bytearray(), at, b"", min(PIECE, CHUNK)
    while not gz.eof:
        if not rest:
            rest, piece = w.read(pos, piece), min(2 * piece, CHUNK)
            pos += len(rest)
        if not rest:
            raise Broken("member ends early")
        try:
            data += gz.decompress(rest, CHUNK)
        except zlib.error as e:
            raise Broken("checksum of a member doesn't fit" if "check" in str(e) else "member is damaged") from e
        rest = gz.unconsumed_tail
        if len(data) >= 5 and not data.startswith(b"WARC/"):
            raise Broken("member holds no record")
        if len(data) > MOST:
            raise Broken("member holds more than a row can")
    end, out, begin = pos - len(gz.unused_data), [], 0
    data = bytes(data)
    while begin < len(data):
        try:
            headers, size = _headers(data[begin : begin + HEADERS])
            stop = begin + size + int(headers["content-length"])
            if data[stop : stop + 4] != b"\r\n\r\n":
                raise Broken("record doesn't end where it says")
            block = data[begin + size : stop]
            if not _digest_fits(headers.get("warc-block-digest", ""), block):
                raise Broken("block digest doesn't fit")
            out.append(Found(at, end - at, headers, block))
            begin = stop + 4
        except Broken as e:  # the member itself is sound, so the next begins at its end
            out.append(Found(at, end - at, reason=str(e)))
            break
    return out


def _next(w: _Window, at: int) -> int:
    """The first place from ``at`` on where a member or a version line may begin."""
    while at < w.size:
        data = w.read(at, CHUNK)
        version = _VERSION.search(data)
        places = [p for p in (data.find(_MAGIC), version.start() if version else -1) if p >= 0]
        if places:
            return at + min(places)
        if len(data) < CHUNK:
            break
        at += CHUNK - 9  # a mark can stand across the end
    return w.size


def salvage(file: BinaryIO, size: int) -> Iterator[Found]:
    """All sound records of an archive (gzip members, plain records, or both) and the gaps between, in order."""
    w, at, lost, reason = _Window(file, size), 0, None, ""
    while at < size:
        try:
            mark = w.read(at, 3)
            if mark == _MAGIC:
                found = _unpacked(w, at)
            elif mark == b"WAR":
                found = [_plain(w, at)]
            else:
                raise Broken("neither member nor version line")
        except Broken as e:
            lost, reason = (at, str(e)) if lost is None else (lost, reason)
            if e.end:
                yield Found(lost, e.end - lost, reason=reason)
                at, lost = e.end, None
            else:
                at = _next(w, at + 1)
            continue
        if lost is not None:
            yield Found(lost, at - lost, reason=reason)
            lost = None
        yield from found
        at += found[0].length if found else 1
    if lost is not None:
        yield Found(lost, size - lost, reason=reason)


def payload_of(x: Found) -> tuple[bytes | None, int, str | None]:
    """A record's payload (null for a revisit), its length and its SHA-1 in lower-case hex."""
    http = x.headers.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    head, _, body = x.block.partition(b"\r\n\r\n") if http else (b"", b"", x.block)
    if x.headers.get("warc-type") != "revisit":
        return body, len(body), hashlib.sha1(body).hexdigest()
    said, length = x.headers.get("warc-payload-digest", ""), re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})", head)
    value = said.partition(":")[2].strip() if said.lower().startswith("sha1:") else ""
    with contextlib.suppress(ValueError):
        value = base64.b32decode(value, casefold=True).hex() if len(value) == 32 else value.lower()
    return None, int(length[1]) if length else 0, value or None


def _row_of(record_id: str | None) -> str | None:
    """The id of a row that was written by :func:`write`."""
    return unquote(record_id[len(_ID) + 1 : -1]) if record_id and record_id.startswith(f"<{_ID}") else None


_READ = "path string, offset long, length long, reason string, record_type string, record_id string, row_id string, uri string, refers_to string, payload_bytes long, payload_digest string"


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives ``files`` (``path`` and ``length``; and ``content`` where only Spark can open the
    path, as ``spark.read.format("binaryFile")`` gives it).  A gap has a ``reason`` and no type; ``offset`` and ``length``
    are those of the member or plain record.  ``payload`` adds the bytes."""
    spark = files.sparkSession
    whole = "content" in files.columns
    files = files.select("path", "length", *["content"] * whole)
    if not whole:
        n, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        files = files.coalesce(1).repartition(max(1, total >> 27, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    names = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * payload
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), *[pa.binary()] * payload]

    def rows(path: str, file: BinaryIO, size: int) -> Iterator[tuple]:
        for x in salvage(file, size):
            if x.headers is None:
                yield (path, x.offset, x.length, x.reason, *[None] * (len(names) - 4))
                continue
            body, n_bytes, digest = payload_of(x)
            refers_to = x.headers.get("warc-refers-to")
            yield (path, x.offset, x.length, None, x.headers.get("warc-type"), x.headers.get("warc-record-id"), _row_of(x.headers.get("warc-record-id")), x.headers.get("warc-target-uri"), refers_to, n_bytes, digest, *[body] * payload)

    def opened(batch: pa.RecordBatch, i: int) -> tuple[str, BinaryIO, int]:
        path = batch.column(0)[i].as_py()
        if whole:
            return path, pa.BufferReader(batch.column(2)[i].as_buffer()), len(batch.column(2)[i].as_buffer())
        fs, at = pa.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
        return path, fs.open_input_file(at), batch.column(1)[i].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, file, length = opened(batch, i)
                with contextlib.closing(file):
                    for row in rows(path, file, length):
                        held.append(row)
                        size += 500 + (len(row[-1] or b"") if payload else 0)
                        if size > 1 << 22:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    return files.mapInArrow(run, _READ + ", payload binary" * payload)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = written(f"{shared_dir(spark)}/hushframe-{uuid.uuid4().hex}")
    with scope() as made:
        files = write(pages, folder, "page_id", "url", "html")
        keep_only(made, files)
    row: Callable = lambda c: F.col(c).cast("long")
    back = read(files, payload=False).where("record_type in ('response', 'revisit')")
    refers_to = F.when(F.col("record_type") == "revisit", F.regexp_extract("refers_to", f"^<{_ID}(.*)>$", 1))
    return back.select(row("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers_to.cast("long").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), m AS (
  SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
