"""Archives against brute force, damaged in every way, and on odd rows."""

import base64
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from hushframe.llm import op13_warc as op

DATE = "2020-01-01T00:00:00Z"


def pages(spark):
    long, other = "<p>" + "täglich " * 300, "x" * 1000
    rows = [
        (1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (9, "http://a/9", long), (3, "http://a/3", other), (4, "http://a/\r\nWARC-Type: fake b", other[:-1]), (5, "http://a/5", other[:-1]),
        (6, "", None), (7, "http://a/7", ""), (None, "http://a/0", long), (None, "http://a/0", long), (None, "u", "alone" * 900), (8, "http://a/8", "ä" * 500), (10, "http://a/10", "ä" * 500), (-4, "http://a/-4", "WARC/1.1\r\n\r\n" * 90 + "\x1f\x8b\x08"),
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, refers_to string, size int").repartition(3)


def brute(rows):
    top = {}
    for i, _, h, *_ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        to = top.get(h or "") if len(b) >= 1000 else None
        revisit = to is not None and to != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("roll", [op.ROLL, 500])
def test_round_trip(spark, tmp_path, roll, monkeypatch):
    monkeypatch.setattr(op, "ROLL", roll)
    df = pages(spark)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = op.op13_warc(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(df.collect())
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    files = op.write(df, f"file://{tmp_path}/out", "page_id", "url", "html")
    assert (files.count() > 3) == (roll == 500)
    back = op.read(files)
    assert back.where("reason is not null").count() == 0
    assert {r.uri for r in back.where("row_id = '4'").collect()} == {"http://a/%0D%0AWARC-Type:%20fake%20b"}
    texts = [(r.row_id, bytes(r.payload).decode()) for r in back.where("record_type = 'response'").collect()]
    assert sorted(texts, key=repr) == sorted(((None if r.page_id is None else str(r.page_id), r.html or "") for r in df.collect() if brute([*df.collect()]).count((r.page_id, len((r.html or "").encode()), hashlib.sha1((r.html or "").encode()).hexdigest(), "response", None))), key=repr)
    content = spark.read.format("binaryFile").load(f"{tmp_path}/out")
    assert sorted(map(repr, op.read(content).drop("path").collect())) == sorted(map(repr, back.drop("path").collect()))


def test_nothing(spark, tmp_path):
    files = op.write(pages(spark).limit(0), f"file://{tmp_path}/out", "page_id", "url", "html")
    assert files.count() == 0 and op.read(files).count() == 0


def test_ids_of_text(spark, tmp_path):
    df = spark.createDataFrame([("a b>", "u", "y" * 2000), ("z/ü", "u", "y" * 2000)], "k string, u string, t string")
    got = op.read(op.write(df, f"file://{tmp_path}/out", "k", "u", "t")).where("record_type <> 'warcinfo'")
    assert {(r.row_id, r.record_type) for r in got.collect()} == {("a b>", "revisit"), ("z/ü", "response")}


def sound(i, size=3000):
    draw = random.Random(i)
    return op.page_record(i, f"http://a/{i}", bytes(draw.randrange(256) for _ in range(size)), None, DATE)


def read(data):
    """Ids of records, and gaps; each byte belongs to one of them."""
    found, at = [], 0
    for x in op.salvage(io.BytesIO(data), len(data)):
        assert x.offset == at
        at += x.length
        found.append((x.offset, x.length, x.reason) if x.headers is None else int(x.headers["warc-record-id"][len("<urn:row:") : -1]))
    assert at == len(data)
    return found


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("chunk", [op.CHUNK, 1000])
def test_damage(packed, chunk, monkeypatch):
    """Whatever happens to one record, all others are read and the gap is just where it was."""
    monkeypatch.setattr(op, "CHUNK", chunk)
    parts = [op.member(sound(i)) if packed else sound(i) for i in range(5)]
    at, n = sum(map(len, parts[:2])), len(parts[2])
    whole = b"".join(parts)
    assert read(whole) == [0, 1, 2, 3, 4]
    for where in [0, 3, 9, 12, n // 3, n // 2, n - 7, n - 2]:
        harmed = bytearray(whole)
        harmed[at + where] ^= 0xFF
        got = read(bytes(harmed))
        if got != [0, 1, 2, 3, 4]:  # a byte of a header that nothing checks
            (gap,) = [x for x in got if isinstance(x, tuple)]
            assert gap[:2] == (at, n) and [x for x in got if x != gap] == [0, 1, 3, 4], where
        else:
            assert where in (3, 9, 12)
    for lost in (1, 100, n - 1):  # cut short
        harmed = whole[: at + n - lost] + whole[at + n :]
        got = [x for x in read(harmed) if not isinstance(x, tuple)]
        assert got in ([0, 1, 3, 4], [0, 1, 2, 3, 4])
    junk = b"junk \r\nWARC/1.0\r\nno record" + op._MAGIC + b"neither"
    assert read(whole[:at] + junk + whole[at:]) == [0, 1, (at, len(junk), "neither member nor version line"), 2, 3, 4]
    assert read(junk + whole)[1:] == [0, 1, 2, 3, 4] and read(whole + junk)[:5] == [0, 1, 2, 3, 4]
    assert read(whole[:-5])[:4] == [0, 1, 2, 3]
    assert read(b"") == [] and len(read(b"x" * 5000)) == 1


def test_member_of_several_records_and_both_kinds():
    bad = sound(7).replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:X")
    first = op.member(sound(0) + sound(1) + bad + sound(8))
    got = list(op.salvage(io.BytesIO(first + sound(2) + op.member(sound(3))), len(first) + len(sound(2)) + len(op.member(sound(3)))))
    assert [x.reason or x.headers["warc-record-id"] for x in got] == ["<urn:row:0>", "<urn:row:1>", "block digest doesn't fit", "<urn:row:2>", "<urn:row:3>"]


def test_lengths_that_lie():
    """A length that reaches beyond the file, or into the next record, hides nothing that follows."""
    record = sound(1)
    for said in (b"999999999999", b"3500", b"10", b"-1", b"x"):
        lying = record.replace(b"Content-Length: 3", b"Content-Length: 3", 1)
        at = lying.rindex(b"Content-Length: ", 0, lying.index(b"\r\n\r\n"))
        lying = lying[: at + 16] + said + lying[lying.index(b"\r\n", at) :]
        assert read(sound(0) + lying + sound(2))[-1] == 2
        assert read(op.member(sound(0)) + op.member(lying) + op.member(sound(2)))[-1] == 2


def test_digests_of_other_kinds():
    data = b"abc"
    for name in ("sha1", "SHA-256", "md5"):
        d = hashlib.new(name.replace("-", "").lower(), data).digest()
        for said in (d.hex(), d.hex().upper(), base64.b32encode(d).decode(), base64.b32encode(d).decode().rstrip("=")):
            assert op._digest_fits(f"{name}:{said}", data) and not op._digest_fits(f"{name}:{said}", data + b"d")
    assert op._digest_fits("crc99:1", data)


def test_an_attempt_that_ends_leaves_no_file(tmp_path):
    archives = op.Archives(f"file://{tmp_path}", "part-00000", DATE)
    archives.add(sound(1))
    assert [p.name[0] for p in tmp_path.iterdir()] == ["_"]
    archives.drop()
    assert not [*tmp_path.iterdir()]


def test_hot_payload(spark):
    """A third of all rows share a payload: their number alone meets in the aggregation."""
    df = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("h" * 1200)).otherwise(F.concat(F.lit("o" * 1000), (F.col("id") % 7000).cast("string"))).alias("t")).repartition(5)
    got = {r.id: r.refers_to for r in op.first_of(df, "id", "t").select("id", "refers_to").collect()}
    top = {}
    for i in range(30_000):
        top["h" if i % 3 == 0 else i % 7000] = i
    assert got == {i: None if (t := top["h" if i % 3 == 0 else i % 7000]) == i else t for i in range(30_000)}


def test_an_archive_is_read_about_once():
    """Members that are far smaller than the reader's window don't each have it read anew."""

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            got = super().read(n)
            self.total += len(got)
            return got

    whole = b"".join(op.member(sound(i)) for i in range(3000)) + op.member(op.record("response", "urn:row:9", DATE, {}, random.Random(1).randbytes(5 * op.CHUNK)))
    file = Counting(whole)
    assert sum(x.headers is not None for x in op.salvage(file, len(whole))) == 3001
    assert file.total < 3 * len(whole) + 16 * op.CHUNK
