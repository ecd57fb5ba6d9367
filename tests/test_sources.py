"""Text of PDF files, and pictures decoded, hashed, made smaller and searched for a logo."""

import base64
import struct
import zlib

import numpy as np
import pytest

from hushframe.operators import pixels
from hushframe.sources import documents, pdf, sinks


def written(objects, more=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items()) + b"trailer\n<< /Root 1 0 R " + more + b">>\n%%EOF"


def stream(data, more=b"", length=None):
    return b"<< /Length %d %s>>\nstream\n" % (len(data) if length is None else length, more) + data + b"\nendstream"


def deflated(data, more=b""):
    return stream(zlib.compress(data), b"/Filter /FlateDecode " + more)


TREE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        3: b"<< /Type /Page /Contents [5 0 R] >>", 4: b"<< /Type /Page /Contents 6 0 R >>", 7: b"<< /Type /Font >>", 8: b"<< /Type /Font /ToUnicode 9 0 R >>",
        9: deflated(b"begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <00E9> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <D83DDE00>] endbfrange")}
ONE = rb"BT /F1 9 Tf (a \(b\) \351\\) Tj [(mail) -300 (a@b.) 20 (com)] TJ 0 -20 Td <6869> ' (x (y) z) Tj ET"
TWO = b"BT /F2 9 Tf <0003001000110012> Tj <00200021> Tj ET BI /W 1 ID (no) Tj EI"


@pytest.mark.parametrize("pack", [stream, deflated, lambda x: stream(x, length=3)])
def test_pdf_text(pack):
    text, info = pdf.read_pdf(written({**TREE, 5: pack(ONE), 6: pack(TWO), 10: rb"<< /Title (A \(t\)) /Author <FEFF00e90062> >>"}, b"/Info 10 0 R "))
    assert text == "a (b) é\\ mail a@b.com hi x (y) z\n\néABC x😀"
    assert info == {"pages": "2", "title": "A (t)", "author": "éb"}


def test_pdf_with_packed_objects():
    numbers = [1, 2, 3, 4, 7, 8]
    places, bodies = [], b""
    for n in numbers:
        places.append(b"%d %d" % (n, len(bodies)))
        bodies += TREE[n] + b" "
    head = b" ".join(places) + b" "
    packed = deflated(head + bodies, b"/Type /ObjStm /N %d /First %d " % (len(numbers), len(head)))
    assert pdf.read_pdf(written({20: packed, 9: TREE[9], 5: deflated(ONE), 6: deflated(TWO)}))[0].endswith("éABC x😀")


def test_pdf_without_text():
    assert pdf.read_pdf(b"")[0] == pdf.read_pdf(b"no pdf")[0] == pdf.FAILED
    assert pdf.read_pdf(written({**TREE, 5: stream(b""), 6: stream(b"0 0 m")}))[0] == pdf.NO_TEXT
    assert pdf.read_pdf(written({**TREE, 5: deflated(ONE)}, b"/Encrypt 9 0 R "))[0] == "[PDF document with 2 pages - text extraction failed]"
    assert pdf.read_pdf(written({**TREE, 5: stream(b"no zlib", b"/Filter /FlateDecode ")}))[0].endswith("extraction failed]")
    loop = {1: TREE[1], 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page >>"}
    assert pdf.read_pdf(written(loop)) == (pdf.NO_TEXT, {"pages": "1"})


def test_pdf_files(spark, tmp_path):
    lines = ["call (me) \\ now", "mail a@b.com", "", "naïve"]
    (tmp_path / "a.pdf").write_bytes(sinks.masked_pdf("\n".join(lines)))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    rows = {r["path"][-5:]: r for r in documents.parse(documents.read_documents(spark, str(tmp_path))).collect()}
    assert rows["a.pdf"]["text"] == "call (me) \\ now mail a@b.com naïve" and rows["a.pdf"]["info"] == {"pages": "1"}
    assert rows["b.pdf"]["text"] == pdf.FAILED and rows["b.pdf"]["error"] is None


def png(x, colour=2, kinds=(0,), palette=b""):
    """A PNG with the filters in turn, by their definition."""
    h, w, n = x.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw, x = bytearray(), x.astype(int).reshape(h, w * n)
    for y in range(h):
        kind = kinds[y % len(kinds)]
        raw.append(kind)
        for i in range(w * n):
            a = x[y, i - n] if i >= n else 0
            b = x[y - 1, i] if y else 0
            c = x[y - 1, i - n] if y and i >= n else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append(int(x[y, i] - (0, a, b, (a + b) // 2, near)[kind]) & 255)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


def bmp(x, bits=24):
    h, w, _ = x.shape
    pad = np.zeros((h, w, 1), np.uint8)
    body = x[::-1, :, ::-1] if bits == 24 else np.concatenate([x[::-1, :, ::-1], pad], 2)
    rows = b"".join(r.tobytes() + b"\0" * (-len(r.tobytes()) % 4) for r in body)
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(rows), 0, 54, 40, w, h, 1, bits, 0, len(rows), 0, 0, 0, 0) + rows


X = np.random.default_rng(5).integers(0, 256, (11, 13, 4), np.uint8)


def test_decoded():
    rgb = X[:, :, :3]
    for kinds in [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)]:
        assert (pixels.decoded(png(rgb, 2, kinds)) == rgb).all() and (pixels.decoded(png(X, 6, kinds)) == rgb).all()
        assert (pixels.decoded(png(X[:, :, :1], 0, kinds)) == X[:, :, :1]).all() and (pixels.decoded(png(X[:, :, :2], 4, kinds)) == X[:, :, :1]).all()
    palette = np.arange(768, dtype=np.uint32).astype(np.uint8).reshape(256, 3)
    assert (pixels.decoded(png(X[:, :, :1], 3, (2, 1), palette.tobytes())) == palette[X[:, :, 0]]).all()
    assert (pixels.decoded(bmp(rgb)) == rgb).all() and (pixels.decoded(bmp(rgb, 32)) == rgb).all()
    for broken in [None, b"", b"BM", png(rgb)[:40], png(rgb)[:60], bmp(rgb)[:-1], b"\xff\xd8\xff"]:
        assert pixels.decoded(broken) is None


def test_sizes():
    x = np.arange(16 * 24 * 3).reshape(16, 24, 3) % 251
    assert np.allclose(pixels.resized(x, 8, 8), x.reshape(8, 2, 8, 3, 3).mean((1, 3)))
    assert np.allclose(pixels.resized(np.full((5, 3, 3), 9), 8, 8), 9)
    small, same = (pixels.decoded(base64.b64decode(pixels.thumbnail(png(X[:, :, :3]), n))) for n in (6, 256))
    assert small.shape == (5, 6, 3) and (same == X[:, :, :3]).all()


def test_logo_scan(spark):
    dark = np.zeros((40, 40, 3), np.uint8)
    logo = dark.copy()
    logo[:20, 10:] = 200
    near = np.kron(logo, np.ones((2, 2, 1), np.uint8))
    rows = [(1, "img_1", bytearray(png(near, 2, (1, 2)))), (1, "img_2", bytearray(bmp(logo[::-1].copy()))), (2, "img_1", bytearray(b"no")), (3, "img_1", None)]
    df = spark.createDataFrame(rows, "doc_id int, image_id string, data binary")
    got = {(r["doc_id"], r["image_id"]): r["hash"] for r in pixels.hashed(df).collect()}
    assert got[1, "img_1"] == pixels.hash_of(bmp(logo)) == "3f3f3f3f00000000" and got[2, "img_1"] is got[3, "img_1"] is None
    found = pixels.logo_scan(df, bmp(logo)).collect()
    assert [(r["doc_id"], r["image_id"], r["placeholder"], r["confidence"]) for r in found] == [(1, "img_1", "[LOGO]", 1.0)]
    assert [r["thumbnail"] is None for r in pixels.with_thumbnails(df).orderBy("doc_id", "image_id").collect()] == [False, False, True, True]
    with pytest.raises(ValueError):
        pixels.logo_scan(df, b"no")
