"""Documents from files: text formats by expressions, office formats with the standard library alone.

``read_documents`` is the ``binaryFile`` source with one row for each file; parsing runs where the file was read.  A PDF
without readable text has a note as its text; text of images would need a library for recognition, so images have none.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import fixed_values as V
from hushframe.sources.pdf import read_pdf

IMAGES, IMAGE_BYTES, ALL_IMAGE_BYTES = 100, 10 * 1024 * 1024, 50 * 1024 * 1024
_SPACE = r"[\t\n\x0B\f\r    -     　﻿]+"
_CONTENT_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become spaces, white space is one space; references stay as they are."""
    s = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    s = F.regexp_replace(s, r"(?is)<style[^>]*>.*?</style>", "")
    s = F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), _SPACE, " ")
    return F.trim(s)


def json_text(raw: str) -> str:
    """Indented by two; what isn't JSON stays as it is."""
    try:
        return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    except ValueError:
        return raw


def docx_text(b: bytes) -> str:
    """Paragraphs, each followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for x in p.iter():
            parts.append(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "")
        out.append("".join(parts))
    return "".join(f"{p}\n\n" for p in out)


def docx_images(b: bytes) -> list[tuple[str, bytes, str]]:
    """(id, bytes, content type) of pictures: at most 100, each up to 10 MB, all up to 50 MB; metafiles are left out."""
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for info in z.infolist():
            ext = info.filename.rpartition(".")[2].lower()
            if not info.filename.startswith("word/media/") or info.is_dir() or ext in ("emf", "wmf") or info.file_size > IMAGE_BYTES:
                continue
            if len(out) >= IMAGES or total + info.file_size > ALL_IMAGE_BYTES:
                break
            total += info.file_size
            out.append((f"img_{len(out) + 1}", z.read(info), _CONTENT_TYPES.get(ext, "image/png")))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_sheets(b: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows with a value of each sheet."""
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rel = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rel[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
            rows = []
            for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_S}c"):
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else v.text or "" if v is not None else None
                    if value is not None:
                        value = shared[int(value)] if kind == "s" else {"0": "false", "1": "true"}.get(value, value) if kind == "b" else value
                        cells[_column(c.get("r", "")) or len(cells) + 1] = value
                if cells:
                    rows.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
            out.append((sheet.get("name", ""), rows))
    return out


def xlsx_text(b: bytes) -> str:
    parts = []
    for name, rows in xlsx_sheets(b):
        parts += [f"--- Sheet: {name} ---\n", *("\t".join(r) for r in rows), "\n"]
    return "\n".join(parts)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, ext and content of the files under ``path`` that are of a known kind and not too large."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return df.select("path", "length", ext.alias("ext"), "content").where(F.col("ext").isin(*V.DOCUMENT_EXTENSIONS, *V.IMAGE_EXTENSIONS) & (F.col("length") <= V.MAX_FILE_BYTES))


def parse(files: DataFrame) -> DataFrame:
    """``files`` (ext, content) with ``text``, ``sheets``, ``error`` and ``info`` (pages, title and author of a PDF): a file that
    can't be read has an error and no text."""
    places = [files.columns.index(c) for c in ("ext", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, sheets, error, info = [], [], [], []
            for ext, content in zip(*(batch.column(i) for i in places)):
                ext, b = ext.as_py(), content.as_py() or b""
                t, s, e, about = None, None, None, None
                try:
                    if ext == "docx":
                        t = docx_text(b)
                    elif ext == "xlsx":
                        t, s = xlsx_text(b), [n for n, _ in xlsx_sheets(b)]
                    elif ext == "json":
                        t = json_text(b.decode("utf-8", "replace"))
                    elif ext == "pdf":
                        t, about = read_pdf(b)
                    elif ext in V.IMAGE_EXTENSIONS:
                        t = ""
                    elif ext in V.DOCUMENT_EXTENSIONS:
                        t = b.decode("utf-8", "replace")
                    else:
                        e = f"Unsupported file format: {ext}"
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError) as x:
                    e = f"{type(x).__name__}: {x}"
                text.append(t)
                sheets.append(s)
                error.append(e)
                info.append(about and list(about.items()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(sheets, pa.list_(pa.string())), pa.array(error, pa.string()), pa.array(info, pa.map_(pa.string(), pa.string()))], [*batch.schema.names, "text", "sheets", "error", "info"])

    out = files.mapInArrow(run, files.selectExpr("*", "cast(null as string) text", "cast(null as array<string>) sheets", "cast(null as string) error", "cast(null as map<string,string>) info").schema)
    return out.withColumn("text", F.when(F.col("ext") == "html", html_text(F.col("text"))).otherwise(F.col("text")))


def images_of(files: DataFrame) -> DataFrame:
    """One row for each picture: path, image_id, data, content_type; an image file is its own picture."""
    places = [files.columns.index(c) for c in ("path", "ext", "content")]
    schema = pa.schema([("path", pa.string()), ("image_id", pa.string()), ("data", pa.binary()), ("content_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ext, content in zip(*(batch.column(i) for i in places)):
                b, e, rows = content.as_py() or b"", ext.as_py(), []
                if e in V.IMAGE_EXTENSIONS:
                    rows = [("img_1", b, f"image/{'jpeg' if e == 'jpg' else e}")]
                elif e == "docx" and zipfile.is_zipfile(io.BytesIO(b)):
                    rows = docx_images(b)
                for i, data, kind in rows:
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "image_id": i, "data": data, "content_type": kind}], schema)

    return files.mapInArrow(run, "path string, image_id string, data binary, content_type string")


def combined_ocr(results: Column) -> Column:
    """Texts of recognised images, blank ones left out, each under its number among the rest."""
    full = F.filter(results, lambda x: F.trim(x) != "")
    return F.array_join(F.transform(full, lambda x, i: F.concat(F.lit("[Image "), (i + 1).cast("string"), F.lit("]\n"), x)), "\n\n")
