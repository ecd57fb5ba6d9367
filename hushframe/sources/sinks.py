"""Masked documents as files: text formats, office formats with their layout kept, and plain PDF pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE, PER_PAGE = 100, 49
_MAIN = "http://schemas.openxmlformats.org"


def _zipped(parts: Mapping[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _replaced(s: str, replacements: Mapping[str, str], quotes: Mapping[str, str]) -> str:
    for old in sorted(replacements, key=len, reverse=True):
        if old:
            s = s.replace(escape(old, dict(quotes)), escape(replacements[old], dict(quotes)))
    return s


def masked_docx(original: bytes | None, masked: str, replacements: Mapping[str, str]) -> bytes:
    """The document with each text replaced in place, longest first; text that is split over runs stays.  What can't be
    read becomes a document with a paragraph for each line of ``masked``."""
    try:
        with zipfile.ZipFile(io.BytesIO(original or b"")) as z:
            parts = {n: z.read(n) for n in z.namelist()}
        own = parts["word/document.xml"].decode()
        parts["word/document.xml"] = _replaced(own, replacements, {'"': "&quot;", "'": "&apos;"}).encode()
        for n in [n for n in parts if re.search(r"word/(?:header|footer)\d*\.xml", n)]:
            parts[n] = _replaced(parts[n].decode(), replacements, {}).encode()
        return _zipped(parts)
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in masked.split("\n"))
        return _zipped(
            {
                "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{_MAIN}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
                "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{_MAIN}/package/2006/relationships"><Relationship Id="rId1" Type="{_MAIN}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
                "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_MAIN}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
            }
        )


def written_xlsx(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    def cell(v: str) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    parts = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{_MAIN}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{_MAIN}/package/2006/relationships"><Relationship Id="rId1" Type="{_MAIN}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{_MAIN}/spreadsheetml/2006/main" xmlns:r="{_MAIN}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="{_MAIN}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_MAIN}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, (_, rows) in enumerate(sheets, 1):
        data = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}/spreadsheetml/2006/main"><sheetData>{data}</sheetData></worksheet>'
    return _zipped(parts)


def masked_xlsx(original: bytes | None, masked: str, replacements: Mapping[str, str]) -> bytes:
    """The workbook's cells with each text replaced, longest first; what can't be read becomes one sheet of lines."""
    from hushframe.sources.documents import xlsx_sheets

    def own(v: str) -> str:
        for old in sorted(replacements, key=len, reverse=True):
            v = v.replace(old, replacements[old]) if old else v
        return v

    try:
        return written_xlsx([(n, [[own(v) for v in r] for r in rows]) for n, rows in xlsx_sheets(original or b"")])
    except (zipfile.BadZipFile, KeyError, ValueError):
        return written_xlsx([("Sanitized", [line.split("\t") for line in masked.split("\n")])])


def pdf_pages(masked: Column) -> Column:
    """(page, line) of each line of a masked text: cut at 100 characters, 49 lines to a page."""
    return F.transform(F.split(masked, "\n"), lambda x, i: F.struct(F.floor(i / PER_PAGE).cast("int").alias("page"), F.substring(x, 1, LINE).alias("line")))


def masked_pdf(masked: str) -> bytes:
    """A4 pages in ten-point Helvetica; characters beyond Latin-1 become question marks."""
    lines = [line[:LINE] for line in masked.split("\n")]
    pages = [lines[i : i + PER_PAGE] for i in range(0, len(lines), PER_PAGE)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        shown = "".join(f"({re.sub(r'([()\\\\])', r'\\\1', line)}) Tj T*\n" for line in page)
        stream = f"BT /F1 10 Tf 15 TL 50 792 Td\n{shown}ET"
        size = len(stream.encode("latin-1", "replace"))
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects) + 2} 0 R >>", f"<< /Length {size} >>\nstream\n{stream}\nendstream"]
        kids.append(f"{len(objects) - 1} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode("latin-1", "replace")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF".encode()


def replacements(detections: Column) -> Column:
    """Placeholder by original text of approved detections; of several the last stays."""
    approved = F.filter(detections, lambda d: d["approved"])
    last = F.filter(approved, lambda d, i: ~F.exists(F.slice(approved, i + 2, F.greatest(F.lit(1), F.size(approved))), lambda e: e["text"] == d["text"]))
    return F.map_from_entries(F.transform(last, lambda d: F.struct(d["text"], d["placeholder"])))


def export_name(path: Column) -> Column:
    """``report.txt`` is exported as ``report_sanitized.txt``."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", "$1_sanitized$2")


def to_files(df: DataFrame) -> DataFrame:
    """``df`` (ext, content, masked_text, replacements) with ``masked_content``, the bytes of the masked file."""
    places = {c: df.columns.index(c) for c in ("ext", "content", "masked_text", "replacements")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ext, content, text, of = (batch.column(p)[i].as_py() for p in places.values())
                text, of = text or "", dict(of or [])
                out.append(masked_docx(content, text, of) if ext == "docx" else masked_xlsx(content, text, of) if ext == "xlsx" else masked_pdf(text) if ext == "pdf" else text.encode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "masked_content"])

    return df.mapInArrow(run, df.select("*", F.lit(b"").alias("masked_content")).schema)
