"""Rows rendered as documents of each format, as bytes: inputs whose text is known exactly."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

Lines = list[str]
#: Documents of a batch that are made at a time.
_SLICE = 256


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(lines: Lines) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _zip({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}<w:p/></w:body></w:document>'})


def pptx(lines: Lines) -> bytes:
    slide = lambda x: f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:sld>'
    return _zip({"ppt/presentation.xml": "<p/>"} | {f"ppt/slides/slide{k}.xml": slide(x) for k, x in reversed(list(enumerate(lines, 1)))})


def xlsx(lines: Lines) -> bytes:
    strings = "".join(f"<si><t>{escape(x)}</t></si>" for x in lines)
    rows = "".join(f'<row><c><v>{k}</v></c><c t="s"><v>{k}</v></c></row>' for k in range(len(lines)))
    return _zip({"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def odt(lines: Lines) -> bytes:
    return _zip({"content.xml": '<o:c xmlns:o="urn:o">' + "".join(f"<o:p>{escape(x)}</o:p>" for x in lines) + "</o:c>"})


def eml(lines: Lines) -> bytes:
    head = f"From: office@example.com\r\nTo: client@example.com\r\nSubject: {lines[0]}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"
    return (head + "\n".join(lines[1:])).encode()


def rtf(lines: Lines) -> bytes:
    sign = lambda c: c if ord(c) < 128 and c not in "\\{}" else f"\\{c}" if c in "\\{}" else f"\\'{ord(c):02x}"
    body = "\\par ".join("".join(map(sign, x)) for x in lines)
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Font;}}{\\*\\generator Maker;}\\f0 " + body + "}").encode("latin-1")


def xml(lines: Lines) -> bytes:
    return ("<?xml version='1.0'?><list>" + "".join(f"<item>{escape(x)}</item>" for x in lines) + "</list>").encode()


def html(lines: Lines) -> bytes:
    return ("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "</body></html>").encode()


def csv(lines: Lines) -> bytes:
    return "\n".join(f'"{x}";{k};"a,b"' for k, x in enumerate(lines)).encode()


def json_document(lines: Lines) -> bytes:
    return json.dumps({"title": lines[0], "lines": lines[1:], "none": None}, ensure_ascii=False).encode()


def pdf(lines: Lines) -> bytes:
    def literal(x: str) -> bytes:
        return b"(" + x.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"

    shown = b"".join(b"[" + b"-300".join(literal(w) for w in x.split(" ")) + b"] TJ 0 -14 Td\n" for x in lines)
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td\n" + shown + b"ET")
    return b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream endobj\ntrailer << >>\n%%EOF\n"


def mbox(lines: Lines) -> bytes:
    """A mailbox with a message for each line but the first, which is the subject of all."""
    return "".join(f"From office@example.com Mon Jan  1 00:00:00 2024\nFrom: office@example.com\nSubject: {lines[0]}\n\n{x}\n\n" for x in lines[1:]).encode()


def mapped_pdf(lines: Lines) -> bytes:
    """A PDF whose font has codes of its own, of two bytes, and a map from them: single entries, a range and a list."""
    known = sorted({c for x in lines for c in x})
    small = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    rest = [c for c in known if c not in small]
    code = {c: 0x100 + k for k, c in enumerate(small)} | {c: 0x300 + 7 * k for k, c in enumerate(rest)}
    hexed = lambda c: c.encode("utf-16-be").hex().upper()
    half = len(rest) // 2
    chars = "".join(f"<{code[c]:04X}> <{hexed(c)}>\n" for c in rest[:half])
    lists = "".join(f"<{code[c]:04X}> <{code[c]:04X}> [<{hexed(c)}>]\n" for c in rest[half:])
    cmap = f"1 beginbfrange\n<0100> <0119> <0061>\nendbfrange\n{half} beginbfchar\n{chars}endbfchar\n{len(rest) - half} beginbfrange\n{lists}endbfrange\n"
    shown = "".join(f"<{''.join(f'{code[c]:04X}' for c in x)}> Tj 0 -14 Td\n" for x in lines)
    stream = lambda n, body: f"{n} 0 obj << /Length {len(body)} >>\nstream\n{body}\nendstream endobj\n"
    head = "%PDF-1.7\n1 0 obj << /Type /Page /Resources << /Font << /F7 2 0 R >> >> /Contents 4 0 R >> endobj\n2 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 3 0 R >> endobj\n"
    return (head + stream(3, cmap) + stream(4, f"BT /F7 12 Tf 72 700 Td\n{shown}ET") + "trailer << >>\n%%EOF\n").encode("latin-1")


FORMATS: dict[str, Callable[[Lines], bytes]] = {
    "docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odt, "eml": eml, "rtf": rtf, "xml": xml, "html": html, "csv": csv, "json": json_document, "pdf": pdf, "mbox": mbox, "mapped.pdf": mapped_pdf,
}


def rendered(rows: DataFrame, kind: str) -> DataFrame:
    """ordinal, name and content of a document per row of ``rows`` (ordinal, lines: array of strings)."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, _SLICE) for k in range(0, whole.num_rows, _SLICE)):
                data = [FORMATS[kind](x) for x in b.column(1).to_pylist()]
                names = [f"{k}.{kind}" for k in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["ordinal", "name", "content"])

    return rows.select("ordinal", "lines").mapInArrow(make, "ordinal bigint, name string, content binary")
