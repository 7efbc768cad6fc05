"""Office documents: zip containers of XML parts."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from ..limits import Budget, read_member


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


class _Container:
    """The parts of one document, read within one budget."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.budget = Budget()

    def part(self, name: str) -> ET.Element | None:
        """A part's root; None if there is no such part or it isn't XML."""
        try:
            return ET.fromstring(read_member(self.zip, self.zip.getinfo(name), self.budget))
        except (KeyError, ET.ParseError):
            return None

    def numbered(self, pattern: str) -> list[tuple[int, str]]:
        found = ((re.fullmatch(pattern, n), n) for n in self.zip.namelist())
        return sorted((int(m[1]), n) for m, n in found if m)


def _run(node: ET.Element) -> str:
    signs = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _local(x) == "t" else signs.get(_local(x), "") for x in node.iter())


def _paragraphs(root: ET.Element) -> Iterator[str]:
    for node in root.iter():
        if _local(node) == "p" and (text := _run(node).strip()):
            yield text


def read_docx(data: bytes) -> str:
    """Paragraphs of the body, then those of headers, footers and notes, by the names of their parts."""
    box = _Container(data)
    notes = sorted(n for n in set(box.zip.namelist()) if re.fullmatch(r"word/(?:endnotes|footnotes|footer|header)[0-9]*\.xml", n))
    roots = (box.part(n) for n in ("word/document.xml", *notes))
    return "\n".join(p for root in roots if root is not None for p in _paragraphs(root))


def read_pptx(data: bytes) -> str:
    """Slides by number, each under a line that names it."""
    box = _Container(data)
    out = []
    for number, name in box.numbered(r"ppt/slides/slide([0-9]+)\.xml"):
        if (root := box.part(name)) is not None:
            out += f"--- slide {number} ---", *_paragraphs(root)
    return "\n".join(out)


def _cell(cell: ET.Element, shared: list[str]) -> str:
    value = ""
    for x in cell:
        if _local(x) == "v":
            value = x.text or ""
        elif _local(x) == "is":
            value = _run(x)
    if cell.get("t") == "s" and value.isdigit():
        return shared[int(value)] if int(value) < len(shared) else ""
    return value


def read_xlsx(data: bytes) -> str:
    """Rows that hold anything, as tab-separated cells, sheet by sheet in the order of their numbers."""
    box = _Container(data)
    strings = box.part("xl/sharedStrings.xml")
    shared = [] if strings is None else [_run(x) for x in strings if _local(x) == "si"]
    out = []
    for _, name in box.numbered(r"xl/worksheets/sheet([0-9]+)\.xml"):
        root = box.part(name)
        for row in () if root is None else root.iter():
            if _local(row) == "row":
                cells = [_cell(c, shared) for c in row if _local(c) == "c"]
                if "".join(cells).strip():
                    out.append("\t".join(cells))
    return "\n".join(out)


def read_odt(data: bytes) -> str:
    root = _Container(data).part("content.xml")
    texts = () if root is None else ("".join(x.itertext()).strip() for x in root.iter() if _local(x) in ("h", "p"))
    return "\n".join(filter(None, texts))


def broken_part(data: bytes) -> tuple[str, str] | None:
    """Reason and detail of the first XML part that can't be parsed, if any."""
    box = _Container(data)
    for info in box.zip.infolist():
        if info.filename.endswith(".xml"):
            try:
                ET.fromstring(read_member(box.zip, info, box.budget))
            except ET.ParseError as e:
                if "amplification" in str(e):
                    return "limit_exceeded", f"{info.filename}: its entities expand without bound; the parser refused them"
                return "truncated_or_corrupt", f"{info.filename}: not well-formed XML ({e})"
    return None
