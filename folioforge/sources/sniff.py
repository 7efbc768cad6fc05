"""What a document is, by its bytes first and its name second, and its text or the reason why there is none."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from .limits import NoTextFound, UnsupportedFormat, reason_of
from .readers import mail, markup, office, pdf, plain

Reader = Callable[[bytes], str]

READERS: dict[str, Reader] = {
    "pdf": pdf.read_pdf, "docx": office.read_docx, "pptx": office.read_pptx, "xlsx": office.read_xlsx, "odt": office.read_odt, "eml": mail.read_message,
    "mbox": mail.read_mailbox, "rtf": markup.read_rtf, "html": markup.read_html, "xml": markup.read_xml, "csv": plain.read_delimited, "json": plain.read_json,
    "text": plain.decode,
}
OFFICE = {"word/document.xml": "docx", "ppt/presentation.xml": "pptx", "xl/workbook.xml": "xlsx", "content.xml": "odt"}
#: Formats that a name alone can claim; the others need their signature.
BY_NAME = {"eml": "eml", "mbox": "mbox", "html": "html", "htm": "html", "xml": "xml", "csv": "csv", "tsv": "csv", "json": "json", "txt": "text", "md": "text", "log": "text"}
SKIPPED = {
    x: kind
    for kind, names in {
        "image": "bmp gif ico jpeg jpg png webp", "vector image": "svg", "audio or video": "avi mov mp3 mp4 wav", "font": "otf ttf woff woff2",
        "compiled code or binary": "a bin class dll dylib exe jar o pyc pyo so", "database or lock file": "db lock sqlite",
    }.items()
    for x in names.split()
}
_MAIL_SIGNS = [f"{x}:".encode() for x in "from received subject message-id mime-version".split()]


def _suffix(name: str) -> str:
    return name.lower().rpartition(".")[2] if "." in name else ""


def office_format(source: bytes | str) -> str | None:
    """The office format of a zip, given as its bytes or its path; None for other archives and for what is no zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as z:
            names = set(z.namelist())
    except (zipfile.BadZipFile, OSError):
        return None
    return next((kind for part, kind in OFFICE.items() if part in names), None)


def _is_pdf(head: bytes) -> bool:
    return head.startswith(b"%PDF") or b"%PDF-" in head[:1024]


def sniff(data: bytes, name: str = "") -> str:
    """The format, a key of READERS."""
    head = data[:4096]
    stripped = head.lstrip()[:15].lower()
    if _is_pdf(head):
        return "pdf"
    if head.startswith(b"PK"):
        if kind := office_format(data):
            return kind
        raise UnsupportedFormat("a zip archive that isn't a known kind of document")
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if stripped.startswith((b"<html", b"<!doctype html")):
        return "html"
    if head.lstrip().startswith(b"<?xml"):
        return "xml"
    if head.startswith(b"From "):
        return "mbox"
    if any(sign in head[:2048].lower() for sign in _MAIL_SIGNS):
        return "eml"
    if kind := BY_NAME.get(_suffix(name)):
        return kind
    if b"\0" in head:
        raise UnsupportedFormat(f"nothing tells what kind of document {name or 'this'} is")
    return "text"


def skip_reason(name: str, head: bytes, whole: Callable[[], bytes | str] | None = None) -> tuple[str, str] | None:
    """Why a file isn't read, from its name, unless its bytes say that it is a document after all."""
    kind = SKIPPED.get(_suffix(name))
    if kind is None or _is_pdf(head) or head.startswith(b"{\\rtf"):
        return None
    if head.startswith(b"PK") and whole is not None and office_format(whole()):
        return None
    if kind == "image":
        return "image_no_text_layer", "an image has no text; that would need OCR"
    return "not_a_document", f"{kind}: not a kind of document that is read"


def extract(data: bytes, name: str = "") -> str:
    return READERS[sniff(data, name)](data)


def explain_empty(data: bytes, name: str = "") -> tuple[str, str]:
    """Why a document that was read gave nothing."""
    if not data:
        return "empty_file", "there are no bytes in it"
    try:
        kind = sniff(data, name)
    except UnsupportedFormat:
        kind = ""
    if kind == "pdf":
        return pdf.why_empty(data)
    if kind in OFFICE.values() and (broken := office.broken_part(data)):
        return broken
    return "no_text_found", "it was read, but there is no text in it"


@dataclass(frozen=True)
class Outcome:
    """What reading a document came to: ``status`` is read, or the reason why not."""

    format: str
    text: str
    status: str
    detail: str = ""


def read(data: bytes, name: str, label_name: str | None = None) -> Outcome:
    """Never raises: a document that can't be read is an outcome too."""
    kind = ""
    try:
        kind = sniff(data, name)
        text = READERS[kind](data)
        if text.strip():
            return Outcome(kind, text, "read")
        raise NoTextFound(*explain_empty(data, label_name or name))
    except Exception as e:  # noqa: BLE001
        return Outcome(kind, "", *reason_of(e))
