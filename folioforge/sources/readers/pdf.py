"""Text of PDF files, from the operators of their content streams."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

from ..limits import LIMITS, MB, EncryptedDocument, StreamTooLarge, UndecodableFonts, inflate
from .pdf_fonts import CodeMap, font_maps, through

#: Thousandths of an em by which a run must be moved to the right to begin a word.
WORD_GAP = 200
GARBAGE_SHARE, LOST_SHARE, PAGE_CHARS = 0.2, 0.95, 150

_ITEM = re.compile(rb"(?P<plain>\([^()\\]*\))|(?P<open>\()|(?P<hex><(?!<)[^>]*>?)|(?P<array>[\[\]])|/(?P<name>[A-Za-z0-9+._#-]*)|(?P<number>[-+.0-9][0-9.]*)|(?P<op>[A-Za-z'\"][A-Za-z*'\"]*)")
_ESCAPE = re.compile(rb"\\(?:([0-9]{1,3})|([\r\n])|(.)|\Z)", re.S)
_SIMPLE = {bytes([a]): bytes([b]) for a, b in zip(b"nrtbf", b"\n\r\t\b\f")}


def _unescape(raw: bytes) -> bytes:
    def one(m: re.Match[bytes]) -> bytes:
        if m[1]:
            return bytes([int(m[1], 8) & 255]) if m[1].translate(None, b"89") == m[1] else b""
        return b"" if m[2] or m[3] is None else _SIMPLE.get(m[3], m[3])

    return _ESCAPE.sub(one, raw) if b"\\" in raw else raw


_PAREN = re.compile(rb"\\.|[()]", re.S)


def _closing(buf: bytes, at: int) -> int:
    """Where the string that opens at ``at`` closes; the end of the buffer if it doesn't."""
    depth = 0
    for m in _PAREN.finditer(buf, at):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return m.start()
    return len(buf)


def _hex(raw: bytes) -> bytes:
    digits = "".join(c for c in raw.decode("latin-1") if c in string.hexdigits)
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def _unreadable(text: str) -> bool:
    """Whether a run is glyph numbers rather than characters."""
    odd = [c for c in text if c not in "\t\n\r" and not c.isprintable()]
    return len(odd) > GARBAGE_SHARE * len(text)


class Page:
    """Runs the operators of one content stream. ``kept`` and ``lost`` count characters of runs that could be read or not."""

    def __init__(self, fonts: dict[str, CodeMap]):
        self.fonts, self.kept, self.lost = fonts, 0, 0

    def _line(self, out: list[str]) -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def text(self, buf: bytes) -> str:
        out: list[str] = []
        runs: list[str] = []
        font: CodeMap | None = None
        name: str | None = None
        depth, moved, at = 0, 0.0, 0
        while m := _ITEM.search(buf, at):
            at, kind = m.end(), m.lastgroup
            if kind in ("plain", "open", "hex"):
                if kind == "open":
                    at = _closing(buf, m.start()) + 1
                if kind == "hex":
                    raw = _hex(m[0]) if m[0].endswith(b">") else b""
                else:
                    raw = _unescape(buf[m.start() + 1 : at - 1])
                run = through(font, raw) if font else None
                run = raw.decode("latin-1") if run is None else run
                if _unreadable(run):
                    self.lost += len(run)
                else:
                    self.kept += len(run)
                    if moved <= -WORD_GAP and runs and runs[-1][-1:] not in (" ", "\n", "\t") and run[:1] not in (" ", "\n", "\t"):
                        runs.append(" ")
                    runs.append(run)
                moved = 0.0
            elif kind == "array":
                depth = depth + 1 if m[0] == b"[" else max(0, depth - 1)
                moved = 0.0
            elif kind == "number":
                if depth:
                    try:
                        moved += float(m[0])
                    except ValueError:
                        pass
            elif kind == "name":
                name = m["name"].decode("latin-1")
            else:
                moved = 0.0
                op = m["op"]
                if op == b"Tf" and name is not None:
                    font = self.fonts.get(name) or self.fonts.get("*")
                elif op in (b"'", b'"', b"Tj", b"TJ"):
                    if op in b"'\"":
                        self._line(out)
                    out.append("".join(runs))
                elif op in (b"ET", b"TD", b"T*", b"Td"):
                    self._line(out)
                runs = []
        return "".join(out)


def _streams(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """The dictionary of each stream, and where its bytes begin and end."""
    begin = re.compile(rb"stream\r?\n?")
    m = begin.search(data)
    while m:
        end = data.find(b"endstream", m.end())
        if end < 0:
            return
        head = data.rfind(b"<<", max(0, m.start() - 4096), m.start())
        yield (data[head : m.start()] if head >= 0 else b""), m.end(), end
        m = begin.search(data, end + len(b"endstream"))


def is_encrypted(data: bytes) -> bool:
    return bool(re.search(rb"/Encrypt\s+[0-9]+\s+[0-9]+\s+R", data[-4096:]) or re.search(rb"trailer(?s:.){0,2048}?/Encrypt", data))


def why_empty(data: bytes) -> tuple[str, str]:
    if data.rfind(b"%%EOF", max(0, len(data) - 1024)) < 0:
        return "truncated_or_corrupt", "the file has no end-of-file marker; part of it is missing"
    if re.search(rb"/Subtype\s*/Image", data):
        return "no_text_found", "there are images but no text, as in a scan; that would need OCR"
    return "no_text_found", "the file is whole, but it draws no text"


def read_pdf(data: bytes) -> str:
    start = data.find(b"%PDF")
    data = data[start:] if start > 0 else data
    if is_encrypted(data):
        raise EncryptedDocument("the PDF is encrypted")
    for head, a, b in _streams(data):
        if b"/Filter" not in head and b - a > LIMITS.pdf_stream_bytes:
            raise StreamTooLarge(f"an unpacked stream has {(b - a) // MB} MB; {LIMITS.pdf_stream_bytes // MB} MB is the limit")
    try:
        fonts = font_maps(data)
    except Exception:  # noqa: BLE001 - damaged font tables leave the bytes as they are
        fonts = {}
    page, texts, count = Page(fonts), [], 0
    for head, a, b in _streams(data):
        if b"/FlateDecode" in head:
            body = inflate(data[a:b])
        else:
            body = None if b"/Filter" in head else data[a:b]
        if body and (b"Tj" in body or b"TJ" in body):
            count += 1
            texts.append(page.text(body))
    found = re.sub("\n\n\n+", "\n\n", "\n".join(t for t in texts if t.strip())).strip()
    if count and not found:
        raise UndecodableFonts("the fonts have no character maps, so the text can't be recovered")
    if page.lost and page.lost >= LOST_SHARE * (page.kept + page.lost) and len(found) < PAGE_CHARS * count:
        raise UndecodableFonts(f"of {count} streams of text only {len(found)} characters can be recovered; the fonts lack character maps")
    return found
