"""HTML, XML and RTF."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from .plain import decode

_UNSEEN = frozenset("script style head noscript".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LINES = frozenset("article blockquote br div footer header li ol p pre section table td th tr ul".split()) | {f"h{k}" for k in range(1, 7)}


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.unseen = 0

    def _mark(self, tag: str) -> None:
        if tag in _LINES:
            self.out.append("\n")

    def handle_starttag(self, tag, attrs):
        if tag in _UNSEEN:
            self.unseen += 1
        else:
            self._mark(tag)

    def handle_startendtag(self, tag, attrs):
        self._mark(tag)

    def handle_endtag(self, tag):
        if tag in _UNSEEN and self.unseen:
            self.unseen -= 1
        elif tag not in _EMPTY:
            self._mark(tag)

    def handle_data(self, data):
        if not self.unseen:
            self.out.append(data)


def visible_text(page: str) -> str:
    """What a reader of the page would see, a line per block."""
    parser = _Visible()
    parser.feed(page)
    parser.close()
    spaced = re.sub("[ \t\r\f\v]+", " ", "".join(parser.out))
    lines = (line.strip(" ") for line in spaced.split("\n"))
    return "\n".join(filter(None, lines)).strip()


def read_html(data: bytes) -> str:
    return visible_text(decode(data))


def read_xml(data: bytes) -> str:
    """The texts of the elements: of each, in order of their start tags, its own first text and the text after it."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return read_html(data)
    texts = (t.strip() for node in root.iter() for t in (node.text, node.tail) if t)
    return "\n".join(filter(None, texts))


_RTF_TOKEN = re.compile(r"(?P<open>\{)|(?P<close>\})|\\(?:(?P<word>[A-Za-z]+)(?:-?[0-9]+)?[ ]?|'(?P<hex>[0-9A-Fa-f]{2})|(?P<sign>.))|(?P<text>[^{}\\]+)")
_RTF_UNSEEN = frozenset("fonttbl colortbl stylesheet info listtable listoverridetable rsidtbl generator themedata latentstyles datastore pict".split())
_RTF_SIGNS = dict.fromkeys(("par", "line", "row"), "\n") | dict.fromkeys(("tab", "cell"), "\t") | dict.fromkeys(("page", "sect"), "\n\n")


def read_rtf(data: bytes) -> str:
    """Text of the groups that are shown. A group is unseen if it or a group around it names a destination without text, or
    one that readers may pass over."""
    out: list[str] = []
    unseen: list[bool] = [False]
    for m in _RTF_TOKEN.finditer(data.decode("latin-1")):
        kind, value = m.lastgroup, m[m.lastgroup] if m.lastgroup else ""
        if kind == "open":
            unseen.append(unseen[-1])
        elif kind == "close":
            if len(unseen) > 1:
                unseen.pop()
        elif kind == "word" and value in _RTF_UNSEEN or kind == "sign" and value == "*":
            unseen[-1] = True
        elif unseen[-1]:
            continue
        elif kind == "word":
            out.append(_RTF_SIGNS.get(value, ""))
        elif kind == "hex":
            out.append(chr(int(value, 16)))
        elif kind == "text" or value in "{}\\":
            out.append(value)
    lines = "".join(out).split("\n")
    lines[:-1] = [line.rstrip(" \t") for line in lines[:-1]]
    return re.sub("\n\n\n+", "\n\n", "\n".join(lines)).strip()
