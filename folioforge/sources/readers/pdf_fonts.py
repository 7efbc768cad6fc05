"""Objects of a PDF file and the character maps of its fonts, without the cross-reference table."""

from __future__ import annotations

import re
import zlib

from ..limits import LIMITS

CodeMap = dict[int, str]
_HEAD = re.compile(rb"\b([0-9]+)\s+[0-9]+\s+obj\b")
_REFERENCE = rb"\s*([0-9]+)\s+[0-9]+\s+R\b"
_HEX = rb"<([\dA-Fa-f]+)>"
_UNKNOWN = "�"


def _payload(obj: bytes) -> bytes | None:
    head, mark, rest = obj.partition(b"stream")
    if not mark:
        return None
    body = re.sub(rb"\A\r?\n?", b"", rest.partition(b"endstream")[0], count=1)
    if b"/FlateDecode" not in head:
        return body
    try:
        return zlib.decompressobj().decompress(body, LIMITS.pdf_stream_bytes)
    except zlib.error:
        return None


def objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, the last definition of each; those packed in object streams where there is no other."""
    heads = list(_HEAD.finditer(data))
    found: dict[int, bytes] = {}
    for k, head in enumerate(heads):
        upto = heads[k + 1].start() if k + 1 < len(heads) else len(data)
        closed = data.find(b"endobj", head.end(), upto)
        stop = upto if closed < 0 else closed
        if stop - head.end() <= LIMITS.pdf_object_bytes:
            found[int(head[1])] = data[head.end() : stop]
    for obj in [x for x in found.values() if b"/ObjStm" in x]:
        count, first, body = re.search(rb"/N\s+([0-9]+)", obj), re.search(rb"/First\s+([0-9]+)", obj), _payload(obj)
        if not (count and first and body):
            continue
        base = int(first[1])
        try:
            numbers = [int(x) for x in body[:base].split()[: 2 * int(count[1])]]
        except ValueError:
            continue
        places = [*numbers[1::2], len(body) - base]
        for k, number in enumerate(numbers[0 : 2 * (len(numbers) // 2) : 2]):
            found.setdefault(number, body[base + places[k] : base + places[k + 1]])
    return found


def _utf16(digits: bytes) -> bytes:
    raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return raw + b"\0" * (len(raw) % 2)


def _sections(cmap: bytes, name: bytes) -> list[bytes]:
    return [x.partition(b"end" + name)[0] for x in cmap.split(b"begin" + name)[1:]]


def code_map(cmap: bytes) -> CodeMap:
    """Characters by code, of the single entries and both kinds of ranges."""
    out: CodeMap = {}
    for part in _sections(cmap, b"bfchar"):
        for code, to in re.findall(_HEX + rb"\s*" + _HEX, part):
            out[int(code, 16)] = _utf16(to).decode("utf-16-be", "replace")
    for part in _sections(cmap, b"bfrange"):
        for m in re.finditer(_HEX + rb"\s*" + _HEX + rb"\s*(?:\[([^\]]*)\]|" + _HEX + rb")", part):
            low, high = int(m[1], 16), int(m[2], 16)
            if m[3] is not None:
                out.update((low + k, _utf16(to).decode("utf-16-be", "replace")) for k, to in enumerate(re.findall(_HEX, m[3])))
            elif high - low <= 0xFFFF:
                to = _utf16(m[4])
                start = int.from_bytes(to[-2:], "big")
                for k in range(min(high - low, 0xFFFF - start) + 1):
                    out[low + k] = (to[:-2] + (start + k).to_bytes(2, "big")).decode("utf-16-be", "replace")
    return out


def _dictionary(obj: bytes, at: int) -> bytes:
    """The dictionary that opens at a place, with what nests in it."""
    depth = 0
    for m in re.compile(rb"<<|>>").finditer(obj, at):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return obj[at : m.end()]
    return b""


def font_maps(data: bytes) -> dict[str, CodeMap]:
    """Maps by the names under which pages use the fonts, over the whole document; ``*`` is the map of any font where only
    one is known and none is named."""
    every = objects(data)
    maps: dict[int, CodeMap] = {}
    for number, obj in every.items():
        m = re.search(rb"/ToUnicode" + _REFERENCE, obj)
        body = _payload(every.get(int(m[1]), b"")) if m else None
        if body and (found := code_map(body)):
            maps[number] = found
    named: dict[str, CodeMap] = {}
    for obj in every.values() if maps else ():
        for m in re.finditer(rb"/Font(?![A-Za-z0-9])", obj):
            if ref := re.compile(_REFERENCE).match(obj, m.end()):
                fonts = every.get(int(ref[1]), b"")
            else:
                opened = re.compile(rb"\s*(?=<<)").match(obj, m.end())
                fonts = _dictionary(obj, opened.end()) if opened else b""
            for name, number in re.findall(rb"/([\w#+.-]+)" + _REFERENCE, fonts):
                if int(number) in maps:
                    named.setdefault(name.decode("latin-1"), maps[int(number)])
    if maps and not named and len(maps) == 1:
        named["*"] = next(iter(maps.values()))
    return named


def through(codes: CodeMap, raw: bytes) -> str | None:
    """The string of one-byte codes, or of two-byte codes where too many of the others are unknown, or None."""
    units: list[list[int]] = [list(raw)]
    if len(raw) % 2 == 0:
        units.append([a << 8 | b for a, b in zip(raw[::2], raw[1::2])])
    for codes_of in units:
        text = [codes.get(c, _UNKNOWN) for c in codes_of]
        if "".join(text).count(_UNKNOWN) * 4 <= len(codes_of):
            return "".join(text)
    return None
