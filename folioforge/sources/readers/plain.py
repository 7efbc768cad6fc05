"""Text, delimited text and JSON."""

from __future__ import annotations

import csv
import io
import json


ENCODINGS = "utf-8-sig", "cp1252"


def decode(data: bytes) -> str:
    """UTF-8 with or without a byte order mark, else Windows-1252, else Latin-1, which takes any bytes."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def read_delimited(data: bytes) -> str:
    """Rows as lines of tab-separated, stripped cells; the delimiter is guessed from the start of the text."""
    text = decode(data)
    try:
        kind: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[: 1 << 13], ",;\t|")
    except csv.Error:
        kind = csv.excel
    out = []
    try:
        for row in csv.reader(io.StringIO(text), kind):
            if row:
                out.append("\t".join(map(str.strip, row)))
    except csv.Error:
        return text
    return "\n".join(out)


def read_json(data: bytes) -> str:
    """Leaves as ``path: value`` lines in the order of the document, nulls left out. What isn't JSON stays as it is."""
    text = decode(data)
    try:
        todo = [("", json.loads(text))]
    except (ValueError, RecursionError):
        return text
    out = []
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(f"{path}[{k}]", node[k]) for k in range(len(node) - 1, -1, -1)]
        elif node is not None:
            out.append(": ".join(filter(None, (path, str(node)))) if str(node) else f"{path}: " * bool(path))
    return "\n".join(out)
