"""Labels and values of texts in plain Python, for SQL's table function and the Arrow functions of ``operators.recognition``, whose columns
say the same. What a line is doesn't depend on which digits are in it: lines that differ in those alone are looked at once (no
expression has a certain digit, but for the +1 of phone numbers)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from .detectors import DETECTORS, SHARE

_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Name, expression, whether a match needs a digit, a sign that a value needs, and the length of the shortest match.
_DETECTORS = [
    (d.name, re.compile(d.pattern, re.I if "i" in d.flags else 0), d.accepts is not None, d.signs if len(d.signs) == 1 else "", {"date_iso": 10, "date_long": 10, "phone_us": 12, "date_us": 6}.get(d.name, 1))
    for d in DETECTORS
]
_DIGIT = re.compile(r"\d")
_LABEL = r"([A-Za-z][A-Za-z0-9 /&'().#-]{1,40}?)"
_HEAD = re.compile(rf"\s*{_LABEL}\s*\Z")
_GAP = re.compile(rf"\s*{_LABEL}\s{{2,}}(\S.*)")

_ZEROS = str.maketrans("123456789", "0" * 9)

MAX_VALUE = 200
#: Shapes of lines and values that are kept, and the longest line of which one is.
SHAPES, SHAPE = 10_000, 200
STOPWORDS = (
    *"page continued note notes comments description sincerely regards".split(), "thank you", "terms and conditions",
    *"delete get patch post put".split(),
)

Pair = tuple[int, str, str]


def classify_value(value: str) -> str:
    """The kind of a value, or ``text``."""
    if not _DIGIT.search(value) and "@" not in value and ":" not in value:
        return "text"
    size = len(value)
    least = SHARE * len(value.strip(_SPACES))
    for name, pattern, digits, sign, shortest in _DETECTORS:
        if shortest <= size and sign in value:
            m = pattern.search(value)
            while m and digits and not _DIGIT.search(m[0]):
                m = pattern.search(value, m.end())
            if m and m.end() - m.start() >= least:
                return name
    return "text"


def plain_kinds() -> Callable[[str], str | None]:
    """A function that gives the kind of a value of printable ASCII, on which Python's and Java's expressions agree; else None."""
    shapes: dict[str, str | None] = {}

    def kind(value: str) -> str | None:
        shape = value if "+" in value else value.translate(_ZEROS)
        if (found := shapes.get(shape, "")) == "":
            if len(shapes) >= SHAPES:
                shapes.clear()
            found = shapes[shape] = classify_value(shape) if shape.isascii() and shape.isprintable() else None
        return found

    return kind


def normal(label: str) -> str:
    return re.sub(rf"[{_SPACES}]+", " ", label).strip(" ").rstrip(":").strip(" ").lower()


class _Shape:
    """What a line is (kind: c, colon pair; g, gap pair; l, label; v, value; b, break), and the places of its text, label and value."""

    __slots__ = ("kind", "start", "end", "label", "value", "opens", "key")

    def __init__(self, raw: str):
        line = raw.rstrip()
        text = line.lstrip()
        self.start, self.end, self.opens = len(line) - len(text), len(line), line[-1:] == ":"
        self.kind, self.label, self.value, self.key = "v" if line else "b", slice(0), slice(0), None
        at, m, tail = line.find(":"), None, ""
        if at < 0:
            m = _HEAD.match(line)
        elif m := _HEAD.match(line, 0, at):
            tail = line[at + 1 :].lstrip()
        if tail:
            self.kind, self.label, self.value = "c", slice(*m.span(1)), slice(len(line) - len(tail), len(line))
        elif gap := _GAP.match(line):
            self.kind, self.label, self.value = "g", slice(*gap.span(1)), slice(*gap.span(2))
        elif m and classify_value(text) == "text":
            self.kind, self.label = "l", slice(*m.span(1))


def reader(known: Iterable[str] = (), max_value: int = MAX_VALUE) -> Callable[[str | None], tuple[list[Pair], bool]]:
    """A function that gives a text's pairs (line number, label, value: for each label its first value), and whether labels stand above
    labels in it: without such lines its pairs are the same whatever is known."""
    names = {normal(k) for k in known}
    shapes: dict[str, _Shape] = {}

    def keyed(label: str) -> tuple[str, bool, bool]:
        """A label as a key, whether it may be one, and whether it is known."""
        key = " ".join(label.split()).lower()
        return key, len(key) >= 2 and key not in STOPWORDS, key in names

    def shaped(raw: str, shape: str) -> _Shape:
        found = _Shape(raw)
        if "0" not in shape[found.label]:
            found.key = keyed(raw[found.label])
        if len(shape) <= SHAPE:
            if len(shapes) >= SHAPES:
                shapes.clear()
            shapes[shape] = found
        return found

    def read(text: str | None) -> tuple[list[Pair], bool]:
        out: list[Pair] = []
        if not text:
            return out, False
        seen: set[str] = set()
        run = False
        # of the line above, if it is a label alone: its key, whether the key may be one and is known, whether the line takes no value, being one
        above: tuple[str, bool, bool] | None = None
        opens = taken = False
        for i, (raw, shape) in enumerate(zip(text.splitlines(), text.translate(_ZEROS).splitlines())):
            x = shapes.get(shape) or shaped(raw, shape)
            kind = x.kind
            if kind == "b":
                above = None
                continue
            key = x.key or keyed(raw[x.label])
            at, holder, value = i, None, x.value
            if kind == "c" or kind == "g" and not (above and opens):
                holder = key
            elif above and not taken and (kind != "l" or above[2] and not key[2]):
                at, holder, value = i - 1, above, slice(x.start, x.end)
            if holder and holder[1] and holder[0] not in seen and value.stop - value.start <= max_value:
                seen.add(holder[0])
                out.append((at, holder[0], raw[value]))
            if kind == "l":
                if above:
                    run = True
                taken = bool(above and above[2] and not key[2])
                above, opens = key, x.opens
            else:
                above = None
        return out, run

    return read


def label_values(text: str | None, known: Iterable[str] = ()) -> Iterator[Pair]:
    """Line number, label and value: for each label its first value."""
    yield from reader(known)(text)[0]
