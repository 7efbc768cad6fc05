"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns (offsets in code points, end exclusive; per kind leftmost, not overlapping, and a match that fails its check
is dropped without another try inside): e-mail addresses; IPv4 addresses with parts to 255; card numbers of 16 to 19 digits,
singly separated or not, that pass the Luhn check; international phone numbers of 8 to 15 digits.

The random field labels tokens as beginning, inside or outside of such a kind, from the shapes of a token and its
neighbours, whether it touches the one before, and a few cue words. It finds what the patterns leave: phone numbers
without a country code, spelled-out addresses (name at host dot com). It is trained here, from the small labelled table
``labelled_table()`` (or your own), by gradient ascent on the likelihood, and decoded by Viterbi over batches of sequences
in numpy. Sequences are the neighbourhoods of digits, @ signs and the words at and dot: the words (runs without white space) that
lie, or begin or end, within ``REACH`` characters of one. Whatever has none of these near is outside, as every kind needs one. A span of the field is kept if it has what its kind needs (``_holds``) and overlaps no span of the patterns.

Nulls: a null text is an empty one; a null doc_id is kept. Repeated rows each give a row. An empty table gives an empty
result. Further columns are ignored. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

KINDS = ("email", "ip", "card", "phone")
REACH = 60
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ADDRESS = re.compile(r"[\w.%+-]+ ?@ ?[\w-]+(?: ?\. ?[\w-]+)+")
_SPELLED = re.compile(r"[\w.%+-]+ ?[\[(]? ?at ?[\])]? ?[\w-]+(?: ?[\[(]? ?dot ?[\])]? ?[\w-]+)+", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and int(value) <= 255


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    at, upto = text.find("@"), 0
    while at >= 0:
        s = at
        while s > upto and text[s - 1] in _CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            upto = m.end()
        at = text.find("@", max(at + 1, upto))
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- tokens and features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_TRIGGER = re.compile(r"[0-9@]|(?<![^\W\d_])(?:at|AT|dot|DOT)(?![^\W\d_])")
_CUES = frozenset("at dot tel phone call fax mobile cell email mail e contact card visa ip host server version section page chapter in of on fig table no nr com org net example".split())
_FEATURES = 10


def _shape(t: str) -> str:
    if t[0].isdecimal():
        return f"d{min(len(t), 5)}" if len(t) < 8 else "dd"
    if t[0].isalpha():
        return "X" if len(t) == 1 and t.isupper() else "XX" if t.isupper() else "Xx" if t[0].isupper() else "xx"
    return t if t in "@.-+()/,:;%$#'\"" else "?"


def _tokens(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, a, b)]


def _features(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    words = [text[s:e] for s, e in spans]
    shape = ["<", "<", *map(_shape, words), ">", ">"]
    cue = ["", *(w.lower() if w.lower() in _CUES else "" for w in words), ""]
    glued = [i > 0 and spans[i - 1][1] == s for i, (s, _) in enumerate(spans)] + [False]
    return [
        [f"s{x[2]}", f"g{glued[i]:d}{x[2]}", f"p{x[1]}{glued[i]:d}", f"n{x[3]}{glued[i + 1]:d}", f"q{x[0]}{x[1]}", f"r{x[3]}{x[4]}", f"t{x[1]}{x[2]}{x[3]}", f"w{cue[i + 1]}", f"v{cue[i]}", f"u{cue[i + 2]}"]
        for i in range(len(words))
        for x in [shape[i : i + 5]]
    ]


class CRF:
    """Weights of features (row 0: unknown) by label, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, features: list[list[str]]) -> np.ndarray:
        ids = np.array([[self.index.get(f, 0) for f in row] for row in features], np.int64).reshape(-1, _FEATURES)
        return self.emit[ids].sum(axis=1)

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence (token by label scores), by Viterbi over batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((k for k, x in enumerate(sequences) if len(x)), key=lambda k: len(sequences[k]))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            n = np.array([len(sequences[k]) for k in part])
            x = np.zeros((len(part), n[-1], len(LABELS)))
            for r, k in enumerate(part):
                x[r, : n[r]] = sequences[k]
            back = np.zeros(x.shape, np.int8)
            v = x[:, 0] + _START
            for t in range(1, n[-1]):
                step = v[:, :, None] + self.move
                back[:, t] = step.argmax(axis=1)
                best = step.max(axis=1) + x[:, t]
                v = np.where((t < n)[:, None], best, v)
            label = v.argmax(axis=1)
            paths = np.zeros(x.shape[:2], np.int64)
            for t in range(n[-1] - 1, -1, -1):
                inside = t < n
                paths[inside, t] = label[inside]
                if t:
                    label = np.where(inside, back[np.arange(len(part)), t, label], label)
            for r, k in enumerate(part):
                out[k] = paths[r, : n[r]]
        return out


_BAD = -1e4
_START = np.array([_BAD if x[0] == "I" else 0.0 for x in LABELS])
_ALLOWED = np.array([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS])


def labelled_table(rows: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small table that the field is trained on: texts with their spans, drawn from templates."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["the", "an", "re", "lo", "mi", "tion", "er", "in", "da", "su", "os", "ve"]) for _ in range(rng.randint(1, 4)))
    name = lambda: rng.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}.{d(2)}"])
    tld = lambda: rng.choice(["com", "org", "net", "de", "fr", "es"])
    made = {
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(4)} {d(3)}", lambda: f"{d(3)} {d(3)} {d(4)}"],
        "email": [lambda: f"{name()}@{word()}.{tld()}", lambda: f"{name()}@{word()}{d(1)}.{word()}.{tld()}", lambda: f"{word()} at {word()} dot {tld()}", lambda: f"{word()} [at] {word()} [dot] {tld()}", lambda: f"{word()} AT {word()} DOT {tld()}", lambda: f"{word()} (at) {word()} (dot) {tld()}"],
        "ip": [lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))],
        "card": [lambda: " ".join(d(4) for _ in range(4)), lambda: "-".join(d(4) for _ in range(4))],
    }
    cues = {"phone": ["call", "tel", "phone:", "fax", "", "", "mobile", "or"], "email": ["mail", "email:", "contact", "", ""], "ip": ["ip", "host", "from", ""], "card": ["card", "visa", ""]}
    other = [
        lambda: f"version {d(1)}.{d(1)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(16)}", lambda: f"page {d(2)} of {d(3)}", lambda: f"section {d(1)}.{d(1)}.{d(1)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"in {d(4)}", lambda: f"{d(2)} {word()}", lambda: f"{word()} at {word()}", lambda: f"CC BY-NC {d(1)}.{d(1)}", lambda: f"{d(3)}-{d(2)}", lambda: f"@{word()}", lambda: f"{d(8)}", lambda: f"{d(5)}", lambda: f"no {d(3)}-{d(3)}",
        lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}%", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"table {d(1)}", lambda: f"{word()} dot {word()}", lambda: f"{d(6)}-{d(2)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(16)} {d(16)}",
    ]
    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word().capitalize() if rng.random() < 0.2 else word() for _ in range(rng.randint(1, 5))) + rng.choice([" ", " ", ", ", ". "])
            if rng.random() < 0.55:
                kind = rng.choice(["phone", "phone", "email", "email", "ip", "card"])
                cue = rng.choice(cues[kind])
                text += cue + " " * bool(cue)
                value = rng.choice(made[kind])()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = rng.choice(other)()
            text += value + rng.choice([" ", " ", ".", ", ", ") "])
            text += "" if text[-1] == " " else " "
        table.append((text + word(), spans))
    return table


def train(table: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 70, decay: float = 2e-3, rate: float = 0.15) -> CRF:
    """Maximises the penalised likelihood of the table by Adam; all sequences make one batch."""
    rows = []
    index: dict[str, int] = {}
    for text, spans in table:
        at = _tokens(text, 0, len(text))
        labels = [0] * len(at)
        for kind, s, e in spans:
            first = True
            for i, (a, b) in enumerate(at):
                if a >= s and b <= e:
                    labels[i] = LABELS.index(f"{'B' if first else 'I'}-{kind}")
                    first = False
        feats = _features(text, at)
        rows.append(([[index.setdefault(f, len(index) + 1) for f in x] for x in feats], labels))
    n, size, most = len(rows), len(LABELS), max(len(r[1]) for r in rows)
    ids, y, mask = np.zeros((n, most, _FEATURES), np.int64), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for k, (f, lab) in enumerate(rows):
        ids[k, : len(f)], y[k, : len(f)], mask[k, : len(f)] = f, lab, True
    emit, move = np.zeros((len(index) + 1, size)), np.zeros((size, size))
    penalty = np.where(_ALLOWED, 0.0, _BAD)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, move)]
    start, later, flat = np.exp(_START), mask[:, 1:], ids[mask].ravel()
    for step in range(1, rounds + 1):
        x, tr = np.zeros((n, most, size)), np.exp(move + penalty)
        x[mask] = emit[ids[mask]].sum(axis=1)
        # forward and backward with each step scaled to a sum of one
        here = np.exp(x - x.max(axis=2, keepdims=True))
        alpha, beta, scale = np.zeros((n, most, size)), np.ones((n, most, size)), np.ones((n, most, 1))
        for t in range(most):
            a = here[:, t] * (alpha[:, t - 1] @ tr if t else start)
            scale[:, t] = np.where(mask[:, t, None], a.sum(axis=1, keepdims=True), 1.0)
            alpha[:, t] = np.where(mask[:, t, None], a / scale[:, t], 0.0)
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], (here[:, t + 1] * beta[:, t + 1] / scale[:, t + 1]) @ tr.T, 1.0)
        p = alpha * beta
        pair = tr * (alpha[:, :-1][later].T @ (here * beta / scale)[:, 1:][later])
        gold = np.zeros_like(p)
        gold[np.arange(n)[:, None], np.arange(most), y] = 1
        diff = ((gold - p) / n)[mask]
        g = np.stack([np.bincount(flat, np.repeat(diff[:, k], _FEATURES), len(emit)) for k in range(size)], axis=1)
        g[0] = 0
        true = np.zeros((size, size))
        np.add.at(true, (y[:, :-1][later], y[:, 1:][later]), 1)
        grads = (g - decay * emit / 10, np.where(_ALLOWED, (true - pair) / n, 0.0) - decay * move / 10)
        for w, grad, (m1, m2) in zip((emit, move), grads, state):
            m1[...] = 0.9 * m1 + 0.1 * grad
            m2[...] = 0.99 * m2 + 0.01 * grad * grad
            w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return CRF(index, emit, move + penalty)


@cache
def trained() -> CRF:
    """The field that ``labelled_table()`` gives, trained once in a process."""
    return train(labelled_table())


def _holds(kind: str, value: str) -> bool:
    digits = _NOT_DIGIT.sub("", value)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and bool(re.search(r"[\x20().-]", value))
    if kind == "email":
        return len(value) <= 254 and bool(_ADDRESS.fullmatch(value) or _SPELLED.fullmatch(value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", value)) and all(map(_byte, value.split(".")))
    return 16 <= len(digits) <= 19 and _luhn(digits)


_SPACE = re.compile(r"\s")


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() + REACH <= out[-1][1]:
            continue
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        # whole words: an address of any length is seen to its ends
        while s > (out[-1][1] if out else 0) and not text[s - 1].isspace():
            s -= 1
        if e < len(text) and not text[e - 1].isspace():
            gap = _SPACE.search(text, e)
            e = gap.start() if gap else len(text)
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def tag(texts: list[str], crf: CRF) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text, whatever the patterns say."""
    where, tokens, scores = [], [], []
    for k, text in enumerate(texts):
        for a, b in neighbourhoods(text):
            at = _tokens(text, a, b)
            if at:
                where.append(k)
                tokens.append(at)
                scores.append(crf.scores(_features(text, at)))
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, at, labels in zip(where, tokens, crf.decode(scores)):
        i = 0
        while i < len(at):
            name = LABELS[labels[i]]
            j = i + 1
            if name[0] == "B":
                while j < len(at) and LABELS[labels[j]] == "I" + name[1:]:
                    j += 1
                s, e = at[i][0], at[j - 1][1]
                if _holds(name[2:], texts[k][s:e]):
                    found[k].append((name[2:], s, e))
            i = j
    return found


def scan(documents: DataFrame, crf: CRF | None = None) -> DataFrame:
    """doc_id and the spans of each document: array of structs of kind, start, end and base (found by a pattern), by kind,
    then start."""
    sent = documents.sparkSession.sparkContext.broadcast(crf or trained())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                rows = []
                for text, more in zip(texts, tag(texts, sent.value)):
                    base = patterns(text)
                    taken = sorted((s, e) for _, s, e in base)
                    new = [x for x in more if not any(a < x[2] and x[1] < c for a, c in taken)] if taken else more
                    spans = sorted([(KINDS.index(k), s, e, True) for k, s, e in base] + [(KINDS.index(k), s, e, False) for k, s, e in new])
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": f} for k, s, e, f in spans])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")
