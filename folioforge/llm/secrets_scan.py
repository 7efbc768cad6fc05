"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

The patterns (offsets in code points, end exclusive):

* ``assign``: a name such as password or api_key, an assignment sign, and a value of 8 or more characters,
* ``access``: AKIA and capitals or digits, 16 or more characters in all,
* ``hex``: 32 or more of 0-9a-f.

Per kind, matches are leftmost and don't overlap; one that is too short is dropped and not tried again inside.

The test: runs of 16 or more characters of ``[A-Za-z0-9+/_=-]`` are tokenised with a byte-level BPE vocabulary. Words and
names take few tokens for their length; random strings have few characters per token. A run under ``max_ratio`` characters a
token is a ``random`` span; of two or three long runs joined by dots (JSON web tokens) all together are one. Runs of letters of
one case alone, which rare words can look like, count from 24 letters and under ``word_ratio``. Long runs are encoded in
pieces of ``PIECE`` characters, and counted as one. Left out are:

* known digests: hexadecimal of the length of MD5, SHA-1, SHA-224, SHA-256, SHA-384 or SHA-512 (``hex`` has small letters already),
* identifiers: UUIDs, numbers and dates, names of short parts of letters alone or digits alone, runs of fewer than 8 different
  characters,
* places: paths (three slashes or more, or two and one of them first, between short parts), names of files (a dot and a short
  extension follow), mail addresses, and URLs but for the password before their @,
* what overlaps a span of the patterns.

Nulls: a null text is an empty one; a null doc_id is kept. Repeated rows each give a row. An empty table gives an empty
result. Further columns are ignored. Texts are scanned whole; all patterns take time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, tokenizer_path
from .packing import ranks_encoder

KINDS = ("assign", "access", "hex", "random")
PIECE = 512
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_URL = re.compile(r"://([^\s<>\"']*)")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_PARTS = re.compile(r"(?:[A-Za-z]{1,19}|[0-9]+)(?:[-_=+/]+(?:[A-Za-z]{1,19}|[0-9]+))+[-_=+/]*\Z|[-_=+/]*[0-9]*\Z")
_FILE = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,4}(?![A-Za-z0-9+/_=-])")
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}


def _is_known(run: str) -> bool:
    """Whether the run is a digest, an identifier or a path rather than a secret."""
    if len(set(run)) < 8 or _UUID.fullmatch(run) or _PARTS.match(run):
        return True
    slashes = run.count("/")
    if (slashes > 2 or slashes == 2 and run[0] == "/") and max(map(len, run.split("/"))) < 16:
        return True
    return len(run) in _DIGEST_SIZES and bool(_DIGEST.match(run))


def _addresses(text: str) -> list[tuple[int, int]]:
    """Where URLs stand, without the passwords in them."""
    out = []
    for m in _URL.finditer(text):
        s, e = m.span(1)
        host = m[1].partition("/")[0]
        user, at, _ = host.rpartition("@")
        if at and ":" in user:
            out.append((m.start(), s + user.index(":") + 1))
            s += len(user)
        out.append((s, e))
    return out


def _joined(text: str) -> Iterator[tuple[int, int]]:
    """Long runs, up to three of them joined by single dots."""
    whole: list[int] = []
    for m in _RUN.finditer(text):
        if whole and m.start() == whole[1] + 1 and text[whole[1]] == "." and whole[2] < 3:
            whole[1], whole[2] = m.end(), whole[2] + 1
            continue
        if whole:
            yield whole[0], whole[1]
        whole = [*m.span(), 1]
    if whole:
        yield whole[0], whole[1]


def _is_random(run: str, encoder, max_ratio: float, word_ratio: float) -> bool:
    joined = run.replace(".", "")
    if joined.isalpha() and (joined[1:].islower() or joined.isupper()):
        if len(joined) < 24:
            return False
        joined, max_ratio = joined.lower(), word_ratio
    n = sum(len(encoder.encode_ordinary(joined[i : i + PIECE])) for i in range(0, len(joined), PIECE))
    return len(joined) < max_ratio * n


def find(text: str, encoder, max_ratio: float = 2.0, word_ratio: float = 1.9) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then kind."""
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    taken = sorted([(s, e) for _, s, e in spans] + (_addresses(text) if "://" in text else []))
    k = 0
    upto = 0  # the furthest end of what is taken and begins before this run
    for s, e in _joined(text):
        while k < len(taken) and taken[k][0] < e:
            upto = max(upto, taken[k][1])
            k += 1
        run = text[s:e]
        if upto > s or _is_known(run) or _FILE.match(text, e):
            continue
        if text[e : e + 1] == "@" and text[s - 1 : s] != ":" or text[max(0, s - 1) : s] == "@":
            continue
        if _is_random(run, encoder, max_ratio, word_ratio):
            spans.append(("random", s, e))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(documents: DataFrame, max_ratio: float = 2.0, word_ratio: float = 1.9, tokenizer_dir: str | None = None, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and the spans of each document: array of structs of kind, start and end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        encoder = ranks_encoder(tokenizer_path(f"{tokenizer}.tiktoken", tokenizer_dir))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py() or "", encoder, max_ratio, word_ratio)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")
