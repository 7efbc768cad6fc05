"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised, closed with an end id, and routed to the smallest context-size tier that holds them; what is
longer than the largest tier is cut into full windows of it first. Then each tier is packed, largest first: a document
opens a window of its tier, the longest shorter documents that fit fill the gap, and where none fits a shorter one is
cut to fill it. So every sequence is full (a tier is a power of two) except the last of a task, which is split into
tiers as far as it goes. Sequences of one tier are dealt to step groups of equal token counts so that their attention
costs (the sum of squared piece lengths) are level.

Each task packs the documents it reads, in buffers of about ``buffer_tokens``: nothing is shuffled, nothing is
unbounded, and a lost task repeats with the same result, as its input split, its order and so its sequence ids are
fixed. Padding is at most one sequence per task.

Ids are those of ``tokenizers`` with its JSON file, as it comes: the string of a special token in a text is that token's
id. tiktoken with the same vocabulary as ranks gives the same ids (tests compare them) in about a seventh of the time;
texts that hold a special token's string, or a run of over ``LONG_RUN`` characters where its merging is slow, go to
``tokenizers`` itself.

Nulls: a null text is an empty one, which is the end id alone; a null doc_id is kept. Repeated rows are packed each on
its own. An empty table gives an empty result. Further columns are ignored. The length of a text is not limited.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only, pieces, tokenizer_path

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 2000
_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


@cache
def ranks_encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def json_encoder(path: str):
    """The tokenizer, and what finds the strings of its special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    return t, re.compile("|".join(map(re.escape, special)) if special else r"(?!)")


def token_ids(text: str, folder: str | None = None, name: str = "byte_bpe_50k") -> np.ndarray:
    encoder, special = json_encoder(tokenizer_path(f"{name}.json", folder))
    if special.search(text) or _LONG.search(text):
        return np.array(encoder.encode(text, add_special_tokens=False).ids, np.uint32)
    return ranks_encoder(tokenizer_path(f"{name}.tiktoken", folder)).encode_to_numpy(text, disallowed_special=())


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def __lt__(self, other: _Piece) -> bool:
        return len(self.ids) < len(other.ids)

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Packs pieces into lists of pieces, each a sequence of at most the largest tier."""

    def __init__(self, tiers: tuple[int, ...], buffer_tokens: int):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are ascending powers of two")
        self.tiers, self.limit = tiers, buffer_tokens
        self.pool: list[_Piece] = []
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list[_Piece]]:
        top, n = self.tiers[-1], len(ids)
        full = n - n % top
        for a in range(0, full, top):
            yield [_Piece(doc, a, ids[a : a + top], n)]
        if full < n:
            self.pool.append(_Piece(doc, full, ids[full:], n))
            self.held += n - full
            if self.held >= self.limit:
                yield from self.pack(False)

    def _fill(self, window: list[_Piece], room: int, shorter: list[_Piece]) -> int:
        """Adds pieces of the sorted ``shorter`` to the window; the last may be cut. Returns the room that is left."""
        lengths = [len(p) for p in shorter] if len(shorter) < 8 else None
        while room and shorter:
            k = bisect_right(lengths, room) if lengths else bisect_right(shorter, room, key=len)
            if k:
                p = shorter.pop(k - 1)
                if lengths:
                    lengths.pop(k - 1)
                room -= len(p)
            else:
                p, rest = shorter.pop(0).cut(room)
                insort(shorter, rest)
                room, lengths = 0, None
            window.append(p)
        return room

    def pack(self, last: bool) -> Iterator[list[_Piece]]:
        pool, self.pool, self.held = sorted(self.pool), [], 0
        for low, tier in reversed(list(zip((0, *self.tiers), self.tiers))):
            while pool and len(pool[-1]) > low:
                p = pool.pop()
                window = [p]
                if self._fill(window, tier - len(p), pool):
                    pool = window  # nothing is left to fill it with
                    break
                yield window
            else:
                continue
            break
        if not last:
            self.pool, self.held = pool, sum(map(len, pool))
            return
        for tier in reversed(self.tiers):
            while sum(map(len, pool)) >= tier:
                window, room = [], tier
                while room:
                    p = pool.pop(0)
                    if len(p) > room:
                        p, rest = p.cut(room)
                        pool.insert(0, rest)
                    window.append(p)
                    room -= len(p)
                yield window
        if pool:
            yield pool


def padded(n: int, top: int) -> int:
    """Length of a sequence of n tokens with its padding: none at a power of two."""
    return n if not n & (n - 1) else top


def _steps(sequences: Iterable[list[_Piece]], step_tokens: int, top: int, groups: int = 8) -> Iterator[tuple[int, list[_Piece]]]:
    """Deals the sequences of each length to step groups, ``groups`` of them at a time: sorted by cost, there and back."""
    waiting: dict[int, list[list[_Piece]]] = {}
    made = 0

    def deal(size: int, seqs: list[list[_Piece]]) -> Iterator[tuple[int, list[_Piece]]]:
        nonlocal made
        n = -(-len(seqs) * size // step_tokens)
        for k, s in enumerate(sorted(seqs, key=lambda s: -sum(len(p) ** 2 for p in s))):
            at = k % (2 * n)
            yield made + min(at, 2 * n - 1 - at), s
        made += n

    for s in sequences:
        size = padded(sum(map(len, s)), top)
        w = waiting.setdefault(size, [])
        w.append(s)
        if len(w) * size >= groups * step_tokens:
            yield from deal(size, w)
            waiting[size] = []
    for size, w in waiting.items():
        if w:
            yield from deal(size, w)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


def pack(
    documents: DataFrame, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 1 << 15, buffer_tokens: int = 1 << 20,
    tokenizer_dir: str | None = None, tokenizer: str = "byte_bpe_50k", with_ids: bool = False,
) -> DataFrame:
    """A row per piece: document, first token and length there, checksum, sequence and offset there, tier (the length
    that the sequence is padded to) and step group; with its token ids on demand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        packer = Packer(tiers, buffer_tokens)
        end = np.array([end_id], np.uint32)

        def sequences() -> Iterator[list[_Piece]]:
            for b in pieces(batches):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield from packer.add(doc, np.concatenate((token_ids(text, tokenizer_dir, tokenizer), end)) if text else end)
            yield from packer.pack(True)

        cols: list[list] = [[] for _ in range(9 + with_ids)]
        for number, (group, seq) in enumerate(_steps(sequences(), step_tokens, tiers[-1])):
            offset, tier = 0, padded(sum(map(len, seq)), tiers[-1])
            for p in seq:
                row = (p.doc, p.start, len(p), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, base + number, offset, tier, base + group)
                for c, v in zip(cols, (*row, p.ids.astype(np.int32)) if with_ids else row):
                    c.append(v)
                offset += len(p)
            if len(cols[0]) > 5000:
                yield batch(cols)
                cols = [[] for _ in cols]
        yield batch(cols)

    def batch(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    schema = SCHEMA + ", ids array<int>" * with_ids
    return only(documents, "doc_id", "text").mapInArrow(run, schema)
