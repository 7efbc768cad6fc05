"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Normalisation lower-cases A-Z and takes as words the runs of digits, letters a-z and characters beyond ASCII. A window
is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document word
inside any occurrence of a window is hit.

The benchmark is a stated query set. It is never assumed to be small: its items are split by a hash into blocks of about
``block_windows`` windows at most (or one item), the windows of one block at a time are collected and broadcast, and each
block scans all documents. A window takes about 24 bytes and 16 bits of a bitmap beside the text of the items, so a
block has about 200 MB. One block is the usual case; with more, the results of the blocks are merged by document row. Documents
are only scanned: with one block nothing is shuffled.

Nulls: a null text has no words, so it is never hit; a null item text has none either; rows with a null doc_id are kept
and returned with it; a null item_id is written as an empty string. An empty benchmark hits nothing, and an empty
documents table gives an empty result. Repeated rows each give a row. Further columns of the input are ignored by
``scan`` and kept by ``clean``. The length of a text is not limited.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, materialize, only, pieces, runs, text_bytes

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")

SCAN_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def normalise(text: bytes | None) -> bytes:
    return b" ".join(text.translate(_TABLE).split()) if text else b""


class NGrams:
    """The windows of a block of benchmark items. For each length: their hashes in order, where each stands in the items' text,
    its item, and a bitmap over the hashes."""

    def __init__(self, items: Iterable[tuple[str, str | None]], n: int):
        self.names: list[str] = []
        texts: list[bytes] = []
        for item, text in items:
            if norm := normalise((text or "").encode()):
                self.names.append(item)
                texts.append(norm)
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        base = 0
        for a, b in blocks(texts):
            w = Words(texts[a:b])
            size = np.diff(w.first)
            for m in np.unique(np.minimum(size, n)).tolist():
                at, text = w.windows(m)
                if m < n:  # items of just so many words
                    mine = size[text] == m
                    at, text = at[mine], text[mine]
                found.setdefault(m, []).append((w.hashes(m)[at], (w.start[at] + base).astype(np.int64), (w.end[at + m - 1] - w.start[at]).astype(np.int32), (text + a).astype(np.int32)))
            base += len(w.buf) + 1
        self.buf = b"\n".join(texts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for m, parts in sorted(found.items()):
            h, start, size, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << min(27, max(16, len(h).bit_length() + 4)), bool)
            bitmap[self._bit(h, bitmap)] = True
            self.by_length[m] = np.packbits(bitmap), h[order], start[order], size[order], item[order]
        self._made: dict[int, np.ndarray] = {}
        self._known: dict[tuple[int, int], tuple[bytes, set[str]]] = {}

    @staticmethod
    def _bit(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(bitmap) - 1)).astype(np.int64)

    def __getstate__(self):
        return self.names, self.buf, self.by_length

    def __setstate__(self, state):
        self.names, self.buf, self.by_length = state
        self._made, self._known = {}, {}

    def _items(self, m: int, lo: int, hi: int, gram: bytes) -> set[str]:
        """The items that have this window, one of those in the range of its hash."""
        if hi - lo > 4 and (known := self._known.get((m, lo))) and known[0] == gram:
            return known[1]
        _, _, start, size, item = self.by_length[m]
        got = {self.names[item[j]] for j in range(lo, hi) if self.buf[start[j] : start[j] + size[j]] == gram}
        if hi - lo > 4:
            self._known[m, lo] = gram, got
        return got

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items of each text."""
        hit = np.zeros(len(words.start) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for m, (packed, known, *_) in self.by_length.items():
            at, text = words.windows(m)
            if not len(at):
                continue
            if m not in self._made:
                self._made[m] = np.unpackbits(packed).view(bool)
            h = words.hashes(m)[at]
            maybe = np.flatnonzero(self._made[m][self._bit(h, self._made[m])])
            lo, hi = (np.searchsorted(known, h[maybe], side) for side in ("left", "right"))
            for k, x, y in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                a = int(at[k])
                if got := self._items(m, x, y, words.buf[words.start[a] : words.end[a + m - 1]]):
                    hit[a] += 1
                    hit[a + m] -= 1
                    items[text[k]].update(got)
        return np.cumsum(hit[:-1]) > 0, items


def _blocks_of(benchmark: DataFrame, n: int, block_windows: int) -> tuple[int, Iterator[NGrams]]:
    """The number of blocks, and the blocks, each made when it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    windows = F.greatest(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.expr("octet_length(text) div 8"))
    size = items.agg(F.coalesce(F.sum(windows), F.lit(0))).head()[0]
    count = max(1, -(-size // block_windows))
    parts = [items] if count == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]
    return count, (NGrams(((r.item_id, r.text) for r in part.toLocalIterator()), n) for part in parts)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan_block(documents: DataFrame, sent: Broadcast) -> DataFrame:

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = text_bytes(batch.column(2))
            n_words, spans, found = [], [], []
            for a, b in blocks(texts):
                words = Words([normalise(t) for t in texts[a:b]])
                hit, items = sent.value.hits(words)
                n_words += np.diff(words.first).tolist()
                for d, got in enumerate(items):
                    s, e = runs(hit[words.first[d] : words.first[d + 1]]) if got else ((), ())
                    spans.append([int(x) for p in zip(s, e) for x in p])
                    found.append(sorted(got))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "h", "n_words", "spans", "items"])

    return documents.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(scan, "doc_id bigint, h bigint, n_words bigint, spans array<bigint>, items array<string>")


def _result(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = []
        for s in b.column(2).to_pylist():
            pairs, n, upto = sorted(zip(s[0::2], s[1::2])), 0, 0
            for x, y in pairs:
                n += max(0, y - max(x, upto))
                upto = max(upto, y)
            hit.append(n)
        items = [set(x) for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array([n > 0 for n in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def scan(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = 4_000_000) -> DataFrame:
    """One row per document: its words, its hit words, the items whose windows occur in it."""
    documents = only(documents, "doc_id", "text")
    sc = documents.sparkSession.sparkContext
    count, found = _blocks_of(benchmark, n, block_windows)
    if count == 1:
        merged = _scan_block(documents, sc.broadcast(next(found))).select("doc_id", "n_words", "spans", "items")
    else:
        every = None
        for grams in found:
            # equal rows have equal results in every block: each block's count of a row gives its copies back. A block's result
            # is written before the next block is made, so that the driver holds one at a time
            sent = sc.broadcast(grams)
            part = materialize(_scan_block(documents, sent).groupBy("doc_id", "h", "n_words", "spans", "items").agg(F.count(F.lit(1)).alias("copies")), "block-hits")
            sent.destroy()
            every = part if every is None else every.unionByName(part)
        merged = every.groupBy("doc_id", "h", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("copies").alias("copies"))
        merged = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "spans", "items")
    return merged.mapInArrow(_result, SCAN_SCHEMA)


def _cut(text: str, grams: list[NGrams]) -> str:
    """The text without its hit spans. What a cut brings together is looked at again."""
    while True:
        at = [m.span() for m in _WORD.finditer(text)]
        words = Words([normalise(text.encode())])
        hit = np.zeros(len(at), bool)
        for g in grams:
            hit |= g.hits(words)[0]
        if not hit.any():
            return text
        out, upto = [], 0
        for s, e in zip(*runs(hit)):
            out.append(text[upto : at[s][0]])
            upto = at[e - 1][1]
        text = "".join(out) + text[upto:]


def clean(documents: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "drop", block_windows: int = 4_000_000) -> DataFrame:
    """The documents with all their columns. ``drop`` leaves out every document with a hit; ``remove`` takes the hit
    spans (from the first to the last character of a run of hit words) out of its text and keeps the rest."""
    if action not in ("drop", "remove"):
        raise ValueError(f"action is drop or remove, not {action!r}")
    schema, out = documents.schema, documents
    count, found = _blocks_of(benchmark, n, block_windows)
    for grams in found:
        sent = documents.sparkSession.sparkContext.broadcast(grams)
        k = schema.names.index("text")

        def apply(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                texts = text_bytes(batch.column(k))
                dirty = np.zeros(len(texts), bool)
                for a, b in blocks(texts):
                    words = Words([normalise(t) for t in texts[a:b]])
                    dirty[a:b] = [bool(x) for x in sent.value.hits(words)[1]]
                if action == "drop":
                    yield batch.filter(pa.array(~dirty))
                elif dirty.any():
                    new = [_cut(t.decode(), [sent.value]).encode() if d else t for t, d in zip(texts, dirty)]
                    yield batch.set_column(k, batch.schema.field(k), pa.array(new, pa.large_binary()).cast(batch.schema.field(k).type))
                else:
                    yield batch

        out = out.mapInArrow(apply, schema)
        if count > 1:
            out = materialize(out, "block-cleaned")
            sent.destroy()
    return out
