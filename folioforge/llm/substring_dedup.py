"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Each word covered by a window whose word sequence also
starts in a document with a smaller doc_id is removed; windows are judged on the input.

Every window has a minimiser: the least hash of its runs of ``m`` words. Consecutive windows sharing it form a
super-k-mer, and equal windows always have equal minimisers, so each minimiser is a bucket that can be counted alone:

1. One pass over the texts makes a row of digests per super-k-mer. A first aggregation by minimiser (combined before
   the shuffle, so a text copied a million times sends a row per task) tells which minimisers lie in one document only:
   these are done. Where all super-k-mers of a minimiser are the same string, all but the copies with the least doc_id
   are covered and nothing else travels.
2. For the rest, each distinct super-k-mer travels once, as one packed string, to the bucket of its minimiser. There
   the strings are sorted by doc_id, and each window (the words themselves, not a hash) is counted under the first
   document that has it. A bucket of more than ``hot_rows`` distinct strings is split into its windows: each becomes a row with
   a 128-bit digest, at most ``LONGEST`` for a string, and the first document of each digest is found by an aggregate.
3. The covered spans are joined to their documents. Texts travel compressed.

Joins by minimiser or document key hold at most one row per key on one side, so the engine can split a hot key's other
side. The tables between the steps are written to the shared folder.

Nulls: a null text has no words; a row with a null doc_id has no order among documents, so it neither loses words nor
makes others lose any. Rows with the same doc_id are one document for the order: they don't cover each other. Exact
repeated rows give a result row each. Texts of fewer words than the window are returned whole. An empty table gives an
empty result. Further columns are ignored. The length of a text is not limited: one of over ``SEGMENT`` words is
worked on in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, materialize, only, pieces, text_bytes

SEGMENT = 200_000
#: Windows in one super-k-mer at most; longer ones (texts of one repeated word) are cut.
LONGEST = 64

_KMERS = "doc_id bigint, h bigint, mkey bigint, p1 bigint, p2 bigint, start int, n int"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of x[i:i+k] for each i, in log k steps."""
    width, best = 1, x
    while width * 2 <= k:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    return np.minimum(best[: len(best) - (k - width)], best[k - width :]) if k > width else best


def super_kmers(words: Words, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (counted in the buffer), number of windows, and minimiser of each super-k-mer."""
    at, text = words.windows(window)
    if not len(at):
        return at, at, at, at
    least = _sliding_min(words.hashes(m), window - m + 1)[at]
    new = np.concatenate(([True], (np.diff(text) != 0) | (least[1:] != least[:-1])))
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate((first, [len(at)]))))
    first = np.flatnonzero(inside % LONGEST == 0)
    return text[first], at[first], np.diff(np.concatenate((first, [len(at)]))), least[first]


def _segments(texts: list[bytes | None], window: int) -> tuple[list[bytes], list[int], list[int]]:
    """Normalised texts, the row of each and its first word's place; very long ones in overlapping parts."""
    out, row, base = [], [], []
    for i, t in enumerate(texts):
        words = t.split() if t else []
        for a in range(0, max(1, len(words) - window + 1), SEGMENT):
            out.append(b" ".join(words[a : a + SEGMENT + window - 1] if len(words) > SEGMENT else words))
            row.append(i)
            base.append(a)
            if len(words) <= SEGMENT:
                break
    return out, row, base


def _kmers_of(window: int, m: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = text_bytes(batch.column(2))
            for a, b in blocks(texts):
                parts, row, base = _segments(texts[a:b], window)
                w = Words(parts)
                text, first, n, mkey = super_kmers(w, window, m)
                if not len(text):
                    continue
                lo, hi = w.start[first].tolist(), w.end[first + n + window - 2].tolist()
                buf = w.buf
                digest = np.frombuffer(b"".join([hashlib.blake2b(buf[s:e], digest_size=16).digest() for s, e in zip(lo, hi)]), np.int64).reshape(-1, 2)
                rows = pa.array(np.array(row)[text] + a)
                start = first - w.first[text] + np.array(base)[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(mkey.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "h", "mkey", "p1", "p2", "start", "n"],
                )

    return scan


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in pieces(batches):
        z = [pack(b" ".join(t.split()) if t else b"") for t in text_bytes(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["doc_id", "h", "z"])


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _strings(window: int):
    """The wanted super-k-mers as packed strings."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cols: list[list] = [[] for _ in range(5)]
            size = 0
            for doc, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _unpack(z).split()
                for x in wanted:
                    s = b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1])
                    size += len(s)
                    for c, v in zip(cols, (x["mkey"], x["p1"], x["p2"], doc, s)):
                        c.append(v)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT_TYPES)], names=_CUT_NAMES)
                    cols, size = [[] for _ in range(5)], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT_TYPES)], names=_CUT_NAMES)

    return cut


_CUT_NAMES = ["mkey", "p1", "p2", "doc_id", "packed"]
_CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _windows(window: int):
    """The windows of the wanted super-k-mers: document, place in the string, and a digest."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 100):
            keys: list[list[int]] = [[] for _ in range(5)]
            digests: list[bytes] = []

            def flush() -> pa.RecordBatch:
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in keys), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["mkey", "p1", "p2", "doc_id", "i", "w1", "w2"])

            for doc, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _unpack(z).split()
                for x in wanted:
                    for i in range(x["n"]):
                        a = x["start"] + i
                        digests.append(hashlib.blake2b(b" ".join(words[a : a + window]), digest_size=16).digest())
                        for c, v in zip(keys, (x["mkey"], x["p1"], x["p2"], doc, i)):
                            c.append(v)
                if len(digests) > 50_000:
                    yield flush()
                    keys, digests = [[] for _ in range(5)], []
            yield flush()

    return cut


def _count(window: int):
    """Rows come sorted by minimiser and doc_id: the first row with a window is the first document with it."""

    def bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, {}
        for batch in pieces(batches):
            out: list[tuple] = []
            for mkey, p1, p2, doc, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if mkey != key:
                    key, seen = mkey, {}
                gaps = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
                spans: list[int] = []
                for i in range(len(gaps) - window):
                    if seen.setdefault(packed[gaps[i] + 1 : gaps[i + window]], doc) < doc:
                        if spans and spans[-1] == i:
                            spans[-1] = i + 1
                        else:
                            spans += i, i + 1
                if spans:
                    out.append((mkey, p1, p2, spans))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int32()))], names=["mkey", "p1", "p2", "spans"])

    return bucket


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        n, cut, kept = [], [], []
        for z, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            norm = _unpack(z)
            words = norm.split()
            n.append(len(words))
            if spans:
                out, upto = [], 0
                for x in sorted((s["s"], s["e"]) for s in spans):
                    if x[0] > upto:
                        out += words[upto : x[0]]
                    upto = max(upto, x[1])
                out += words[upto:]
                cut.append(len(words) - len(out))
                kept.append(b" ".join(out))
            else:
                cut.append(0)
                kept.append(norm)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def covered_spans(documents: DataFrame, window: int = 50, m: int = 8, hot_rows: int = 2000, packed: DataFrame | None = None) -> DataFrame:
    """doc_id, h (hash of the text) and the covered word spans [s, e) of each document that has any."""
    if not 1 <= m <= window:
        raise ValueError("m lies between 1 and the window")
    docs = only(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h"), "text")
    packed = docs.mapInArrow(_packed, "doc_id bigint, h bigint, z binary") if packed is None else packed
    kmers = docs.filter("doc_id is not null and text is not null").mapInArrow(_kmers_of(window, m), _KMERS)
    by_key = kmers.groupBy("mkey").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *(f(c).alias(f"{n}_{c}") for c in ("p1", "p2") for n, f in (("min", F.min), ("max", F.max)))
    )
    by_key = by_key.filter("least < most").select("mkey", "least", F.expr("min_p1 <> max_p1 or min_p2 <> max_p2").alias("varied"))
    shared = kmers.join(by_key, "mkey").filter("varied or doc_id > least")
    shared = materialize(shared.select(*kmers.columns, "varied"), "super-kmers")

    varied = shared.filter("varied").drop("varied")
    first = varied.groupBy("mkey", "p1", "p2").agg(F.min(F.struct("doc_id", "h", "start", "n")).alias("f"))
    hot = materialize(first.groupBy("mkey").count().filter(F.col("count") > hot_rows).select("mkey"), "hot-minimisers")

    def wanted(of: DataFrame) -> DataFrame:
        rows = of.select("mkey", "p1", "p2", "f.*").groupBy("doc_id", "h").agg(F.collect_list(F.struct("mkey", "p1", "p2", "start", "n")).alias("wanted"))
        return packed.join(rows, ["doc_id", "h"]).select("doc_id", "z", "wanted")

    cold = wanted(first.join(hot, "mkey", "left_anti")).mapInArrow(_strings(window), "mkey bigint, p1 bigint, p2 bigint, doc_id bigint, packed binary")
    spans = cold.repartition("mkey").sortWithinPartitions("mkey", "doc_id").mapInArrow(_count(window), "mkey bigint, p1 bigint, p2 bigint, spans array<int>")
    if not hot.isEmpty():
        rows = materialize(wanted(first.join(hot, "mkey", "left_semi")).mapInArrow(_windows(window), "mkey bigint, p1 bigint, p2 bigint, doc_id bigint, i bigint, w1 bigint, w2 bigint"), "hot-windows")
        least = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
        repeated = rows.join(least, ["w1", "w2"]).filter("doc_id > first").groupBy("mkey", "p1", "p2").agg(F.collect_set(F.col("i").cast("int")).alias("at"))
        spans = spans.unionByName(repeated.select("mkey", "p1", "p2", F.flatten(F.transform("at", lambda i: F.array(i, i + 1))).alias("spans")))
    first = first.select("mkey", "p1", "p2", "f.*")
    found = first.select("mkey", "p1", "p2", F.col("doc_id").alias("owner")).join(spans, ["mkey", "p1", "p2"], "left")
    joined = varied.join(found, ["mkey", "p1", "p2"])
    whole = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + (window - 1)).alias("e"))
    later = joined.filter("doc_id > owner").select("doc_id", "h", whole.alias("x"))
    own = joined.filter("doc_id = owner and spans is not null").select("doc_id", "h", "start", F.explode(F.expr("transform(sequence(0, size(spans) - 2, 2), i -> struct(spans[i] as a, spans[i + 1] as b))")).alias("p"))
    own = own.select("doc_id", "h", F.struct((F.col("start") + F.col("p.a")).alias("s"), (F.col("start") + F.col("p.b") + (window - 1)).alias("e")).alias("x"))
    same = shared.filter("not varied").select("doc_id", "h", whole.alias("x"))
    return same.unionByName(later).unionByName(own).groupBy("doc_id", "h").agg(F.collect_set("x").alias("spans"))


def remove_repeats(documents: DataFrame, window: int = 50, m: int = 8, hot_rows: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space."""
    docs = only(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h"), "text")
    packed = docs.mapInArrow(_packed, "doc_id bigint, h bigint, z binary")
    spans = covered_spans(documents, window, m, hot_rows, packed)
    return packed.join(spans, ["doc_id", "h"], "left").select("doc_id", "z", "spans").mapInArrow(_remove, RESULT)
