"""SimHash near-dedup by anchor-point covering.

The fingerprint of a document has 64 bits, each set if it is set in over half of the XXH64 hashes of its word shingles.
Two fingerprints are linked if they differ in at most two bits; a component of links is a group of near copies.

The anchors are the codewords of a covering code, a product of perfect codes: on two pieces of 23 bits the Golay code
(covering radius 3), on one of 15 bits the Hamming code (radius 1), so 2^35 anchors from 61 of the 64 bits. Each fingerprint
has one home, its nearest anchor. If two fingerprints differ in at most two bits, then one lies within radius plus
threshold of the other's home: on the pieces it is at most i, j and k further than the radius away, with i + j + k <= 2. Each
distinct fingerprint is replicated to all these anchors (about 153), and an equi-join by anchor compares the replicas
with the anchor's own fingerprints. The anchors are found from the syndrome of each piece, by tables.

Only distinct fingerprints are compared, so copies cost nothing. Of unlike ones, about 153 * n / 2^35 are compared with each
of n fingerprints, and what one can link to is bounded by the 2,080 others within two bits. Components are found by
star contraction on tables; no links reach the driver.

Nulls: a null text has no words, and like any text without words has the fingerprint zero, which links like any other.
The component id is the least doc_id; null doc_ids don't count, so only a component of null doc_ids has a null one.
Texts of one or two words have one shingle, the whole sequence. Repeated rows each give a row. An empty table gives an
empty result. Further columns are ignored by ``groups`` and kept by ``keep_one``. The length of a text is not limited.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import Words, blocks, fresh, materialize, only, pieces, text_bytes
from .components import components

SEED = 42


class _Code:
    """A perfect cyclic code of ``bits`` bits, ``check`` of them redundant. For each syndrome, the error patterns that lead
    from such a word to a codeword within radius plus threshold, by how far they go beyond the radius."""

    def __init__(self, bits: int, check: int, generator: int, radius: int, threshold: int):
        self.bits, self.check, self.generator = bits, check, generator
        masks, beyond = [], []
        for weight in range(radius + threshold + 1):
            for places in combinations(range(bits), weight):
                masks.append(sum(1 << b for b in places))
                beyond.append(max(0, weight - radius))
        e, extra = np.array(masks, np.uint64), np.array(beyond, np.int64)
        s = self.syndrome(e)
        order = np.lexsort((extra, s))
        self.e, self.extra = e[order], extra[order]
        self.first = np.searchsorted(s[order], np.arange(1 << check))
        #: of the patterns of a syndrome, how many go at most so far beyond
        self.count = np.zeros((1 << check, threshold + 1), np.int64)
        for k in range(threshold + 1):
            self.count[:, k] = np.bincount(s[extra <= k], minlength=1 << check)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """Remainder of the words, as polynomials, by the generator."""
        x = x.copy()
        for bit in range(self.bits - 1, self.check - 1, -1):
            x = np.where((x >> np.uint64(bit)) & np.uint64(1), x ^ np.uint64(self.generator << (bit - self.check)), x)
        return x.astype(np.int64)

    def number(self, word: np.ndarray) -> np.ndarray:
        return (word >> np.uint64(self.check)).astype(np.int64)


class _Cover:
    """The product of the codes over consecutive pieces of a fingerprint."""

    def __init__(self, threshold: int):
        golay = (23, 11, 0b110001110101, 3)
        self.codes = [_Code(*golay, threshold), _Code(*golay, threshold), _Code(15, 4, 0b10011, 1, threshold)]
        self.threshold = threshold

    def _pieces(self, fp: np.ndarray) -> Iterator[tuple[_Code, np.ndarray]]:
        at = 0
        for code in self.codes:
            yield code, (fp >> np.uint64(at)) & np.uint64((1 << code.bits) - 1)
            at += code.bits

    def home(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for code, word in self._pieces(fp):
            out = (out << (code.bits - code.check)) | code.number(word ^ code.e[code.first[code.syndrome(word)]])
        return out

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the fingerprint and number of the anchor, for all anchors within reach."""
        row, left, out = np.arange(len(fp)), np.full(len(fp), self.threshold), np.zeros(len(fp), np.int64)
        for code, word in self._pieces(fp):
            s = code.syndrome(word)
            n = code.count[s[row], left]
            some = np.repeat(np.arange(len(row)), n)
            nth = np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n)
            row = row[some]
            at = code.first[s[row]] + nth
            out = (out[some] << (code.bits - code.check)) | code.number(word[row] ^ code.e[at])
            left = left[some] - code.extra[at]
        return row, out


def fingerprints(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """The fingerprints as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_digest
    for a, b in blocks(texts):
        w = Words([b" ".join(t.lower().split()) if t else b"" for t in texts[a:b]])
        n = np.diff(w.first)
        many = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        some = np.flatnonzero(many)
        if not len(some):
            continue
        skip = np.repeat(w.first[:-1] - (np.cumsum(many) - many), many)
        at = np.arange(int(many.sum())) + skip
        last = np.minimum(at + shingle - 1, np.repeat(w.first[1:] - 1, many))
        buf = w.buf
        h = b"".join([digest(buf[s:e], SEED) for s, e in zip(w.start[at].tolist(), w.end[last].tolist())])
        edge = np.cumsum(many)
        for lo in range(0, len(some), 512):
            part = some[lo : lo + 512]
            x, y = int(edge[part[0]] - many[part[0]]), int(edge[part[-1]])
            bits = np.unpackbits(np.frombuffer(h[8 * x : 8 * y], np.uint8)).reshape(-1, 64)
            at = edge[part] - many[part] - x
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            out[a + part] = np.packbits(2 * ones > many[part][:, None], axis=1).view(">u8")[:, 0]
    return out


def _fingerprint(shingle: int):
    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(text_bytes(b.column(1)), shingle).view(np.int64))], names=["doc_id", "fp"])

    return apply


def _covered(threshold: int):
    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = _Cover(threshold)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                fp = batch.column(0).slice(lo, 1000).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                row, anchor = cover.anchors(fp)
                ends = np.searchsorted(row, np.arange(len(fp) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(cover.home(fp)), pa.ListArray.from_arrays(pa.array(ends), pa.array(anchor))], names=["fp", "home", "anchors"])

    return apply


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """All pairs of fingerprints u < v (column fp, distinct) that differ in at most ``threshold`` bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds up to 2")
    at = materialize(distinct.select("fp"), "distinct-fingerprints")
    homes = at.mapInArrow(_covered(0), "fp bigint, home bigint, anchors array<bigint>").select(F.col("home").alias("anchor"), F.col("fp").alias("v"))
    replicas = at.mapInArrow(_covered(threshold), "fp bigint, home bigint, anchors array<bigint>").select(F.explode("anchors").alias("anchor"), F.col("fp").alias("u"))
    # the replicas stream past a hash table of the homes, which has one row per fingerprint
    met = replicas.join(homes.hint("shuffle_hash"), "anchor")
    return met.filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)).select("u", "v")


def _rooted(found: DataFrame, threshold: int) -> DataFrame:
    """fp, least (of its doc_ids) and root (of its component) of each distinct fingerprint."""
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, threshold)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(documents: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) and component_id of every document."""
    docs = materialize(only(documents, "doc_id", "text").mapInArrow(_fingerprint(shingle), "doc_id bigint, fp bigint"), "fingerprints")
    rooted = _rooted(docs, threshold)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def first_rows(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id and text hash (xxhash64) are in ``kept`` (doc_id, h); of repeated ones the first in the
    order of their other columns."""
    kept = kept.select(F.col("doc_id").alias("__kept"), F.col("h").alias("__h"))
    found = documents.join(kept, (documents["doc_id"] == kept["__kept"]) & (F.xxhash64(documents["text"]) == kept["__h"]), "left_semi")
    order = [F.col(f"`{x.name}`") for x in documents.schema if isinstance(x.dataType, AtomicType) and x.name not in ("doc_id", "text")]
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*order or ["doc_id"])
    (copy,) = fresh(documents, "__copy")
    return found.withColumn(copy, F.row_number().over(copies)).filter(F.col(copy) == 1).drop(copy)


def keep_one(documents: DataFrame, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """The documents with all their columns, one of each component: that with the least doc_id, on a tie of doc_ids the one whose
    text has the least hash. Of repeated rows of it one stays. Documents with a null doc_id are in no order, so they all stay."""
    h = F.xxhash64("text").alias("h")
    docs = only(documents, "doc_id", "text").filter("doc_id is not null").select(F.struct("doc_id", h).alias("doc_id"), "text")
    found = materialize(docs.mapInArrow(_fingerprint(shingle), "doc_id struct<doc_id: bigint, h: bigint>, fp bigint"), "fingerprints")
    kept = _rooted(found, threshold).groupBy("root").agg(F.min("least").alias("k")).select("k.*")
    return first_rows(documents, kept).unionByName(documents.filter("doc_id is null"))
