"""Line dedup by a deletion-neighbourhood join.

A line is its words, with A-Z lower-cased. A line of at least ``min_words`` words (one, so all that have a word) is removed if
an earlier line (by doc_id, then place) has the same words. A line of at least ``near_words`` words is also removed if an
earlier one of at least as many is within an edit distance of one word: a word changed, added or left out (of five words
one is a fifth; in shorter lines it would be more). Earlier lines count whether or not they are removed themselves, so the
result doesn't depend on any order of work. Lines without a word always stay.

1. One pass over the texts makes a row of digests per line. Equal lines are aggregated before the shuffle; the first
   of each stands for all.
2. Of two lines within one edit, the first half or the last half of the words is the same (halves of the shorter line
   or, at equal lengths, of either). Lines that share no half with another are done; only the rest need their texts.
   Their places are broadcast up to ``broadcast_lines`` of them, else joined to the texts.
3. Each of the rest emits its deletion neighbourhood as hashed keys: itself, and for each place itself without that
   word, once with the place (for changed words) and once without (for added ones). Lines with a key in common are
   joined through the key's earliest line, so a key that a million lines share makes a million rows, not pairs of them.
4. The edit distance of each line to the earliest is verified on the words, and the first occurrences are removed with
   all their copies.

Lines are told apart by 128-bit digests; keys are 64-bit hashes, and what they join is verified. Joins have one row per key on one side, so a hot key's other side can be split.

Nulls: a null text stays null and has no lines; the lines of a row with a null doc_id have no order, so they all stay
and remove none. Repeated rows are one document and don't remove each other's lines. Removed lines go with their line
break; a document may become an empty text, and stays a row. An empty table gives an empty result. ``dedup`` keeps all
columns of the input; its own are n_lines and n_removed, or other names that you give. Lengths are not limited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, fresh, materialize, mixed, only, pieces, powers, text_bytes


_EDGES = ("e0", "e1", "e2", "e3")


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _halves(w: list[bytes]) -> bytes:
    """Four 64-bit hashes: the halves that a line has in common with a line of one edit, in the groups of lines of
    n - 1 and n, and of n and n + 1 words."""
    out = []
    for g in (len(w), len(w) + 1):
        p = (g - 1) // 2
        out += xxhash.xxh3_64_digest(b" ".join(w[:p]), g), xxhash.xxh3_64_digest(b" ".join(w[-p:]), g + (1 << 40))
    return b"".join(out)


def _pair(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _lines(min_words: int, near_words: int):
    """A row of digests per line; the halves are null where only equal lines are looked for."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, line, d, near, halves = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                d1, d2 = _pair(d)
                edges = np.zeros((len(row), 4), np.int64)
                edges[near] = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 4)
                none = np.ones(len(row), bool)
                none[near] = False
                rows = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(line, pa.int32()), d1, d2, *(pa.array(edges[:, k], mask=none) for k in range(4))], names=["doc_id", "h", "line", "d1", "d2", *_EDGES])

            for i, text in enumerate(text_bytes(batch.column(2))):
                for k, x in enumerate(text.split(b"\n")):
                    w = x.lower().split()
                    if len(w) >= min_words:
                        if len(w) >= near_words:
                            near.append(len(row))
                            halves.append(_halves(w))
                        row.append(i)
                        line.append(k)
                        d.append(_digest(b" ".join(w)))
                        if len(row) >= 20_000:
                            yield flush()
                            row, line, d, near, halves = [], [], [], [], []
            if row:
                yield flush()

    return scan


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out: list[tuple] = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            out += [(doc, x["line"], x["d1"], x["d2"], b" ".join(lines[x["line"]].lower().split())) for x in wanted]
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "line", "d1", "d2", "words"])


def _neighbourhood(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: without the word at a place, with the place and length; 1: the whole line; 2: without a word.

    A line's key is a polynomial in its words' hashes, so the key without a word comes from two sums: the keys of a line
    of n words take time in proportion to n."""
    for batch in pieces(batches, 2000):
        texts = batch.column(1).to_pylist()
        for lo, hi in blocks(texts, 1 << 18):
            w = Words(texts[lo:hi])
            n = np.diff(w.first)
            line = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(line)) - w.first[line]
            up, down = powers(max(2, int(n.max())))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hashes(1) * up[at])))
            start, end, here = sums[w.first[:-1]], sums[w.first[1:]], np.arange(len(line))
            size = mixed(n.astype(np.uint64) + np.uint64(1))
            whole = mixed((end - start) * (2 * size + np.uint64(1)))
            short = mixed(n.astype(np.uint64))[line]
            less = mixed((sums[here] - start[line] + (end[line] - sums[here + 1]) * down[1]) * (2 * short + np.uint64(1)))
            placed = mixed(less ^ mixed((at.astype(np.uint64) << np.uint64(32)) + n[line].astype(np.uint64)))
            ids = batch.column(2).slice(lo, hi - lo)
            rows = pa.array(line)
            for keys, kind, of in ((whole, 1, ids), (less, 2, ids.take(rows)), (placed, 0, ids.take(rows))):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), kind, np.int8)), of], names=["key", "kind", "id"])


def one_edit(x: list[bytes], y: list[bytes]) -> bool:
    """Whether the lists are within an edit distance of one."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [one_edit(p.split(), q.split()) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def removals(documents: DataFrame, min_words: int = 1, near_words: int = 5, broadcast_lines: int = 500_000) -> DataFrame:
    """doc_id, h (hash of the text) and the numbers of the lines to remove, for each document that has any."""
    if not 1 <= min_words <= near_words or near_words < 4:
        raise ValueError("near_words is at least 4 and min_words")
    docs = only(documents, "doc_id", "text").filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    lines = materialize(docs.mapInArrow(_lines(min_words, near_words), "doc_id bigint, h bigint, line int, d1 bigint, d2 bigint, e0 bigint, e1 bigint, e2 bigint, e3 bigint"), "lines")
    first = lines.select("doc_id", "h", "line", "d1", "d2").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line", "h")).alias("f"))

    # copies of a line share its halves, so they are made one row first
    edges = lines.filter("e0 is not null").select("d1", "d2", *_EDGES).distinct().select("d1", F.explode(F.array(*_EDGES)).alias("edge"))
    met = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("edge")
    some = edges.join(met, "edge").select("d1").distinct()
    wanted = first.join(some, "d1").groupBy(F.col("f.doc_id").alias("doc_id"), F.col("f.h").alias("h")).agg(F.collect_list(F.struct(F.col("f.line").alias("line"), "d1", "d2")).alias("wanted"))
    wanted = materialize(wanted, "wanted-lines")
    few = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0)).alias("n")).head().n <= broadcast_lines
    texts = docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "h"]).select("doc_id", "text", "wanted").mapInArrow(_texts, "doc_id bigint, line int, d1 bigint, d2 bigint, words binary")
    # ids in the order of lines, as one number that aggregates fast
    texts = materialize(texts.distinct().orderBy("doc_id", "line").withColumn("id", F.monotonically_increasing_id()), "line-texts")

    keys = texts.select("d1", "words", "id").mapInArrow(_neighbourhood, "key bigint, kind byte, id bigint")
    least = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(F.col("kind") < 2, F.col("id"))).alias("whole"), F.min(F.when(F.col("kind") == 2, F.col("id"))).alias("less"))
    pairs = keys.join(least.filter("c > 1"), "key").select("id", F.when(F.col("kind") == 1, F.col("less")).otherwise(F.col("whole")).alias("other")).filter("other < id").distinct()
    mine = texts.select("id", "doc_id", "line", "d1", "d2", F.col("words").alias("w"))
    theirs = texts.select(F.col("id").alias("other"), F.col("doc_id").alias("doc"), F.col("line").alias("at"), F.col("words").alias("v"))
    both = pairs.join(mine, "id").join(theirs, "other").filter("doc < doc_id or doc = doc_id and at < line")
    near = both.select("d1", "d2", "w", "v").mapInArrow(_verify, "d1 bigint, d2 bigint").distinct()

    marked = first.select("d1", "d2", "f").join(near.withColumn("near", F.lit(True)), ["d1", "d2"], "left")
    later = (F.col("doc_id") > F.col("f.doc_id")) | ((F.col("doc_id") == F.col("f.doc_id")) & (F.col("line") > F.col("f.line")))
    gone = lines.select("doc_id", "h", "line", "d1", "d2").join(marked, ["d1", "d2"]).filter(F.col("near") | later)
    return gone.groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone"))


def dedup(documents: DataFrame, min_words: int = 1, near_words: int = 5, n_lines: str = "n_lines", n_removed: str = "n_removed", broadcast_lines: int = 500_000) -> DataFrame:
    """The documents with all their columns, their texts without the removed lines, and two counts."""
    doc, h, lost = fresh(documents, "__doc", "__h", "__gone")
    gone = removals(documents, min_words, near_words, broadcast_lines).select(F.col("doc_id").alias(doc), F.col("h").alias(h), F.col("gone").alias(lost))
    found = documents.join(gone, (documents["doc_id"] == gone[doc]) & (F.xxhash64(documents["text"]) == gone[h]), "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(lost), i)), "\n")
    names = documents.columns
    return found.select(
        *[F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(F.when(F.col(lost).isNotNull(), F.col(lost))), F.lit(0)).cast("long").alias(n_removed),
    )
