"""Language identification by compression.

For each language a zstandard dictionary of raw content is made from labelled texts. A text is encoded with each; the
language whose dictionary makes it smallest is chosen. Texts are encoded in pieces of ``PIECE`` bytes, all of them, as a
longer text would teach the compressor its own language, whatever the dictionary. Where the two smallest sizes differ
by less than ``min_margin``, the choice is rejected.

Fitting uses a bounded sample: of each label at most ``samples`` documents, spread by a hash of doc_id, and of each a part of
at most ``sample_chars`` characters at a hashed place. All labels are learned; with many, each has fewer documents (one
at least), so that about ``most_chars`` characters reach the driver (2 million for four languages), and smaller dictionaries than
``dictionary_bytes``. Samples that another language's dictionary encodes smaller are left out of the final dictionaries.

Nulls: a null text, and one without a letter, is ``und`` with score 0; null labels and null doc_ids are never learned
from. With no labels at all every text is ``und``. Repeated rows each give a row. An empty table gives an empty result.
``classify`` returns doc_id and its own columns only, so further columns don't matter. Lengths are not limited.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

PIECE = 1000
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text in lower case with all but letters made single spaces, and a word said many times in a row said once, as it
    tells no more; empty if it has no letter."""
    norm = _OTHER.sub(" ", text.lower()) if text else ""
    return f" {' '.join(w for w, _ in groupby(norm.split()))} ".encode() if any(map(str.isalpha, norm)) else b""


class Model:
    """One dictionary per language, the most frequent language first: it is taken where sizes are equal. Compressors are made
    where they are first used."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.dictionaries, self.level = dictionaries, level
        self._made: dict[str, zstandard.ZstdCompressor] | None = None

    def __getstate__(self):
        return self.dictionaries, self.level

    def __setstate__(self, state):
        self.__init__(*state)

    def sizes(self, norm: bytes) -> dict[str, int]:
        if self._made is None:
            self._made = {}
            for lang, content in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made[lang] = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False)
        parts = [norm[i : i + PIECE] for i in range(0, len(norm), PIECE)]
        return {lang: sum(len(c.compress(p)) for p in parts) for lang, c in self._made.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: by which share the next best encoding is larger."""
        norm = letters(text)
        if not norm or not self.dictionaries:
            return "und", 0.0
        ranked = sorted((n, k, lang) for k, (lang, n) in enumerate(self.sizes(norm).items()))
        if len(ranked) == 1:
            return ranked[0][2], 1.0
        return ranked[0][2], (ranked[1][0] - ranked[0][0]) / ranked[1][0]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = [s for s in samples if s]
    share = size // max(1, len(samples))
    short = sum(len(s) for s in samples if len(s) <= share)
    many = sum(len(s) > share for s in samples)
    share = (size - short) // many if many else share
    return b"".join(s[:share] for s in samples)[-size:]


def fit(labelled: DataFrame, samples: int = 256, sample_chars: int = 2000, dictionary_bytes: int = 1 << 18, most_chars: int = 100_000_000) -> Model:
    """``labelled`` has doc_id, text and lang."""
    rows = only(labelled, "doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not langs:
        return Model({})
    samples = max(1, min(samples, most_chars // (sample_chars * len(langs))))
    dictionary_bytes = max(sample_chars, min(dictionary_bytes, most_chars // len(langs)))
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    start = F.pmod(h, F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    part = F.substring(F.col("text"), start.cast("int"), F.lit(sample_chars))
    picked = rows.select("lang", F.pmod(h, F.lit(samples)).alias("bucket"), F.struct(F.xxhash64(F.lit("order"), F.col("doc_id")).alias("o"), part.alias("part")).alias("s"))
    found: dict[str, list[bytes]] = {lang: [] for lang in langs}
    for r in sorted(picked.groupBy("lang", "bucket").agg(F.min("s").alias("s")).collect(), key=lambda r: (r.lang, r.bucket)):
        found[r.lang].append(letters(r.s.part))
    rough = Model({lang: _dictionary(x, dictionary_bytes) for lang, x in found.items()})
    cleaned = {}
    for lang, parts in found.items():
        own = []
        for p in parts:
            sizes = rough.sizes(p) if p else {}
            if sizes and min(sizes, key=sizes.__getitem__) == lang:
                own.append(p)
        cleaned[lang] = own or parts
    return Model({lang: _dictionary(x, dictionary_bytes) for lang, x in cleaned.items()})


def classify(documents: DataFrame, model: Model, min_margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred (the best language, or und), score (0 to 1, from the margin), and rejected: whether the margin
    is under ``min_margin``, so that the text should go as undetermined."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.predict(t.as_py()) for t in b.column(1)]
            score = [m / (m + 0.02) if m > 0 else 0.0 for _, m in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array(score, pa.float64()), pa.array([m < min_margin for _, m in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return only(documents, "doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
