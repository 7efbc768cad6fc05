"""Helpers that the corpus operators share.

Texts are handled as UTF-8 bytes in blocks of a bounded size: one numpy pass over a block finds all words and hashes
all word windows of all its documents. A document longer than a block makes a block of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time.
BLOCK_BYTES = 1 << 20

#: Tables in the shared folder, in the order in which they were written.
_TABLES: list[str] = []

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, or where the installed package of public tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where it is unset, a local run gets a new one; on a
    cluster that is an error, as each executor would write to a disk of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: a lost executor costs no recomputation, and
    nothing that follows evaluates the plan twice. The table goes with the session, or before by ``delete_tables``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_so_far() -> int:
    return len(_TABLES)


def delete_tables(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the tables written after the first ``since``, but for the last ``keep``: for one whose next plan reads only those."""
    gone = _TABLES[since : len(_TABLES) - keep]
    for path in gone:
        fs, place = _file_system(spark, path)
        fs.delete(place, True)
    del _TABLES[since : len(_TABLES) - keep]


def delete_table(df: DataFrame) -> None:
    """Deletes a table of ``materialize`` that no later plan reads."""
    files = df.inputFiles()
    for path in [x for x in _TABLES if any(x.rpartition("/")[2] in f.split("/") for f in files)]:
        fs, place = _file_system(df.sparkSession, path)
        fs.delete(place, True)
        _TABLES.remove(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that further columns of the input can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the table's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def blocks(texts: list[bytes | None], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``most`` bytes each, or one text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        m = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_B, _BINV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The numbers with their bits spread, one to one. Changes its argument."""
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of normalised texts (words joined by one space): ``buf`` has the texts joined by newlines, word ``k``
    is ``buf[start[k]:end[k]]``, and text ``d`` has the words ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts)
        raw = np.frombuffer(self.buf, np.uint8)
        counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(counts)))
        sep = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self._prefix: np.ndarray | None = None

    def hashes(self, m: int) -> np.ndarray:
        """A 64-bit hash of each run of m consecutive words; runs over the end of a text are there, but mean nothing."""
        n = len(self.start) - m + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if self._prefix is None:
            raw = np.frombuffer(self.buf, np.uint8)
            up, _ = powers(len(raw) + 1)
            self._prefix = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self._prefix[1:])
        _, down = powers(len(self._prefix))
        a, b = self.start[:n], self.end[m - 1 :]
        return mixed((self._prefix[b] - self._prefix[a]) * down[a])

    def windows(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of m words, and the text of each."""
        n = np.maximum(np.diff(self.first) - m + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        skip = np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.arange(int(n.sum())) + skip, text


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that a worker holds the texts of few as Python objects; at the end of its task
    the worker gives its free memory back, as it may wait for long while the executor needs it."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        pa.default_memory_pool().release_unused()
    _trim()


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
