"""Single documents, without a Spark session; and the functions that SQL can call."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.pairs import label_values
from .sources import sniff as _sniff
from .sources.limits import ArchiveTooLarge, Budget, NoTextFound, StreamTooLarge, UnsupportedFormat, read_member, reason_of
from .sources.sniff import explain_empty, extract, sniff

__all__ = ["ArchiveTooLarge", "NoTextFound", "StreamTooLarge", "UnsupportedFormat", "explain_empty", "extract", "extract_archive", "extract_file", "register_sql", "sniff"]


def _given(text: str, data: bytes, name: str, required: bool) -> str:
    if required and not text.strip():
        raise NoTextFound(*explain_empty(data, name))
    return text


def extract_file(path: str | os.PathLike, require_text: bool = False) -> str:
    with open(path, "rb") as f:
        data = f.read()
    name = os.path.basename(os.fspath(path))
    return _given(extract(data, name), data, name, require_text)


def extract_archive(path: str | os.PathLike, max_members: int = 500, require_text: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """Name, text and error of each member, in archives within it too. Folders count among the members; at the limit a last
    entry says so."""
    budget, seen = Budget(), 0

    def members(source, prefix: str, depth: int) -> Iterator[tuple[str, str, str | None]]:
        nonlocal seen
        times: dict[str, int] = {}
        with zipfile.ZipFile(source) as z:
            for info in z.infolist():
                seen += 1
                if seen > max_members:
                    yield "<truncated>", "", f"limit_exceeded: more than {max_members} members"
                    return
                if info.is_dir():
                    continue
                n = times[info.filename] = times.get(info.filename, 0) + 1
                name = prefix + info.filename + (f"#{n}" if n > 1 else "")
                try:
                    data = read_member(z, info, budget)
                    inner = data.startswith(b"PK") and not _sniff.office_format(data)
                    if inner and depth < 8:
                        import io

                        if zipfile.is_zipfile(io.BytesIO(data)):
                            yield from members(io.BytesIO(data), f"{name}!", depth + 1)
                            if seen > max_members:
                                return
                            continue
                    elif inner:
                        raise NoTextFound("limit_exceeded", "archives nest too deep; this one wasn't opened")
                    base = info.filename.replace("\\", "/").rpartition("/")[2]
                    if why := _sniff.skip_reason(base, data[:1024], lambda: data):
                        raise NoTextFound(*why)
                    yield name, _given(extract(data, base), data, base, require_text), None
                except Exception as e:  # noqa: BLE001
                    yield name, "", ": ".join(reason_of(e))

    yield from members(os.fspath(path), "", 0)


_OUTCOME = T.StructType([T.StructField(n, T.StringType()) for n in ("format", "text", "status", "detail")])
#: Documents of a batch that are Python objects at a time.
_SLICE = 256


@F.arrow_udf(_OUTCOME)
def extract_text(content: pa.Array, name: pa.Array) -> pa.Array:
    """Format, text, status (read, or the reason) and detail of documents given as bytes and names."""
    parts = []
    for k in range(0, len(content), _SLICE):
        found = [_sniff.read(c or b"", n or "") for c, n in zip(content.slice(k, _SLICE).to_pylist(), name.slice(k, _SLICE).to_pylist())]
        parts.append(pa.StructArray.from_arrays([pa.array([getattr(o, n) for o in found], pa.string()) for n in _OUTCOME.names], _OUTCOME.names))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.string()) for n in _OUTCOME.names]))


@F.udtf(returnType="name string, text string, error string")
class ReadArchive:
    """``read_archive(path)``: the members of an archive."""

    def eval(self, path: str):
        yield from extract_archive(path)


@F.udtf(returnType="line_no int, label string, value string")
class LabelValues:
    """``label_values(text)``, or ``label_values(text, known)`` with an array of labels: the labels and values of a text."""

    def eval(self, text: str, known: list = None):  # noqa: RUF013
        yield from label_values(text, known or ())


def register_sql(spark: SparkSession) -> None:
    """Registers the data source, ``extract_text`` (content, name), the table functions ``read_archive`` (path) and ``label_values``
    (text, with an array of known labels if wanted), and, as SQL functions inside Catalyst,
    ``classify_value`` (value) and ``find_<kind>`` (text)."""
    from .functions.detectors import DETECTORS, SHARE
    from .sources.documents import register

    register(spark)
    spark.udf.register("extract_text", extract_text)
    spark.udtf.register("read_archive", ReadArchive)
    spark.udtf.register("label_values", LabelValues)
    for d in DETECTORS:
        pattern = d.regex.replace("\\", "\\\\").replace("'", "\\'")
        found = f"regexp_extract_all(text, '{pattern}', 0)"
        if d.accepts is not None:
            found = f"filter({found}, m -> m rlike '(?U)\\\\d')"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION find_{d.name}(text STRING) RETURNS ARRAY<STRING> RETURN {found}")
    least = f"{SHARE}D * length(regexp_replace(value, '(?U)^[\\\\s]+|(?<![\\\\s])[\\\\s]++$', ''))"
    named = " ".join(f"WHEN length(get(find_{d.name}(value), 0)) >= {least} THEN '{d.name}'" for d in DETECTORS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION classify_value(value STRING) RETURNS STRING RETURN CASE {named} ELSE 'text' END")
