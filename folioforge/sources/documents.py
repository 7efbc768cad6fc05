"""The Spark data source ``documents``: a row for every input under the given paths, with its text or why there is none.

    register(spark)
    spark.read.format("documents").option("paths", json.dumps(["/data/in"])).load()

Options: ``paths`` (a JSON list, or one path), ``withText``, ``withState``, ``withContent`` (default true, false, false),
``archives`` (true: walk into archives), ``read`` (true; false: only list what is there), ``partitions`` (0: one for each 128 MB, 64
at least). Bytes are read and parsed in the executors' Python workers; only rows reach the JVM. ``ordinal`` is the place of an input
in the walk.

As a stream, ``seenLog`` names a folder that keeps which files each batch has: a file is new if its path, time or size is.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import filestate
from .limits import reason_of
from .sniff import Outcome, read
from .walk import ArchiveWalk, Item, Unit, balanced, list_items, open_item

PARTITION_BYTES = 128 << 20
#: Members of an item have its place in the upper bits of their ordinal.
MEMBER_BITS = 24

_BASE = "ordinal bigint, label string, kind string, top string, size bigint, format string, text string, characters bigint, status string, detail string, files_not_read bigint, sha256 string"
_STATE = "state struct<" + ", ".join(f"`{n}`: {t}" for n, t in filestate.STATE.items()) + ", read_result: string>"


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name.lower(), options.get(name, default))).lower() == "true"


def _paths(options: dict) -> list[str]:
    raw = options.get("paths") or options.get("path") or "[]"
    return json.loads(raw) if raw.lstrip().startswith("[") else [raw]


class _Part(InputPartition):
    def __init__(self, items: list[tuple[int, dict]]):
        self.items = items


def _state(unit: Unit) -> dict:
    try:
        return filestate.of_member(unit.info, unit.label, unit.top or "") if unit.info else filestate.of_file(unit.label)
    except OSError as e:
        return {"path": unit.label, "name": unit.label.rpartition("/")[2], "read_result": f"stat failed: {e}"}


def rows_of(item: Item, major: int, text: bool, state: bool, content: bool, archives: bool, parse: bool) -> Iterator[tuple]:
    for minor, (unit, walk) in enumerate(open_item(item, archives)):
        data, out = None, Outcome("", "", unit.reason or "listed", unit.detail or "")
        if unit.reason is None and parse:
            try:
                data = _bytes(unit, walk)
                out = read(data, unit.name, unit.label.rpartition("/")[2])
            except Exception as e:  # noqa: BLE001
                out = Outcome("", "", *reason_of(e))
        if content and data is None and unit.files is None:
            try:
                data = _bytes(unit, walk)
            except Exception:  # noqa: BLE001 - an original that can't be read isn't archived
                data = None
        size = unit.info.file_size if unit.info else item.size
        row = (
            (major << MEMBER_BITS) + minor, unit.label, unit.kind, unit.top, size, out.format or None, out.text if text and out.status == "read" else None,
            len(out.text) if parse and unit.reason is None else None, out.status, out.detail or None, unit.files, hashlib.sha256(data).hexdigest() if data is not None else None,
        )
        if state:
            found = _state(unit)
            row += (tuple(found.get(n) if n != "inode" or found.get(n) is None else _decimal(found[n]) for n in filestate.STATE) + (found.get("read_result"),),)
        if content:
            row += (data,)
        yield row


def _decimal(n: int):
    from decimal import Decimal

    return Decimal(n)


def _bytes(unit: Unit, walk: ArchiveWalk | None) -> bytes:
    if unit.info is not None and walk is not None:
        return walk.read(unit)
    with open(unit.label, "rb") as f:
        return f.read()


class _Options:
    def __init__(self, options: dict):
        self.paths = _paths(options)
        self.flags = [_flag(options, n, d) for n, d in (("withText", True), ("withState", False), ("withContent", False), ("archives", True), ("read", True))]
        self.parts = int(options.get("partitions", 0))

    def split(self, items: list[tuple[int, Item]]) -> list[InputPartition]:
        parts = self.parts or max(64, -(-sum(i.size for _, i in items) // PARTITION_BYTES))
        return [_Part([(k, asdict(i)) for k, i in part]) for part in balanced(items, parts)]

    def rows(self, partition: _Part) -> Iterator[tuple]:
        for major, item in partition.items:
            yield from rows_of(Item(**item), major, *self.flags)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.options.split(list(enumerate(list_items(self.options.paths)))) or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return self.options.rows(partition)


class DocumentStreamReader(DataSourceStreamReader):
    """New and changed files since the last batch. The offset is the number of a batch; what is in each is in the log, one file
    per batch, written before the batch is announced. A file with an old time that comes late is as new as any other."""

    def __init__(self, options: dict):
        self.options = _Options(options)
        self.log = options.get("seenLog") or options.get("seenlog")
        if not self.log:
            raise ValueError("a stream of documents needs a folder seenLog, which keeps what has been read")
        os.makedirs(self.log, exist_ok=True)
        self.seen: set[tuple] = set()
        self.logged = self.count = 0

    def _file(self, batch: int) -> str:
        return os.path.join(self.log, f"{batch:09d}.json")

    def _entries(self, batch: int) -> tuple[int, list[list]]:
        with open(self._file(batch), encoding="utf-8") as f:
            found = json.load(f)
        return found["first"], found["files"]

    def _catch_up(self) -> None:
        while os.path.exists(self._file(self.logged + 1)):
            self.logged += 1
            first, files = self._entries(self.logged)
            self.seen.update((path, mtime, size) for path, mtime, size, *_ in files)
            self.count = first + len(files)

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        new = []
        for item in list_items(self.options.paths):
            try:
                mtime = os.stat(item.path).st_mtime_ns
            except OSError:
                mtime = 0
            if (item.path, mtime, item.size) not in self.seen:
                new.append([item.path, mtime, item.size, item.reason, item.detail, item.files])
        if new:
            part = f"{self._file(self.logged + 1)}.part"
            with open(part, "w", encoding="utf-8") as f:
                json.dump({"first": self.count, "files": new}, f)
            os.replace(part, self._file(self.logged + 1))
            self._catch_up()
        return {"batch": self.logged}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        items = []
        for batch in range(start["batch"] + 1, end["batch"] + 1):
            first, files = self._entries(batch)
            items += [(first + k, Item(path, size, *rest)) for k, (path, _, size, *rest) in enumerate(files)]
        return self.options.split(items)

    def read(self, partition: _Part) -> Iterator[tuple]:
        return self.options.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return _BASE + f", {_STATE}" * _flag(self.options, "withState", False) + ", content binary" * _flag(self.options, "withContent", False)

    def reader(self, schema: T.StructType) -> DocumentReader:
        return DocumentReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DocumentStreamReader:
        return DocumentStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)


def scan(spark: SparkSession, paths: Sequence[str], text: bool = True, state: bool = False, content: bool = False, archives: bool = True, parse: bool = True, partitions: int = 0) -> DataFrame:
    """Every input under the paths."""
    register(spark)
    options = {"paths": json.dumps(list(paths)), "withText": text, "withState": state, "withContent": content, "archives": archives, "read": parse, "partitions": partitions}
    return spark.read.format("documents").options(**{k: str(v) for k, v in options.items()}).load()
