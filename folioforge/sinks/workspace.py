"""A folder that keeps documents as they came, their texts, and every version of the delivered table, with hashes.

Nothing in it is ever replaced. Originals and texts are written by the executors, to names made of the document's name and
the hash of its bytes; each task also writes what it has kept to a journal, 500 documents at a time. The manifest is one JSON
file, renamed into place by the driver, which takes the journal in at the end of a run, also of one that failed, or before the
next: so no file is kept without being named. Documents that couldn't be read are kept too. Capturing the same bytes under the
same label again adds nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import revisions
from ..operators.tables import delivered
from ..sources.filestate import _now
from .files import read_csv_rows, write_csv

_ENTRY = ("label", "original", "original_sha256", "extracted", "extracted_sha256", "characters", "captured", "state_when_found")
#: Documents that are kept before the journal says so.
FLUSH = 500


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def safe_name(label: str, digest: str | None = None) -> str:
    """A file name for a document: its own, made harmless, with its number among members of one name and part of a hash."""
    parts = [p for p in re.split(r"[/\\!]", label) if p.strip(".")]
    base, number = parts[-1] if parts else "document", ""
    head, mark, tail = base.rpartition("#")
    if mark and head and tail.isdigit():
        base, number = head, "_" + tail
    base = "".join(c if c.isalnum() or c in " ._-" else "_" for c in base).strip() or "document"
    short = (digest or hashlib.sha256(label.encode()).hexdigest())[:8]
    stem, dot, end = base.rpartition(".")
    return f"{stem[:120]}{number}_{short}.{end}" if dot and len(end) <= 8 else f"{base[:120]}{number}_{short}"


class Workspace:
    def __init__(self, root: str | Path):
        self.root = Path(root).absolute()
        self.manifest_path = self.root / "manifest.json"

    def exists(self) -> bool:
        return self.manifest_path.is_file()

    def create(self, sources: Sequence[str]) -> dict:
        for name in ("originals", "extracted", "revisions", "journal"):
            (self.root / name).mkdir(parents=True, exist_ok=True)
        manifest = {
            "schema": 1, "tool": f"folioforge {__version__}", "created": _now(), "documents": [], "sources": [os.path.abspath(s) for s in sources], "revisions": [],
            "note": "Hashes show that files are as they were. They are no signature: who can write here can change them too.",
        }
        self._write(manifest)
        return manifest

    def load(self) -> dict:
        return json.loads(self.manifest_path.read_text(encoding="utf-8", errors="surrogatepass"))

    def _write(self, manifest: dict) -> None:
        new = self.manifest_path.with_suffix(".json.tmp")
        new.write_text(json.dumps(manifest, indent=2, ensure_ascii=False), encoding="utf-8", errors="surrogatepass")
        new.replace(self.manifest_path)

    def capture(self, extracted: DataFrame, originals: bool = True) -> int:
        """Keeps the documents of a run (source rows with content and state); returns how many are new."""
        spark = extracted.sparkSession
        manifest = self.load()
        (self.root / "journal").mkdir(exist_ok=True)
        self._take_in(manifest)  # what a run that was lost has left
        root, stamp = str(self.root), _now()
        rows = extracted.filter("files_not_read is null").select(
            "ordinal", "label", F.coalesce("text", F.lit("")).alias("text"), F.col("sha256").alias("original_sha256"), "content", F.to_json("state").alias("state")
        )
        known = spark.createDataFrame([(d["label"], d["original_sha256"]) for d in manifest["documents"]], "label string, original_sha256 string")
        new = revisions.not_captured(rows, known)

        def put(path: str, data: bytes) -> None:
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)

        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, FLUSH):
                    entries = []
                    try:
                        for r in whole.slice(at, FLUSH).to_pylist():
                            payload, original = r["text"].encode("utf-8", "surrogatepass"), None
                            name = safe_name(r["label"], r["original_sha256"] or hashlib.sha256(payload).hexdigest())
                            if r["content"] is not None and originals:
                                original = f"originals/{name}"
                                put(f"{root}/{original}", r["content"])
                            put(f"{root}/extracted/{name}.txt", payload)
                            state = json.loads(r["state"]) if r["state"] else None
                            values = (r["label"], original, r["original_sha256"], f"extracted/{name}.txt", hashlib.sha256(payload).hexdigest(), len(r["text"]), stamp, state)
                            entries.append([r["ordinal"], dict(zip(_ENTRY, values))])
                    finally:
                        if entries:
                            put(f"{root}/journal/{uuid.uuid4().hex}.json", json.dumps(entries, ensure_ascii=False).encode("utf-8", "surrogatepass"))
                    yield pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64())], names=["n"])

        rows = new.select("ordinal", "label", "text", "original_sha256", "content", "state").mapInArrow(keep, "n bigint")
        try:
            rows.agg(F.sum("n")).collect()
        finally:
            made = self._take_in(manifest)
        return made

    def _take_in(self, manifest: dict) -> int:
        """Adds the journal to the manifest, and writes it; a document that two attempts of a task have kept counts once."""
        parts = sorted((self.root / "journal").glob("*.json"))
        if not parts:
            return 0
        found = sorted((e for p in parts for e in json.loads(p.read_text(encoding="utf-8", errors="surrogatepass"))), key=lambda e: e[0])
        known = {(d["label"], d["original_sha256"]) for d in manifest["documents"] if d["original_sha256"]}
        made = {}
        for ordinal, e in found:
            if (e["label"], e["original_sha256"]) not in known:
                made.setdefault((ordinal, e["label"], e["original_sha256"]), e)
        manifest["documents"] += made.values()
        self._write(manifest)
        for p in parts:
            p.unlink()
        return len(made)

    def _previous(self, spark: SparkSession, manifest: dict) -> DataFrame | None:
        path = self.root / manifest["revisions"][-1]["file"] if manifest["revisions"] else None
        return frame(spark, *read_csv_rows(path)[:2]) if path and path.is_file() else None

    def add_revision(self, table: DataFrame, note: str = "", key: str = "file", skip_if_unchanged: bool = False) -> dict | None:
        """Adds a version of the table, with its difference from the last."""
        manifest = self.load()
        previous = self._previous(table.sparkSession, manifest)
        changes = []
        if previous is not None:
            # cells, compared as they will stand in the file
            changes = [r.asDict() for r in revisions.diff(previous, delivered(table), key).orderBy("file", "column").toLocalIterator()]
            if skip_if_unchanged and not changes:
                return None
        number = 1 + len(manifest["revisions"])
        path = self.root / "revisions" / f"revision_{number:03d}.csv"
        rows = write_csv(table, path)
        entry = {
            "revision": number, "rows": rows, "note": note, "created": _now(), "file": str(path.relative_to(self.root)), "sha256": sha256_file(path),
            "change_count": len(changes), "changes_from_previous": changes,
        }
        self._write(manifest | {"revisions": [*manifest["revisions"], entry]})
        return entry

    def import_csv(self, spark: SparkSession, path: str | Path, note: str = "") -> tuple[dict | None, str]:
        """A corrected table as a revision, None if nothing in it is changed; and the encoding of the file."""
        rows, columns, encoding = read_csv_rows(path)
        return self.add_revision(frame(spark, rows, columns), note or f"imported {path}", skip_if_unchanged=True), encoding

    def verify(self, spark: SparkSession) -> list[str]:
        """Problems: files that are missing, or changed. Files are hashed by the executors."""
        manifest = self.load()
        wanted = [(d[k], k, d[f"{k}_sha256"]) for d in manifest["documents"] for k in ("original", "extracted") if d.get(k)]
        wanted += [(r["file"], "revision", r["sha256"]) for r in manifest["revisions"]]
        if not wanted:
            return []
        root = str(self.root)

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                there = [p for p in b.column(0).to_pylist() if os.path.isfile(f"{root}/{p}")]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.string()), pa.array([sha256_file(f"{root}/{p}") for p in there], pa.string())], names=["path", "sha256"])

        table = spark.createDataFrame(wanted, "path string, kind string, sha256 string")
        found = table.select("path").distinct().mapInArrow(look, "path string, sha256 string")
        return [r.problem for r in revisions.verify(table, found).orderBy("problem").collect()]


def frame(spark: SparkSession, rows: list[dict[str, str]], columns: Sequence[str]) -> DataFrame:
    """Rows of strings as a table, in their order."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) or "" for c in columns) for r in rows], schema)
