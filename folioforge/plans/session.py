"""A run as a person has it: folders, options, progress, a way to stop, and a dated folder with the deliverables."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..operators.recognition import infer_schema
from ..sinks import files, pages
from ..sinks.workspace import Workspace
from ..sources.documents import scan
from ..sources.walk import merge_paths, parse_dropped
from .batch import run

#: Documents whose labels are looked at for columns.
SAMPLE = 60


class NothingToDo(ValueError):
    """No folder, or none that is there."""


class Cancelled(Exception):
    """The run was stopped between two documents."""


@dataclass
class Options:
    """What a run makes. All of it, unless switched off."""

    recognize: bool = True
    datasheet: bool = True
    workspace: bool = True
    include_text: bool = True


@dataclass
class Index:
    """What lies under the folders, listed without reading a document. A member of an archive counts as one."""

    folders: list[str]
    count: int = 0
    skipped: int = 0
    total_bytes: int = 0
    by_extension: dict[str, int] = field(default_factory=dict)

    def summary(self) -> str:
        if not self.count:
            return "no documents"
        kinds = sorted(self.by_extension.items(), key=lambda x: (-x[1], x[0]))
        shown = ", ".join(f"{n} {e or 'without extension'}" for e, n in kinds[:4]) + (f", {len(kinds) - 4} more kinds" if len(kinds) > 4 else "")
        many = f"{len(self.folders)} folders: " if len(self.folders) > 1 else ""
        return f"{many}{self.count} documents ({shown})" + (f"; {self.skipped} inputs aren't documents" if self.skipped else "")


@dataclass
class Result:
    out_dir: str
    read: int = 0
    unread: int = 0
    columns: list[str] = field(default_factory=list)
    csv: str | None = None
    report: str | None = None
    datasheet: str | None = None
    workspace: str | None = None
    seconds: float = 0.0

    def headline(self) -> str:
        if not self.read + self.unread:
            return "nothing to read there"
        took = f"{self.seconds * 1000:.0f} ms" if self.seconds < 1 else f"{self.seconds:.1f} s" if self.seconds < 90 else f"{self.seconds / 60:.1f} min"
        return ", ".join([f"{self.read} read", *[f"{self.unread} not read"] * (self.unread > 0), *[f"{len(self.columns)} columns found"] * bool(self.columns), took])


class Session:
    def __init__(self, spark: SparkSession, out_dir: str | None = None):
        self.spark, self.out_dir = spark, out_dir
        self.folders: list[str] = []
        self.options, self.index, self.result = Options(), None, None

    def drop(self, payload: str, add: bool = False) -> Index:
        """Loads the folder of a dropped list of paths: its first path, or the folder around that where it is a file."""
        first = payload.strip() if os.path.exists(payload.strip()) else next(iter(parse_dropped(payload)), "")
        if not first or not os.path.exists(first):
            raise NothingToDo(f"{first or 'nothing'} was dropped; it isn't there")
        first = os.path.abspath(first)
        return self.load(os.path.dirname(first) if os.path.isfile(first) else first, add)

    def load(self, folders: str | Sequence[str], add: bool = False) -> Index:
        """Points at folders, or adds them to those there; one inside another counts once."""
        given = [folders] if isinstance(folders, str) else list(folders)
        for f in given:
            if not os.path.isdir(f):
                raise NothingToDo(f"{f} is no folder")
        self.folders = merge_paths([*(self.folders if add else []), *map(os.path.abspath, given)])
        listed = scan(self.spark, self.folders, text=False, parse=False)
        there = F.col("status") == "listed"
        totals = listed.agg(F.count_if(there).alias("n"), F.count_if(~there).alias("rest"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).head()
        kinds = {r.extension: r.n for r in tables.extension_histogram(listed.filter(there)).collect()}
        self.index, self.result = Index(self.folders, totals.n, totals.rest, totals.bytes, kinds), None
        return self.index

    def output_dir(self) -> str:
        """Where results go: beside the first folder, never in it, as the next run would read them."""
        if self.out_dir:
            return self.out_dir
        first = self.folders[0].rstrip(os.sep)
        more = f"-and-{len(self.folders) - 1}-more" if len(self.folders) > 1 else ""
        return os.path.join(os.path.dirname(first), f"{os.path.basename(first) or 'documents'}{more}-tables-{time.strftime('%Y%m%d-%H%M%S')}")

    def run(self, on_progress: Callable[[int, int, str], None] | None = None, on_stage: Callable[[str], None] | None = None, should_cancel: Callable[[], bool] | None = None) -> Result:
        """``on_progress`` gets how many inputs are done, of how many, and the last one's name. ``should_cancel`` is asked at each; if
        it says yes, the run ends with ``Cancelled`` and what it has written stays."""
        if not self.folders:
            raise NothingToDo("no folder is loaded")
        began, say = time.time(), on_stage or (lambda _: None)
        result = Result(self.output_dir())
        os.makedirs(result.out_dir, exist_ok=True)
        total, done = max(1, self.index.count + self.index.skipped), 0

        def each(label: str, ok: bool) -> None:
            nonlocal done
            if should_cancel is not None and should_cancel():
                raise Cancelled(f"after {done} of {total} inputs")
            done += 1
            if on_progress is not None:
                on_progress(done, total, label.rpartition("!")[2].rpartition("/")[2])

        say("reading")
        extracted = run(self.spark, self.folders, include_text=self.options.include_text, state=True, content=self.options.workspace, on_document=each)
        try:
            if self.options.recognize:
                say("looking for columns in a sample")
                texts: DataFrame = extracted.extracted.filter("status = 'read'").select("ordinal", "text")
                extracted.labels = result.columns = [r.label for r in infer_schema(texts, sample=SAMPLE).collect()]
            say("writing")
            result.csv, result.report = (os.path.join(result.out_dir, n) for n in ("results.csv", "review.html"))
            result.read = files.write_csv(extracted.results, result.csv)
            result.unread = extracted.exceptions.count()
            pages.write_review(extracted.results, extracted.exceptions, result.report)
            if self.options.datasheet:
                result.datasheet = os.path.join(result.out_dir, "file-state.html")
                pages.write_datasheet(extracted.datasheet, result.datasheet)
            if self.options.workspace:
                result.workspace = os.path.join(result.out_dir, "workspace")
                space = Workspace(result.workspace)
                if not space.exists():
                    space.create(self.folders)
                space.capture(extracted.extracted)
                space.add_revision(extracted.results, "first extraction")
        finally:
            extracted.close()
        result.seconds = time.time() - began
        self.result = result
        return result
