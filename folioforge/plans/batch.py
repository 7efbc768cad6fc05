"""A whole run: inputs to tables. Documents are read once, whatever is asked of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..functions.fields import Field
from ..operators import tables
from ..operators.recognition import MIN_SUPPORT, infer_schema
from ..sources.documents import scan


@dataclass
class Run:
    """The tables of a run. ``extracted`` is kept on the executors' disks until ``close``."""

    extracted: DataFrame
    labels: list[str] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    schema: list[dict] = field(default_factory=list)
    include_text: bool = True
    max_text: int | None = None

    @property
    def results(self) -> DataFrame:
        return tables.results(self.extracted, self.labels, self.fields, self.include_text, self.max_text, keep_ordinal=True).orderBy("ordinal").drop("ordinal")

    @property
    def exceptions(self) -> DataFrame:
        return tables.exceptions(self.extracted, self.labels, self.fields, keep_ordinal=True).orderBy("ordinal").drop("ordinal")

    @property
    def datasheet(self) -> DataFrame:
        return tables.datasheet(self.extracted).orderBy("ordinal").drop("ordinal")

    def close(self) -> None:
        self.extracted.unpersist()


def run(
    spark: SparkSession, paths: Sequence[str], fields: Sequence[Field] = (), recognize: bool = False, labels: Sequence[str] = (), min_support: float = MIN_SUPPORT, include_text: bool = True,
    max_text: int | None = None, state: bool = False, content: bool = False, partitions: int = 0, on_document: Callable[[str, bool], None] | None = None,
) -> Run:
    """``recognize`` proposes columns from the whole corpus; ``labels`` names them instead. ``on_document`` is called with the label of
    each input and whether it was read; if it raises, the run ends with what it raised."""
    extracted = scan(spark, paths, state=state, content=content, partitions=partitions).persist(StorageLevel.DISK_ONLY)
    if on_document is not None:
        _report(extracted, fields, on_document)
    found: list[dict] = []
    if recognize:
        found = [r.asDict() for r in infer_schema(extracted.filter("status = 'read'").select("ordinal", "text"), min_support=min_support).collect()]
        labels = [*labels, *(x["label"] for x in found)]
    return Run(extracted, list(labels), list(fields), found, include_text, max_text)


def _report(extracted: DataFrame, fields: Sequence[Field], on_document: Callable[[str, bool], None]) -> None:
    """Calls back a partition at a time, while another job reads ahead with all cores."""
    sc, group = extracted.sparkSession.sparkContext, f"read-ahead-{uuid.uuid4().hex}"

    def ahead() -> None:
        sc.setJobGroup(group, "reading documents", True)
        try:
            extracted.write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 - it is stopped, or the rows themselves will say what is wrong
            pass

    reader = InheritableThread(target=ahead)
    reader.start()
    try:
        for r in tables.outcomes(extracted, fields).toLocalIterator():
            on_document(r.label, r.ok)
    except BaseException:
        sc.cancelJobGroup(group)
        reader.join()
        extracted.unpersist()
        raise
    reader.join()
