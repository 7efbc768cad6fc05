"""The delivered tables: results, exceptions, datasheet; and the aggregates over them.

``extracted`` is the output of the documents source (or anything with its columns). An input is in results if its status is
``read``, else in exceptions; a field that failed keeps its row and adds an exception, so
inputs = rows + exceptions other than ``field_extraction_failed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import CELL_LIMIT, csv_safe, fit_cell, is_cut
from ..functions.fields import Field
from ..functions.text import extension
from ..sources.filestate import DATASHEET
from .recognition import extract_fields


def _checked(field: Field) -> Column:
    """Value and error of a field that has to be matched in Python."""

    @F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
    def match(texts):
        import pandas as pd

        return pd.DataFrame([field.checked(t) for t in texts], columns=["value", "error"])

    return match(F.col("text"))


def _with_fields(extracted: DataFrame, labels: Sequence[str], fields: Sequence[Field]) -> tuple[DataFrame, list[str], list[str]]:
    """Read documents with their columns; the names of the columns, and of the columns that hold errors."""
    # of columns of one name the last given counts, in the first one's place
    docs = extracted.filter(F.col("status") == "read").select("ordinal", F.col("label").alias("file"), "characters", "text")
    named = {f.name: f for f in fields}
    labels = [x for x in dict.fromkeys(labels) if x not in named]
    names = list(dict.fromkeys(["file", "characters", *labels, *named]))
    docs = docs.select("ordinal", F.col("file").alias("__file"), F.col("characters").alias("__characters"), F.col("text").alias("__text"), "text")
    docs = extract_fields(docs, labels) if labels else docs
    if "text" in labels:
        docs = docs.withColumnRenamed("text", "__label_text").withColumn("text", F.col("__text"))
    errors = []
    for k, f in enumerate(named.values()):
        if f.native:
            docs = docs.withColumn(f"__f{k}", f.column("__text"))
        else:
            docs = docs.withColumn(f"__c{k}", _checked(f)).withColumn(f"__f{k}", F.col(f"__c{k}.value"))
            errors.append(f"__c{k}")
    place = {n: k for k, n in enumerate(named)}
    columns = [
        (F.col(f"__f{place[n]}") if n in named else F.col("__label_text") if n == "text" else F.col(f"`{n}`") if n in labels else F.col(f"__{n}")).alias(n)
        for n in names
    ]
    return docs.select("ordinal", *columns, F.col("__text").alias("__text"), *errors), names, errors


def results(extracted: DataFrame, labels: Sequence[str] = (), fields: Sequence[Field] = (), include_text: bool = True, max_text: int | None = None, keep_ordinal: bool = False) -> DataFrame:
    """A row per document that was read: file, characters, labels, fields, and its text."""
    docs, names, _ = _with_fields(extracted, labels, fields)
    text = [(F.substring("__text", 1, max_text) if max_text else F.col("__text")).alias("text")] if include_text and "text" not in names else []
    return docs.select(*["ordinal"] * keep_ordinal, *[F.col(f"`{n}`") for n in names], *text)


def exceptions(extracted: DataFrame, labels: Sequence[str] = (), fields: Sequence[Field] = (), keep_ordinal: bool = False) -> DataFrame:
    """A row per input that wasn't read: file, reason, detail, files_not_read; and one per document with a failed field."""
    unread = extracted.filter(F.col("status") != "read").select("ordinal", F.col("label").alias("file"), F.col("status").alias("reason"), "detail", "files_not_read")
    if any(not f.native for f in fields):
        docs, _, errors = _with_fields(extracted, (), fields)
        failed = docs.withColumn("detail", F.coalesce(*[F.col(f"{e}.error") for e in errors])).filter("detail is not null")
        unread = unread.unionByName(failed.select("ordinal", "file", F.lit("field_extraction_failed").alias("reason"), "detail", F.lit(None).cast("bigint").alias("files_not_read")))
    return unread if keep_ordinal else unread.drop("ordinal")


def outcomes(extracted: DataFrame, fields: Sequence[Field] = ()) -> DataFrame:
    """label of each input, and ok: whether it was read and no field failed on it."""
    failed = [_checked(f)["error"].isNotNull() for f in fields if not f.native]
    ok = F.col("status") == "read"
    for x in failed:
        ok = ok & ~x
    return extracted.select("label", ok.alias("ok"))


def datasheet(extracted: DataFrame) -> DataFrame:
    """The state of each input as found, with what reading it gave. Needs the source's ``withState``. Columns that no row
    has are left out where the sheet is written, not here."""
    own = {"characters_extracted": F.col("characters"), "read_result": F.coalesce(F.col("state.read_result"), F.col("status")), "sha256": F.coalesce(F.col("state.sha256"), F.col("sha256"))}
    return extracted.filter(F.col("state").isNotNull()).select("ordinal", *[own.get(c, F.col(f"state.`{c}`")).alias(c) for c in DATASHEET])


def filled_columns(table: DataFrame) -> list[str]:
    """Columns in which some row has a value, found in one aggregate."""
    found = table.agg(*[F.max(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "").alias(c) for c in table.columns]).head()
    return [c for c in table.columns if found[c]]


def delivered(table: DataFrame, limit: int = CELL_LIMIT) -> DataFrame:
    """The table as its CSV cells: all strings, safe for spreadsheets and within the cell limit; after a column ``text``
    whether it was cut."""
    columns: list[Column] = []
    for c in table.columns:
        cell = csv_safe(F.when(F.col(f"`{c}`"), "True").otherwise("False") if table.schema[c].dataType == T.BooleanType() else F.col(f"`{c}`"))
        columns.append(fit_cell(cell, limit).alias(c))
        if c == "text" and "text_truncated" not in table.columns:
            columns.append(is_cut(cell, limit).alias("text_truncated"))
    return table.select(*columns)


def summary(extracted: DataFrame) -> DataFrame:
    """Documents read and not read, their characters, the average (an integer), and the share that was read."""
    read = F.col("status") == "read"
    out = extracted.agg(F.count_if(read).alias("n_read"), F.count_if(~read).alias("n_unread"), F.coalesce(F.sum(F.when(read, F.col("characters"))), F.lit(0)).alias("characters"))
    total = F.col("n_read") + F.col("n_unread")
    return out.withColumns(
        {"average": F.when(F.col("n_read") > 0, F.expr("characters div n_read")).otherwise(F.lit(0)), "read_percent": F.when(total > 0, F.bround(100.0 * F.col("n_read") / total, 1)).otherwise(F.lit(0.0))}
    )


def extension_histogram(inputs: DataFrame, label: str = "label", size: str = "size", top: int | None = None) -> DataFrame:
    """Inputs and bytes by extension, the most frequent first."""
    out = inputs.groupBy(extension(label).alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).orderBy(F.desc("n"), "extension")
    return out.limit(top) if top else out


def datasheet_notes(sheet: DataFrame) -> DataFrame:
    """Members of archives, rows with unreliable owners, and files on disk without a creation time."""
    member = F.col("compressed_bytes").isNotNull()
    return sheet.agg(F.count_if(member).alias("members"), F.count_if(~F.col("ownership_reliable") & ~member).alias("unreliable"), F.count_if(F.col("created").isNull() & ~member).alias("no_created"))
