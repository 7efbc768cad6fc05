"""Versions of a delivered table: the difference of two, what a capture adds, what a check finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def diff(old: DataFrame, new: DataFrame, key: str = "file", order: str | None = None) -> DataFrame:
    """Changed cells as file, column, from, to. Cells are compared as stripped strings, null as empty. An added row is one
    change of the column ``*`` from null to (added), a removed one from (present) to (removed). Of rows with one key the last
    counts: by the column ``order``, else by their place in the table."""
    columns = [c for c in new.columns if c not in (key, order)]

    def cells(table: DataFrame, name: str) -> DataFrame:
        have = set(table.columns)
        values = [strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c in have else F.lit("") for c in columns]
        place = F.struct(*[F.col(f"`{order}`")] * (order is not None), F.monotonically_increasing_id().alias("__row"))
        rows = table.select(F.col(f"`{key}`").alias("file"), F.array(*values).cast("array<string>").alias(name), place.alias("__place"))
        return rows.groupBy("file").agg(F.max_by(name, "__place").alias(name))

    both = cells(old, "__old").join(cells(new, "__new"), "file", "full_outer")
    names = F.array(*map(F.lit, columns)).cast("array<string>")
    pairs = F.zip_with(names, F.arrays_zip("__old", "__new"), lambda c, x: F.struct(c.alias("column"), x["__old"].alias("from"), x["__new"].alias("to")))
    edits = F.filter(pairs, lambda x: x["from"] != x["to"])

    def one(before: str | None, after: str) -> Column:
        return F.array(F.struct(F.lit("*").alias("column"), F.lit(before).cast("string").alias("from"), F.lit(after).alias("to")))

    changes = F.when(F.col("__old").isNull(), one(None, "(added)")).when(F.col("__new").isNull(), one("(present)", "(removed)")).otherwise(edits)
    return both.select("file", F.explode(changes).alias("x")).select("file", "x.*")


def not_captured(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents (label, original_sha256) of which the manifest doesn't have this label with these bytes."""
    return documents.join(manifest.select("label", "original_sha256").distinct(), ["label", "original_sha256"], "left_anti")


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Problems of artefacts: ``manifest`` has path, kind and sha256, ``found`` path and sha256 as they are now."""
    now = found.select("path", F.col("sha256").alias("__now"), F.lit(True).alias("__there"))
    joined = manifest.join(now, "path", "left")
    problem = F.when(F.col("__there").isNull(), F.concat(F.lit("missing "), "kind", F.lit(": "), "path")).when(~F.col("__now").eqNullSafe(F.col("sha256")), F.concat("kind", F.lit(" changed: "), "path"))
    return joined.select("path", "kind", problem.alias("problem")).filter("problem is not null")
