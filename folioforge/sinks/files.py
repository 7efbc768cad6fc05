"""Delivered files: CSV, JSON lines, printed summaries. One file each, written in order from the rows as they come."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Sequence
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import delivered
from ..sources.readers.plain import ENCODINGS

SUMMARY_ROWS, SUMMARY_WIDTH = 20, 28


def write_csv(table: DataFrame, path: str | Path) -> int:
    """The table as one CSV file with a header, whatever its number of rows; returns that number. The rows come to the
    driver a partition at a time."""
    cells, n = delivered(table), 0
    with Path(path).open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(cells.columns)
        for row in cells.toLocalIterator(prefetchPartitions=True):
            out.writerow(row)
            n += 1
    return n


def save_csv(table: DataFrame, folder: str) -> None:
    """The same cells as a folder of CSV files, written by the executors: for tables that no one opens in a spreadsheet."""
    delivered(table).write.option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(folder)


def read_csv_rows(path: str | Path) -> tuple[list[dict[str, str]], list[str], str]:
    """Rows, columns and encoding of a corrected table: UTF-8, else Windows-1252."""
    raw = Path(path).read_bytes()
    for encoding in ENCODINGS:
        try:
            table = csv.DictReader(io.StringIO(raw.decode(encoding), newline=""))
        except UnicodeDecodeError:
            continue
        return list(table), list(table.fieldnames or ()), encoding
    raise ValueError(f"{path} is neither UTF-8 nor Windows-1252; save it as CSV UTF-8")


def write_json(table: DataFrame, out: IO[str]) -> int:
    """A JSON object per row; empty cells are kept."""
    n = 0
    for row in table.toLocalIterator(prefetchPartitions=True):
        out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
        n += 1
    return n


def save_json(table: DataFrame, folder: str) -> None:
    table.write.option("ignoreNullFields", False).json(folder)


def banner(name: str) -> str:
    return f"===== {name} ====="


def shown(table: DataFrame, rows: int = SUMMARY_ROWS, width: int = SUMMARY_WIDTH) -> str:
    """The first rows without the column ``text``, cells cut to a width, columns aligned."""
    names = [c for c in table.columns if c != "text"]
    short = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\s+", " ").alias(c) for c in names]
    cut = lambda s: s if len(s) <= width else s[: width - 3] + "..."
    lines = [[cut(c) for c in names], *([cut(v) for v in r] for r in table.select(*short).limit(rows).collect())]
    wide = [max(map(len, column)) for column in zip(*lines)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, wide)).rstrip() for line in lines)


def check_writable(paths: Sequence[str]) -> list[str]:
    """What is wrong with the places where files will be written, before any work is done."""
    problems = []
    for p in filter(None, paths):
        folder = os.path.dirname(os.path.abspath(p))
        if os.path.isdir(p):
            problems.append(f"{p} is a folder")
        elif not os.path.isdir(folder):
            problems.append(f"the folder {folder} doesn't exist")
        elif not os.access(p if os.path.exists(p) else folder, os.W_OK):
            problems.append(f"{p} can't be written")
    return problems
