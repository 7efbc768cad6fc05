"""Rows written as a tree of files and archives, for the queries over the source: what is in it is known exactly."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import warnings
import zipfile
from collections.abc import Sequence

from pyspark.sql import SparkSession


def _folder(spark: SparkSession) -> str:
    """A new folder that the executors see too: in the shared folder where there is one in the file system, else a local run's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ""
    place = base.removeprefix("file://").removeprefix("file:")
    shared = place if place.startswith("/") else None
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if shared:
        os.makedirs(shared, exist_ok=True)
    path = tempfile.mkdtemp(prefix="folioforge-filed-", dir=shared)
    atexit.register(shutil.rmtree, path, True)
    return path


def tree(spark: SparkSession, rows: Sequence[tuple[int, int, str]]) -> str:
    """For each (number, group, text): a file, by its number in a folder, a hidden one, as a picture, or empty; and a member of its group's
    archive, twice in it where the number is even, with the whole again in an archive within."""
    root = _folder(spark)
    archives: dict[int, list[tuple[str, str]]] = {}
    for number, group, text in rows:
        name = {0: f"f{number}.txt", 1: f"sub/f{number}.md", 2: f".hidden{group}/f{number}.txt", 3: f"f{number}.png", 4: f"zero{number}.txt"}[number % 5]
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write("" if number % 5 == 4 else text)
        archives.setdefault(group, []).extend([(f"m{number}.txt", text)] * (2 - number % 2))
    for group, members in archives.items():
        inner = os.path.join(root, f"g{group}.inner")
        for path, more in ((inner, []), (os.path.join(root, f"g{group}.zip"), [inner])):
            with zipfile.ZipFile(path, "w") as z, warnings.catch_warnings():
                warnings.simplefilter("ignore")  # names twice are meant
                for name, text in members:
                    z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), text)
                for x in more:
                    z.write(x, "inner.zip")
        os.unlink(inner)
    return root
