"""Every input under the given paths, each as exactly one unit: a file, an archive's member, or something not read.

Listing folders is the driver's work; it yields items, which are files on disk and what is skipped without opening a file.
Opening a file, and walking the archive that it may be, is an executor's work on one item: an archive's budgets are sequential,
so an archive isn't split.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from .limits import LIMITS, MB, ArchiveTooLarge, Budget, Limits, read_member
from .sniff import office_format, skip_reason

_DAMAGE = (OSError, RuntimeError, ValueError, zipfile.BadZipFile)
_TOOLING = frozenset(".git .hg .svn .tox .mypy_cache .pytest_cache .ruff_cache __pycache__".split())


@dataclass(frozen=True)
class Item:
    """Something on disk. With a reason it is accounted for as it stands; without one it is a file to open."""

    path: str
    size: int = 0
    reason: str | None = None
    detail: str | None = None
    files: int | None = None


@dataclass
class Unit:
    """One input: ``open`` gives its bytes, or is None where it isn't read."""

    label: str
    kind: str
    top: str | None = None
    info: zipfile.ZipInfo | None = None
    zip: zipfile.ZipFile | None = None
    reason: str | None = None
    detail: str | None = None
    files: int | None = None

    @property
    def name(self) -> str:
        """The name that tells the format: without the archive's, and without the number of a repeated member."""
        return (self.info.filename if self.info else self.label).replace("\\", "/").rpartition("/")[2]


def _reason_to_pass(root: str, name: str) -> tuple[str, str] | None:
    if name in _TOOLING or Path(root, name, "pyvenv.cfg").is_file():
        return "excluded_directory", "a folder of tools"
    return ("hidden_directory", "a hidden folder") if name.startswith(".") else None


def _files_below(folder: str) -> int:
    return sum(len(files) for _, _, files in os.walk(folder))


def list_items(paths: list[str]) -> Iterator[Item]:
    """Folders in order: what of a folder is passed over, its files, its folders."""

    def folder(path: str) -> Iterator[Item]:
        try:
            with os.scandir(path) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield Item(path, reason="unreadable_directory", detail=f"the folder can't be listed ({e.strerror}); nothing of it was read")
            return
        inner = []
        for e in entries:
            full = os.path.join(path, e.name)
            if not e.is_dir():
                continue
            if e.is_symlink():
                yield Item(full, reason="symlink_not_followed", detail=f"a link to the folder {os.readlink(full)!r}; links aren't followed, but a folder that is named itself is read")
            elif why := _reason_to_pass(path, e.name):
                n = _files_below(full)
                tail = "name it to have it read" if why[0] == "hidden_directory" else "not walked"
                yield Item(full, reason=why[0], detail=f"{why[1]}: {n} file(s) not read; {tail}", files=n)
            else:
                inner.append(full)
        for e in entries:
            if not e.is_dir():
                yield _file(os.path.join(path, e.name))
        for full in inner:
            yield from folder(full)

    for path in paths:
        if os.path.isdir(path):
            yield from folder(path)
        else:
            yield _file(path)


def merge_paths(paths: list[str]) -> list[str]:
    """The paths without those that lie in another of them, or are given twice."""
    real = {p: os.path.realpath(p) for p in dict.fromkeys(paths)}
    kept: dict[str, str] = {}
    for p, r in real.items():
        inside = any(r.startswith(q.rstrip(os.sep) + os.sep) for q in real.values() if q != r)
        if not inside and r not in kept:
            kept[r] = p
    return list(kept.values())


def parse_dropped(payload: str) -> list[str]:
    """Paths of a dropped list: those with spaces stand in braces."""
    return [a or b for a, b in re.findall(r"\{([^}]*)\}|(\S+)", payload)]


def _file(path: str) -> Item:
    try:
        return Item(path, os.stat(path).st_size)
    except OSError:
        return Item(path)


def _opens(data: bytes) -> bool:
    """Whether the bytes are an archive that can be walked; a damaged one is read as what its bytes and name say."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)):
            return True
    except _DAMAGE:
        return False


class ArchiveWalk:
    """The members of one archive on disk, at all depths, within its budgets."""

    def __init__(self, top: str, limits: Limits = LIMITS):
        self.top, self.limits = top, limits
        self.budget = Budget(limits.archive_bytes)
        self.members = self.declared = 0
        self.stopped = False

    def units(self, container: str | bytes, prefix: str, depth: int = 0) -> Iterator[Unit]:
        try:
            zf = zipfile.ZipFile(io.BytesIO(container) if isinstance(container, bytes) else container)
        except _DAMAGE:
            yield Unit(prefix, "file")  # a member is tried before it is walked
            return
        with zf:
            times: dict[str, int] = {}
            for info in zf.infolist():
                if info.is_dir():
                    continue
                if self.stopped:
                    return
                n = times[info.filename] = times.get(info.filename, 0) + 1
                label = f"{prefix}!{info.filename}" + (f"#{n}" if n > 1 else "")
                yield from self._member(zf, info, label, f"{prefix}!{info.filename}", depth)

    def _member(self, zf: zipfile.ZipFile, info: zipfile.ZipInfo, label: str, place: str, depth: int) -> Iterator[Unit]:
        most = self.limits
        if self.members >= most.members or self.declared + info.file_size > most.walk_bytes:
            self.stopped = True
            yield Unit(self.top, "skip", self.top, reason="limit_exceeded", detail=f"after {self.members:,} members (of {most.members:,} at most) and {self.declared // MB:,} MB (of {most.walk_bytes // MB:,} MB at most) the rest wasn't read, from {place} on")
            return
        self.declared += info.file_size
        unit = Unit(label, "member", self.top, info, zf)
        try:
            with zf.open(info) as f:
                head = f.read(1024)
        except _DAMAGE:
            head = b""
        data = None
        if head.startswith(b"PK"):
            try:
                data = read_member(zf, info, self.budget, most)
            except ArchiveTooLarge as e:
                unit.reason, unit.detail = "archive_bomb", str(e)
            except _DAMAGE as e:
                unit.reason, unit.detail = "unreadable", f"{type(e).__name__}: {e}"
        self.members += 1
        if unit.reason is None and data is not None:
            if _opens(data) and not office_format(data):
                if depth < most.depth:
                    yield from self.units(data, label, depth + 1)
                    return
                unit.reason, unit.detail = "limit_exceeded", f"archives nest more than {most.depth} deep; this one wasn't opened"
            else:
                self.budget.refund(len(data))
        if unit.reason is None and (why := skip_reason(info.filename, head, (lambda: data) if data is not None else None)):
            unit.reason, unit.detail = why
        unit.kind = "skip" if unit.reason else "member"
        yield unit

    def read(self, unit: Unit) -> bytes:
        return read_member(unit.zip, unit.info, self.budget, self.limits)


def open_item(item: Item, archives: bool = True, limits: Limits = LIMITS) -> Iterator[tuple[Unit, ArchiveWalk | None]]:
    """The units of an item. A unit's archive is open until the next one is asked for."""
    if item.reason:
        yield Unit(item.path, "skip", reason=item.reason, detail=item.detail, files=item.files), None
        return
    try:
        with open(item.path, "rb") as f:
            head = f.read(1024)
        why = skip_reason(item.path, head, lambda: item.path)
    except OSError:
        why = None
    if why:
        yield Unit(item.path, "skip", reason=why[0], detail=why[1]), None
    elif archives and zipfile.is_zipfile(item.path) and not office_format(item.path):
        walk = ArchiveWalk(item.path, limits)
        for unit in walk.units(item.path, item.path):
            yield unit, walk
    else:
        yield Unit(item.path, "file"), None


def balanced(items: list[tuple[int, Item]], parts: int) -> list[list[tuple[int, Item]]]:
    """Items in parts of like size: the largest first, each to the smallest part so far."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(parts, len(items))))]
    out: list[list[tuple[int, Item]]] = [[] for _ in heap]
    for pair in sorted(items, key=lambda x: -x[1].size):
        size, k = heapq.heappop(heap)
        out[k].append(pair)
        heapq.heappush(heap, (size + pair[1].size + 4096, k))
    return [sorted(p, key=lambda x: x[0]) for p in out if p]
