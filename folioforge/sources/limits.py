"""Bounds on untrusted input, and the ways in which reading a document can fail.

Every failure is an exception class with a reason code; readers raise them, and the source turns them into rows.
"""

from __future__ import annotations

import zipfile
import zlib
from dataclasses import dataclass

MB = 1 << 20

REASONS = (
    "encrypted", "undecodable_fonts", "unsupported_format", "empty_file", "truncated_or_corrupt", "no_text_found", "limit_exceeded", "archive_bomb",
    "unreadable", "error", "image_no_text_layer", "not_a_document", "hidden_directory", "excluded_directory", "symlink_not_followed", "unreadable_directory",
    "field_extraction_failed",
)


@dataclass(frozen=True)
class Limits:
    member_bytes: int = 256 * MB
    archive_bytes: int = 1024 * MB
    ratio: int = 200
    pdf_stream_bytes: int = 64 * MB
    pdf_object_bytes: int = 32 * MB
    depth: int = 8
    members: int = 20_000
    walk_bytes: int = 1024 * MB


LIMITS = Limits()


class ReadFailure(Exception):
    reason = "error"


class UnsupportedFormat(ReadFailure):
    reason = "unsupported_format"


class EncryptedDocument(ReadFailure):
    reason = "encrypted"


class UndecodableFonts(ReadFailure):
    reason = "undecodable_fonts"


class ArchiveTooLarge(ReadFailure):
    reason = "archive_bomb"


class StreamTooLarge(ReadFailure):
    reason = "limit_exceeded"


class NoTextFound(ReadFailure):
    def __init__(self, reason: str, detail: str):
        super().__init__(f"{reason}: {detail}")
        self.reason, self.detail = reason, detail


def reason_of(e: BaseException) -> tuple[str, str]:
    if isinstance(e, NoTextFound):
        return e.reason, e.detail
    if isinstance(e, ReadFailure):
        return e.reason, str(e)
    named = f"{type(e).__name__}: {e}"
    return ("unreadable" if isinstance(e, OSError | zipfile.BadZipFile) else "error"), named


class Budget:
    """Bytes that one archive may still give."""

    def __init__(self, total: int = LIMITS.archive_bytes):
        self.left = self.total = total

    def spend(self, size: int, name: str) -> None:
        if size > self.left:
            raise ArchiveTooLarge(f"at {name}, the archive is past its limit of {self.total // MB} MB in total")
        self.left -= size

    def refund(self, size: int) -> None:
        self.left += size


def check_member(info: zipfile.ZipInfo, budget: Budget | None = None, limits: Limits = LIMITS) -> int:
    """Refuses a member by what its header declares, before anything is read."""
    if info.file_size > limits.member_bytes:
        raise ArchiveTooLarge(f"{info.filename}: {info.file_size // MB} MB declared; a member may have {limits.member_bytes // MB} MB")
    if info.compress_size and info.file_size > limits.ratio * info.compress_size:
        raise ArchiveTooLarge(f"{info.filename}: it would grow {info.file_size / info.compress_size:.0f} times; {limits.ratio} is the limit")
    if budget:
        budget.spend(info.file_size, info.filename)
    return info.file_size


def read_member(zf: zipfile.ZipFile, info: zipfile.ZipInfo, budget: Budget | None = None, limits: Limits = LIMITS) -> bytes:
    """Reads a member in one bounded call, so that a forged size in its header is found out before memory fills."""
    check_member(info, budget, limits)
    most = min(limits.member_bytes, info.compress_size * limits.ratio) if info.compress_size else limits.member_bytes
    with zf.open(info) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ArchiveTooLarge(f"{info.filename}: its data go on past {most} bytes, whatever its header says")
    return data


def inflate(raw: bytes, limits: Limits = LIMITS) -> bytes | None:
    """Deflated bytes, None if they are none. What ends early gives what there is."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(raw, limits.pdf_stream_bytes)
    except zlib.error:
        return None
    if d.unconsumed_tail:
        raise StreamTooLarge(f"a stream inflates past {limits.pdf_stream_bytes // MB} MB")
    return out
