"""String columns with the white space and line rules of Python's ``str``: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character that Python's str.strip takes off; ``(?U)`` must be on.
SPACE = r"[\s\x1c-\x1f]"
#: White space at the end; a run of it inside is looked at once, not from each of its places.
_LAST = rf"(?<!{SPACE}){SPACE}++$"
#: What str.splitlines splits at.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)^{SPACE}+|{_LAST}", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"(?U){_LAST}", "")


def is_blank(c: Column | str) -> Column:
    """Whether nothing but white space is there; null counts as blank."""
    return ~F.coalesce(_col(c), F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def split_lines(c: Column | str) -> Column:
    """The lines, with white space at their ends removed."""
    return F.transform(F.split(_col(c), LINE_BREAK, -1), rstrip)


def normalize_label(c: Column | str) -> Column:
    """A label as a key: lower case, single spaces, no colons at its end."""
    one_spaced = strip(F.regexp_replace(_col(c), rf"(?U){SPACE}+", " "))
    return F.lower(strip(F.regexp_replace(one_spaced, "(?<!:):++$", "")))


def holds(query: str, *columns: Column | str) -> Column:
    """Whether a row's columns, joined by spaces, hold the query, whatever its case."""
    return F.contains(F.lower(F.concat_ws(" ", *map(_col, columns))), F.lit(query.lower()))


def basename(c: Column | str) -> Column:
    """Last part of a label: after the last ``!`` (archive member) and the last slash of either kind."""
    member = F.element_at(F.split(_col(c), "!"), -1)
    return F.regexp_extract(member, r"([^/\\]*)$", 1)


def extension(c: Column | str) -> Column:
    """Lower-case extension without its dot, or an empty string."""
    return F.lower(F.regexp_extract(basename(c), r"[^.]\.([^.]+)$", 1))
