"""Cells of delivered tables: formula guard, cell limit, sizes, times, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

CELL_LIMIT = 32_767
PREVIEW_LIMIT = 100_000
_LEADS = list("=+-@\t\r")
_PLAIN_NEGATIVE = r"\A-[$£€]?" + r"([0-9]+|[0-9]{1,3}(,[0-9]{3})+)" + r"(\.[0-9]+)?%?\z"


def csv_safe(c: Column | str) -> Column:
    """The cell, with an apostrophe before what a spreadsheet would take for a formula. Null is an empty cell."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    formula = F.substring(text, 1, 1).isin(_LEADS) & ~text.rlike(_PLAIN_NEGATIVE)
    return F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)


def fit_cell(c: Column | str, limit: int = CELL_LIMIT) -> Column:
    """The cell, cut to the limit with a note of its full length where it is longer."""
    text = _col(c)
    note = F.concat(F.lit(" [... truncated: "), F.format_number(F.length(text), 0), F.lit(" characters in full]"))
    cut = F.concat(F.substring(text, F.lit(1), F.lit(limit) - F.length(note)), note)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def is_cut(c: Column | str, limit: int = CELL_LIMIT) -> Column:
    return F.when(F.length(_col(c)) > limit, "True").otherwise("False")


def human_size(c: Column | str) -> Column:
    """Bytes as B, KB, MB, GB or TB, by 1024s."""
    n = _col(c).cast("double")
    out = F.when(n < 1024, F.format_string("%d B", _col(c).cast("long")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1)))


def iso_time(c: Column | str) -> Column:
    """Seconds since 1970 as an ISO time in UTC, to the second."""
    when = F.timestamp_seconds(F.floor(_col(c)))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), when.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def preview(c: Column | str, limit: int = PREVIEW_LIMIT) -> Column:
    """The start of a text with a note of how much is left out."""
    text = _col(c)
    note = F.concat(F.lit("\n[... "), F.format_number(F.length(text) - limit, 0), F.lit(" more characters]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def duration(c: Column | str) -> Column:
    """Seconds as milliseconds, seconds or minutes."""
    s = _col(c).cast("double")
    return F.when(s < 1, F.format_string("%.0f ms", s * 1000)).when(s < 90, F.format_string("%.1f s", s)).otherwise(F.format_string("%.1f min", s / 60))
