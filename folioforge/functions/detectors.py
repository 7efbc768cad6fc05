"""Typed values in text: e-mail addresses, links, amounts, dates, phone numbers, percentages, identifiers.

A detector is a Java regular expression and, where a condition on the match is needed that an expression would test slowly,
a predicate on the match. All run inside Catalyst. The registry is ordered: on ties the first detector names a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip

_AFTER_NO_WORD = r"(?<![\w.])"
_AFTER_NO_DIGIT, _BEFORE_NO_DIGIT = r"(?<!\d)", r"(?!\d)"
_GAP = r"[\s.-]"
_MONTHS = "|".join("January February March April May June July August September October November December".split())


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str
    accepts: Callable[[Column], Column] | None = None
    flags: str = "U"
    #: Characters of which a match has one; where a value has none of them, the expression isn't tried.
    signs: str = ""

    @property
    def regex(self) -> str:
        return f"(?{self.flags}){self.pattern}"

    def all(self, c: Column | str) -> Column:
        """All matches in order."""
        found = F.regexp_extract_all(_col(c), F.lit(self.regex), F.lit(0))
        return F.filter(found, self.accepts) if self.accepts else found

    def may(self, c: Column | str) -> Column:
        found = [F.contains(_col(c), F.lit(x)) for x in self.signs]
        return reduce(or_, found) if found else F.lit(True)

    def first(self, c: Column | str) -> Column:
        """The first match, null if there is none."""
        if self.accepts:
            return F.get(self.all(c), F.lit(0))
        return F.nullif(F.regexp_extract(_col(c), self.regex, 0), F.lit(""))


DETECTORS: tuple[Detector, ...] = (
    Detector("email", r"\b" + r"[A-Za-z0-9._%+-]{1,64}" + "@" + r"[A-Za-z0-9.-]{1,255}" + r"\.[A-Za-z]{2,}" + r"\b", signs="@"),
    Detector("url", r"\bhttps?:" + r'//[^\s<>"]+', flags="iuU", signs=":"),
    Detector("money", _AFTER_NO_WORD + "[$£€]" + r"\s?" + r"\d{1,3}(?:,\d{3})*" + r"(?:\.\d{2})?" + r"(?!\w)", signs="$£€"),
    Detector("date_iso", r"\b" + "-".join((r"\d{4}", r"\d{2}", r"\d{2}")) + r"\b", signs="-"),
    Detector("date_us", r"\b" + "/".join((r"\d{1,2}", r"\d{1,2}", r"\d{2,4}")) + r"\b", signs="/"),
    Detector("date_long", rf"\b(?:{_MONTHS})" + r"\s+\d{1,2}" + r",?\s+" + r"\d{4}\b"),
    Detector("phone_us", _AFTER_NO_DIGIT + rf"(?:\+1{_GAP}?)?" + r"\(?\d{3}\)?" + _GAP + r"\d{3}" + _GAP + r"\d{4}" + _BEFORE_NO_DIGIT),
    Detector("percent", _AFTER_NO_WORD + r"\d{1,3}" + r"(?:\.\d+)?" + r"\s?%", signs="%"),
    # every part ends at a word's end, so none is given back: Java's matcher would keep a frame for each
    Detector("identifier", r"\b[A-Z0-9]{2,}+" + r"(?:-[A-Z0-9]++\b)++", accepts=lambda m: m.rlike(r"(?U)\d"), signs="-"),
)

#: The least share of a value that a match must have to name it.
SHARE = 0.6


def detector(kind: str, registry: tuple[Detector, ...] = DETECTORS) -> Detector:
    for d in registry:
        if d.name == kind:
            return d
    raise KeyError(f"unknown kind of value: {kind!r}")


def find_values(c: Column | str, kind: str, registry: tuple[Detector, ...] = DETECTORS) -> Column:
    """All values of one kind, in the order of the text."""
    return detector(kind, registry).all(c)


def classify(c: Column | str, registry: tuple[Detector, ...] = DETECTORS) -> Column:
    """The kind of a value, or ``text``."""
    value = _col(c)

    def named(v: Column) -> Column:
        kinds = [F.when(d.may(v["value"]) & (F.length(d.first(v["value"])) >= v["least"]), F.lit(d.name)) for d in registry]
        return F.coalesce(*kinds, F.lit("text"))

    # bound once: what a value is held against is the same for all kinds
    bound = F.struct(value.alias("value"), (F.length(strip(value)) * F.lit(SHARE)).alias("least"))
    return F.get(F.transform(F.array(bound), named), F.lit(0))
