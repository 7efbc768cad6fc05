"""User-defined columns: NAME=REGEX, matched without regard to case."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col, strip

#: Syntax that the two regular expression dialects don't share; such fields are matched in Python, by Arrow batches.
#: So are groups that are repeated: Java's matcher recurses for each turn and ends the JVM where a text makes it too deep.
_REPEATED_GROUP = re.compile(r"\)(?:[*+]|\{)")
_PYTHON_ONLY = re.compile(r"\(\?P|\(\?\(|\\Z|\(\?[aLux]|\[\[|\\N\{|&&|\\[pPGQEhHvVRX]|\(\?#|\{,")


@dataclass(frozen=True)
class Field:
    name: str
    pattern: str
    flags: int = re.IGNORECASE

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError(f"a field needs a name: {self.name}={self.pattern}")
        try:
            re.compile(self.pattern, self.flags)
        except re.error as e:
            raise ValueError(f"field {self.name!r}: {self.pattern!r} is not a regular expression ({e})") from None

    @classmethod
    def parse(cls, spec: str) -> Field:
        name, sign, pattern = spec.partition("=")
        if not sign or not name.strip() or not pattern:
            raise ValueError(f"a field is NAME=REGEX, not {spec!r}")
        return cls(name.strip(), pattern)

    @property
    def group(self) -> int:
        """Of an expression with groups the first counts, else the whole match."""
        return min(1, re.compile(self.pattern).groups)

    def find(self, text: str) -> str:
        m = re.search(self.pattern, text, self.flags)
        return (m.group(self.group) or "").strip() if m else ""

    def checked(self, text: str | None) -> tuple[str, str | None]:
        """The value, and why there is none where matching failed."""
        try:
            return self.find(text) if isinstance(text, str) else "", None
        except Exception as e:  # noqa: BLE001
            return "", f"{type(e).__name__}: {e}"

    def column(self, c: Column | str = "text") -> Column:
        """The first match in the text, stripped; empty where there is none."""
        if self.native:
            return F.coalesce(strip(F.regexp_extract(_col(c), f"(?iuU){self.pattern}", self.group)), F.lit(""))
        field = self

        @F.pandas_udf(T.StringType())
        def match(texts):
            return texts.map(lambda t: field.checked(t)[0])

        return match(_col(c))

    @property
    def native(self) -> bool:
        """Whether the pattern is matched inside Catalyst: it means the same there, and no text can fail it."""
        return self.flags == re.IGNORECASE and not _PYTHON_ONLY.search(self.pattern) and not _REPEATED_GROUP.search(self.pattern)
