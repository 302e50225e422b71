"""The filter algebra, compiled to Column predicates before any ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that can't be read."""


@dataclass(frozen=True)
class Eq:
    field: str
    value: object

    def column(self) -> Column:
        return F.coalesce(F.col(self.field) == F.lit(self.value), F.lit(False))


@dataclass(frozen=True)
class StartsWith:
    field: str
    prefix: str

    def column(self) -> Column:
        return F.coalesce(F.col(self.field).startswith(self.prefix), F.lit(False))


@dataclass(frozen=True)
class And:
    parts: tuple = ()

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Or:
    parts: tuple = ()

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class ValidTimeRange:
    """after <= valid_from < before; either may be open."""

    after: int | None = None
    before: int | None = None

    def column(self) -> Column:
        at = F.col("valid_from")
        out = at.isNotNull()
        if self.after is not None:
            out = out & (at >= self.after)
        if self.before is not None:
            out = out & (at < self.before)
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class AnyCategory:
    """The array column shares a value with the wanted ones."""

    wanted: tuple
    field: str = "categories"

    def __post_init__(self):
        if len(self.wanted) > 16 or any(not 1 <= len(x.encode()) <= 64 for x in self.wanted):
            raise FilterError("at most 16 categories of 1 to 64 bytes")

    def column(self) -> Column:
        return F.coalesce(F.arrays_overlap(F.col(self.field), F.array(*map(F.lit, self.wanted))), F.lit(False))


def parse_filter(text: str) -> Eq | StartsWith:
    """field = 'value' or field LIKE 'prefix%'."""
    if m := re.fullmatch(r"\s*(\w[\w.]*)\s*=\s*'([^']*)'\s*", text):
        return Eq(m[1], m[2])
    if m := re.fullmatch(r"\s*(\w[\w.]*) LIKE '([^']*)'\s*", text):
        if not m[2].endswith("%") or "%" in m[2][:-1]:
            raise FilterError("LIKE takes one % at its end")
        return StartsWith(m[1], m[2][:-1])
    raise FilterError("neither = nor LIKE with a quoted value" if "'" in text else "the value isn't quoted")
