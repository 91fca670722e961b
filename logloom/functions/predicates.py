"""Row predicates with two-valued logic: what cannot be compared is false, never unknown.

``not_equal`` asks for a value, so null is false; ``not_in`` and the negated text operators take null as true.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.sources.schema import ALIASES

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass(frozen=True)
class Ref:
    """The right side of a comparison is another field."""

    name: str


def surely(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return functools.reduce(operator.or_, columns) if columns else F.lit(False)


def all_of(columns: list[Column]) -> Column:
    return functools.reduce(operator.and_, columns) if columns else F.lit(True)


class Fields:
    """Predicates over the columns of one schema; a field that it lacks is null on every row."""

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema}
        self._asked: dict[int, tuple[Column, str, str]] = {}
        # Rules by the thousand ask for few columns: each is made once.
        self.column, self._plain, self._lower = (functools.cache(f) for f in (self.column, self._plain, self._lower))

    def column(self, name: str) -> tuple[Column, str]:
        """The column and its kind: bool, number, array, text or none."""
        name = name if name in self.types else ALIASES.get(name, name)
        if name not in self.types:
            return F.lit(None).cast("string"), "none"
        t = self.types[name]
        kind = "bool" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "array" if isinstance(t, T.ArrayType) else "text"
        return F.col(name), kind

    def _side(self, value: object) -> tuple[Column, str]:
        if isinstance(value, Ref):
            return self.column(value.name)
        kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"
        return F.lit(value), kind

    @staticmethod
    def _number(c: Column, kind: str) -> Column:
        if kind == "number":
            return c.cast("double")
        if kind == "text":
            return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
        return F.lit(None).cast("double")

    def _plain(self, name: str) -> Column:
        """The column as text."""
        c, kind = self.column(name)
        return F.array_join(c, " ") if kind == "array" else c if isinstance(self.types.get(name), T.StringType) else c.cast("string")

    def _lower(self, name: str) -> Column:
        return F.lower(self._plain(name))

    def equal(self, name: str, value: object) -> Column:
        a, ka = self.column(name)
        if ka == "text" and isinstance(value, str):
            out = surely(a == value)
            self._asked[id(out)] = out, name, value
            return out
        b, kb = self._side(value)
        if ka == "array":
            return surely(F.array_contains(a, b.cast("string")))
        if "bool" in (ka, kb):
            return surely(a == b) if ka == kb else F.lit(False)
        if "number" in (ka, kb):
            return surely(self._number(a, ka) == self._number(b, kb))
        return surely(a == b)

    def text_asked(self, condition: Column) -> tuple[str, str] | None:
        """(field, text), if that is what this condition, made here, compares."""
        out, *asked = self._asked.get(id(condition), (None, None, None))
        return tuple(asked) if out is condition else None

    def not_equal(self, name: str, value: object) -> Column:
        return self.present(name) & ~self.equal(name, value)

    def _ordered(self, name: str, value: object, compare: object) -> Column:
        a, b = (self._number(*x) for x in (self.column(name), self._side(value)))
        return surely(compare(a, b) & ~F.isnan(a) & ~F.isnan(b))

    def less(self, name: str, value: object) -> Column:
        return self._ordered(name, value, operator.lt)

    def at_most(self, name: str, value: object) -> Column:
        return self._ordered(name, value, operator.le)

    def greater(self, name: str, value: object) -> Column:
        return self._ordered(name, value, operator.gt)

    def at_least(self, name: str, value: object) -> Column:
        return self._ordered(name, value, operator.ge)

    def is_in(self, name: str, values: list) -> Column:
        c, kind = self.column(name)
        if kind == "text" and all(isinstance(v, str) for v in values):
            return surely(c.isin(list(values)))
        if kind == "array":
            return surely(F.arrays_overlap(c, F.array(*[F.lit(str(v)) for v in values])))
        return any_of([self.equal(name, v) for v in values])

    def not_in(self, name: str, values: list) -> Column:
        return ~self.is_in(name, values)

    def _texts(self, name: str, needles: str | list[str], method: str, ignore_case: bool) -> Column:
        text = self._lower(name) if ignore_case else self._plain(name)
        listed = [needles] if isinstance(needles, str) else needles
        return surely(any_of([getattr(text, method)(n.lower() if ignore_case else n) for n in listed]))

    def contains(self, name: str, needles: str | list[str], ignore_case: bool = False) -> Column:
        return self._texts(name, needles, "contains", ignore_case)

    def starts_with(self, name: str, needles: str | list[str], ignore_case: bool = False) -> Column:
        return self._texts(name, needles, "startswith", ignore_case)

    def ends_with(self, name: str, needles: str | list[str], ignore_case: bool = False) -> Column:
        return self._texts(name, needles, "endswith", ignore_case)

    def matches(self, name: str, patterns: str | list[str], ignore_case: bool = False) -> Column:
        text = self._plain(name)
        listed = [patterns] if isinstance(patterns, str) else patterns
        return surely(any_of([text.rlike(f"(?i){p}" if ignore_case else p) for p in listed]))

    def missing(self, name: str) -> Column:
        return self.column(name)[0].isNull()

    def present(self, name: str) -> Column:
        return self.column(name)[0].isNotNull()

    def truthy(self, name: str) -> Column:
        c, kind = self.column(name)
        return surely({"bool": c, "number": c != 0, "array": F.size(c) > 0}.get(kind, c != "") if kind != "none" else F.lit(False))
