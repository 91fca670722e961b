"""Addresses as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def inet6_text(hexed: Column) -> Column:
    """The short form of an address of 32 hexadecimal digits, null for anything else: groups without leading zeros, the first longest run of two or more zero groups as ::, and the last
    32 bits in dotted form where only they, or they after ffff, follow zeros.
    """
    digits = F.when(hexed.rlike("^[0-9A-Fa-f]{32}$"), F.lower(hexed))
    return _once(digits, lambda h: F.when(h.isNotNull(), F.coalesce(_dotted(h), _once(_groups(h), _shortened))))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _groups(digits: Column) -> Column:
    """The eight groups without leading zeros, a colon on either side of each."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(digits, 4 * i + 1, F.lit(4)), "^0{1,3}", ""))
    return F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))


def _shortened(text: Column) -> Column:
    runs = [F.when(text.rlike(f"(?::0){{{n}}}:"), F.regexp_replace(text, f"^(.*?)(?::0){{{n}}}:(.*)$", "$1::$2")) for n in range(8, 1, -1)]
    return F.regexp_replace(F.coalesce(*runs, text), "^:(?!:)|(?<!:):$", "")


def _dotted(digits: Column) -> Column:
    quad = F.concat_ws(".", *[F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10) for i in range(4)])
    return F.when(digits.rlike("^0{20}ffff"), F.concat(F.lit("::ffff:"), quad)).when(digits.rlike("^0{24}(?!0{4})"), F.concat(F.lit("::"), quad))
