"""Regular expressions that mean the same in every engine, and small helpers on columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Blanks beyond ASCII; texts are brought to ordinary spaces before patterns see them.
BLANKS = "                 　﻿\u000b"


_WORD = "[A-Za-z0-9_]"
_SURE = r"(?:[A-Za-z0-9]|\\d)(?![?*]|\{0)"  # a word character that is not optional
_EDGES = (
    (re.compile(rf"\\b(?=(?:\((?:\?:)?(?={_SURE})[^|()]*\))|{_SURE})"), f"(?<!{_WORD})"),  # a word character must follow
    (re.compile(r"(?<=(?<!\\)[A-Za-z0-9])\\b|(?<=\\d)\\b"), f"(?!{_WORD})"),  # a word character stands before
)


@cache
def rx(pattern: str, ignore_case: bool = True) -> str:
    """A pattern for the JVM in which word edges are ASCII, as they are in RE2. Where the pattern says on which side of an edge
    the word is, only the other side is looked at."""
    for edge, plain in _EDGES:
        pattern = edge.sub(lambda _: plain, pattern)  # noqa: B023
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", _EDGE)


def spaced(c: Column) -> Column:
    return F.translate(c, BLANKS, " " * len(BLANKS))


def collapsed(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(spaced(c), r"\s+", " "))


def text(c: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(F.trim(spaced(c)), F.lit(""))


def has(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(rx(pattern, ignore_case))


def first(c: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The first match's group; null if nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, rx(pattern, ignore_case), group), F.lit(""))


def count(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(c, F.lit(rx(pattern, ignore_case)))


def number(c: Column) -> Column:
    return c.try_cast("double")


def first_rule(c: Column, rules: Iterable[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    out = None
    for name, pattern in rules:
        out = F.when(has(c, pattern), F.lit(name)) if out is None else out.when(has(c, pattern), F.lit(name))
    return out.otherwise(F.lit(None) if otherwise is None else otherwise)


def let(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@cache
def accents() -> tuple[str, str]:
    """(source, target) for ``translate``: Latin letters with marks and their base letters."""
    letters = [chr(cp) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for cp in range(lo, hi)]
    base = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
    pairs = [(c, b) for c, b in base.items() if b != c and b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


#: Digits to which numbers are filled up in natural keys; longer ones stand behind all others, by length.
DIGITS = 12


def natural_key(c: Column) -> Column:
    """A key under which numbers inside texts sort by value, apart from case and the accents of Latin letters."""
    folded = F.lower(F.translate(text(c), *accents()))
    parts = F.regexp_extract_all(folded, F.lit(r"\d+|\D+"), F.lit(0))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+", "")
        longer = F.concat(F.lit(":"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(~p.rlike(r"^\d"), p).when(F.length(digits) > DIGITS, longer).otherwise(F.lpad(digits, DIGITS, "0"))

    return F.array_join(F.transform(parts, part), "")
