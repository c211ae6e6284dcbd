"""References to boards: placeholder test, consistent spelling and comparison key, all inside the JVM.

The character tables are built by rule from Python's Unicode data; only the look-alike letters are a fixed list.
"""

from __future__ import annotations

import sys
import unicodedata as U
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no reference".
PLACEHOLDERS = ("", "-", "TBC", "N/A")

#: Letters that look alike, as Latin, Cyrillic, Greek; "." where a script has no such letter.
LOOKALIKES = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "."), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"),
    ("J", "Ј", "."), ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", ".", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"),
    ("S", "Ѕ", "."), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", ".", "Υ"), ("Z", ".", "Ζ"),
    ("a", "а", "."), ("c", "с", "."), ("e", "е", "."), ("i", "і", "."), ("j", "ј", "."), ("o", "о", "ο"),
    ("p", "р", "."), ("s", "ѕ", "."), ("x", "х", "."), ("y", "у", "."),
)
SCRIPTS = ("latin", "cyrillic", "greek")
_NAMES = ("LATIN ", "CYRILLIC ", "GREEK ")
_LETTER_BLOCKS = ((0x41, 0x250), (0x370, 0x400), (0x400, 0x530), (0x1E00, 0x2000))
_STYLES = {"<wide>", "<narrow>", "<font>", "<circle>", "<super>", "<sub>", "<noBreak>"}


@cache
def plain_table() -> tuple[str, str]:
    """(source, target) for ``translate``: styled to plain, blanks to a space, dashes to a hyphen-minus; what the
    target is too short for is dropped (invisible characters)."""
    src, dst, gone = [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or 0xF0000 <= cp:
            continue
        ch = chr(cp)
        cat = U.category(ch)
        if cat == "Cf" or 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp < 0xE01F0 or ch in "͏ᅟᅠㅤﾠ":
            gone.append(ch)
        elif cat in ("Zs", "Zl", "Zp") or cp == 0x85:
            src.append(ch)
            dst.append(" ")
        elif cat == "Cc":
            gone.append(ch)
        elif cat == "Pd" or cp == 0x2212:
            src.append(ch)
            dst.append("-")
        elif (d := U.decomposition(ch)) and d.split()[0] in _STYLES and len(k := U.normalize("NFKC", ch)) == 1:
            src.append(ch)
            dst.append("-" if U.category(k) == "Pd" or k == "−" else k)
    for cp in range(0x20):
        if chr(cp) in "\t\n\v\f\r":
            src.append(chr(cp))
            dst.append(" ")
        else:
            gone.append(chr(cp))
    gone.append("\x7f")
    return "".join(src + [g for g in gone if g != "\0"]), "".join(dst)


def lookalike_table(script: str) -> tuple[str, str]:
    """(source, target) for ``translate``: every look-alike letter as the one of ``script``."""
    k = SCRIPTS.index(script)
    pairs = [(x, row[k]) for row in LOOKALIKES if row[k] != "." for x in row if x not in (".", row[k])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


@cache
def anchor_letters(script: str) -> str:
    """The letters of ``script`` whose base letter has no double in another script. A capital's small form without a
    double counts by its own shape."""
    doubles = {x for row in LOOKALIKES for x in row}
    name = _NAMES[SCRIPTS.index(script)]
    letters = (chr(cp) for lo, hi in _LETTER_BLOCKS for cp in range(lo, hi))
    return "".join(c for c in letters if U.category(c)[0] == "L" and U.name(c, "").startswith(name) and U.normalize("NFD", c)[0] not in doubles)


@cache
def anchors(script: str) -> str:
    """``anchor_letters`` as the body of a character class."""
    runs: list[list[int]] = []
    for cp in map(ord, anchor_letters(script)):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


@cache
def compositions() -> tuple[tuple[str, str], ...]:
    """(base and mark, composed letter) for the letters of the three scripts, shortest chains first."""
    found = []
    for lo, hi in _LETTER_BLOCKS:
        for cp in range(lo, hi):
            d = U.decomposition(chr(cp))
            if d and not d.startswith("<") and len(d.split()) == 2 and U.normalize("NFC", chr(cp)) == chr(cp):
                found.append((len(U.normalize("NFD", chr(cp))), "".join(chr(int(x, 16)) for x in d.split()), chr(cp)))
    return tuple((k, v) for _, k, v in sorted(found))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, and written once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


_ASCII = r"^[\x20-\x7E]*\z"
#: Blocks of the scripts beside Latin; without their letters nothing has to be unified.
_OTHER_SCRIPTS = r"[\u0370-\u052F\u1F00-\u1FFF]"


def consistent_form(ref: Column) -> Column:
    """A ref in its consistent form; null stays null."""

    def unify(plain: Column) -> Column:
        n = {s: F.length(plain) - F.length(F.translate(plain, anchor_letters(s), "")) for s in SCRIPTS}

        def pick(c: Column) -> Column:
            form = {s: F.translate(plain, *lookalike_table(s)) for s in SCRIPTS}
            return (
                F.when((c["cyrillic"] > c["latin"]) & (c["cyrillic"] >= c["greek"]), form["cyrillic"])
                .when((c["greek"] > c["latin"]) & (c["greek"] > c["cyrillic"]), form["greek"])
                .otherwise(form["latin"])
            )

        return F.when(~plain.rlike(_OTHER_SCRIPTS), plain).otherwise(_let(F.struct(*[n[s].alias(s) for s in SCRIPTS]), pick))

    def compose(text: Column) -> Column:
        pairs = F.split(F.lit("\n".join(k + "\t" + v for k, v in compositions())), "\n")
        one = lambda acc, p: F.replace(acc, F.substring_index(p, "\t", 1), F.substring_index(p, "\t", -1))
        return F.when(text.rlike("[\u0300-\u036f]"), F.aggregate(pairs, text, one)).otherwise(text)

    return F.trim(F.when(ref.rlike(_ASCII), ref).otherwise(_let(_let(F.translate(ref, *plain_table()), unify), compose)))


def is_reference(consistent: Column) -> Column:
    """True where a consistent form is a reference, not a placeholder; false for null."""
    return F.coalesce(~consistent.isin(*PLACEHOLDERS), F.lit(False))


def key_of(consistent: Column) -> Column:
    """The comparison key of a consistent form; null for a placeholder. A ref of separators only keeps its form."""
    key = F.translate(F.upper(consistent), " ._/-", "")
    return F.when(is_reference(consistent), F.coalesce(F.nullif(key, F.lit("")), consistent))


def board_key(ref: Column) -> Column:
    """The board key of a raw ref; null where it holds no reference."""
    return _let(consistent_form(ref), key_of)


# --- the same rules as SQL text, for the oracle -------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_is_reference(form: str) -> str:
    return f"coalesce({form} NOT IN ({', '.join(map(_q, PLACEHOLDERS))}), false)"


def sql_key(form: str) -> str:
    """DuckDB SQL of ``key_of`` over a column that holds a consistent form."""
    return f"CASE WHEN {sql_is_reference(form)} THEN coalesce(nullif(regexp_replace(upper({form}), '[ ._/\\-]+', '', 'g'), ''), {form}) END"


if sys.maxunicode < 0x10FFFF:  # pragma: no cover
    raise ImportError("needs a Python with the full Unicode range")
