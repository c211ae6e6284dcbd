"""Mapping of free entries to the closest entry of a reference list; what no entry fits is reported as term 0.

The words of all reference spellings go into a symmetric-delete dictionary: each word under itself and under every
string left when some of its letters are deleted. A typed word finds all words within the edits allowed by looking up
itself and its own deletes. It may also stand for a word that it abbreviates (its first letters, or its first letter and
some of its consonants in order), and for a whole spelling by the initials of its words. Runs of typed words, each as
typed, corrected or written out, are then looked up among the spellings; the best run has most letters less the
weighted Damerau-Levenshtein cost of its corrections, then the greatest reference frequency (rows that hold just this
spelling, counted over all rows), then the smallest id. Words around it (places, counts, ratings, remarks) do not matter.

The score of a spelling depends on the value and that spelling only, so the result is the same in however many broadcast
blocks of ``BLOCK_ENTRIES`` spellings the list goes; a longer list is matched block after block within one scan, the best
so far going along with the row. Rows are never shuffled or joined.

Parameters: ``edits``, the edits allowed from which word length on (``EDITS``); ``abbreviations``, whether abbreviated words
count. A word shorter than the least length in ``edits`` is matched as typed or as an abbreviation only.

Defined results: null and blank values give no row. A field without entries gives term 0. Ids of terms must be positive.
Repeated rows each come out; very long values are matched whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import materialise, release

#: Spellings in one broadcast dictionary.
BLOCK_ENTRIES = 20_000
#: (letters of a reference word, edits): words of so many letters or more may be typed with so many edits.
EDITS = ((5, 1), (9, 2))
#: Letters a correction of cost 1 must outweigh.
PENALTY = 1.5
#: Least letters of an abbreviation, and what it counts less than its letters.
LEAST_SHORT, SHORT = 3, 0.5
#: Letters of a spelling that are not in the value weigh so much against those that are; words of a spelling in another order
#: than its own, or apart, cost so many letters.
MISSING, SCATTERED = 1.0, 0.25
#: Endings apart from which words are the same, where so many letters are left; how much less they count.
_ENDINGS, LEAST_STEM, STEM = ("ing", "ers", "er", "ed", "es", "s"), 4, 0.5
#: Words that initials pass over.
_SMALL = frozenset("a an and by for in of on the to with".split())
#: Values whose match a worker keeps.
CACHE = 200_000

_ABBREVIATION = re.compile(r"\b(?:[a-z]\.){1,}(?:[a-z]\b)?")
_WORDS = re.compile(r"[^\W_]+")


def words(value: str) -> list[str]:
    """The words of a value: compatibility forms made plain, lower case, abbreviations without dots."""
    plain = unicodedata.normalize("NFKC", value).lower()
    plain = _ABBREVIATION.sub(lambda m: m[0].replace(".", "") + " ", plain)
    return _WORDS.findall(plain)


def cost(typed: str, word: str) -> float:
    """Weighted Damerau-Levenshtein cost: swapped neighbours and doubled letters cost less than other edits, a wrong
    first letter more."""
    n, m = len(typed), len(word)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                rows[i][j] = float(i + j)
                continue
            first = 0.2 if 1 in (i, j) else 0.0
            extra = 0.7 if i > 1 and typed[i - 1] == typed[i - 2] else 1.0 + first
            missing = 0.7 if j > 1 and word[j - 1] == word[j - 2] else 1.0 + first
            best = min(rows[i - 1][j] + extra, rows[i][j - 1] + missing, rows[i - 1][j - 1] + (0.0 if typed[i - 1] == word[j - 1] else 1.0 + first))
            if i > 1 and j > 1 and typed[i - 1] == word[j - 2] and typed[i - 2] == word[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 0.8)
            rows[i][j] = best
    return rows[n][m]


def deletes(word: str, edits: int = 1) -> set[str]:
    """The word, and what is left of it without up to ``edits`` letters."""
    found = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words (no letter edited twice)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[len(b)]


def abbreviates(short: str, word: str) -> bool:
    """First letters of the word, at least two fewer; or its first letter and some of its consonants in order."""
    if not LEAST_SHORT <= len(short) <= len(word) - 2 or short[0] != word[0] or not short.isalpha():
        return False
    if word.startswith(short):
        return True
    rest = iter(word[1:])
    return not set(short[1:]) & set("aeiou") and all(c in rest for c in short[1:])


def stem(word: str) -> str:
    """A word without its ending."""
    return next((word[: -len(e)] for e in _ENDINGS if word.endswith(e) and len(word) - len(e) >= LEAST_STEM), word)


class Dictionary:
    """Spellings of one field: (words, term id, frequency)."""

    def __init__(self, entries: list[tuple[tuple[str, ...], int, int]], edits: tuple[tuple[int, int], ...] = EDITS, abbreviations: bool = True) -> None:
        self.phrases: dict[tuple[str, ...], tuple[int, int]] = {}
        for phrase, term, freq in entries:
            if phrase:
                self.phrases[phrase] = max(self.phrases.get(phrase, (-1, 0)), (freq, -term))
        self.edits = edits
        self.most = max((n for _, n in edits), default=0)
        self.least = min((least - n for least, n in edits), default=0)
        self.abbreviations = abbreviations
        self.known = {w for p in self.phrases for w in p}
        self.longest = max(map(len, self.known), default=0)
        self.near: dict[str, list[str]] = defaultdict(list)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for w in self.known:
            self.by_first[w[0]].append(w)
            if n := self.allowed(w):
                for d in deletes(w, n):
                    self.near[d].append(w)
        self.within: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        self.by_stem: dict[str, list[str]] = defaultdict(list)
        for w in self.known:
            self.by_stem[stem(w)].append(w)
        self.initials: dict[str, tuple[int, int]] = {}
        self.short = {p[0]: hit for p, hit in self.phrases.items() if abbreviations and len(p) == 1 and len(p[0]) >= LEAST_SHORT}
        self.lengths = sorted({len(w) for w in self.short})
        for p, hit in self.phrases.items():
            for w in set(p):
                self.within[w].append(p)
            if abbreviations and len(p) >= LEAST_SHORT:
                short = "".join(w[0] for w in p)
                self.initials[short] = max(self.initials.get(short, (-1, 0)), hit)
        self.kept: dict[str, dict[str, float]] = {}

    def allowed(self, word: str) -> int:
        return max((n for least, n in self.edits if len(word) >= least), default=0)

    def options(self, typed: str) -> dict[str, float]:
        """Reference words that a typed word may stand for, with the letters that each counts for."""
        found = self.kept.get(typed)
        if found is None:
            found = self.kept[typed] = {typed: float(len(typed))} if typed in self.known else {}
            if self.least <= len(typed) <= self.longest + self.most:  # others are within no word's edits
                for w in {w for d in deletes(typed, self.most) for w in self.near.get(d, ())} - {typed}:
                    if distance(typed, w) <= self.allowed(w):
                        found[w] = len(w) - PENALTY * cost(typed, w)
            for w in self.by_stem.get(stem(typed), ()):
                found[w] = max(found.get(w, 0.0), len(stem(w)) - STEM)
            if self.abbreviations:
                for w in self.by_first.get(typed[0], ()):
                    if abbreviates(typed, w):
                        found[w] = max(found.get(w, 0.0), len(typed) - SHORT)
        return found

    def best(self, value: str) -> tuple[float, int, int]:
        """(score, frequency, term), term 0 if nothing fits."""
        if len(self.kept) > CACHE:
            self.kept.clear()
        places: dict[str, list[tuple[int, float]]] = defaultdict(list)
        found = (0.0, -1, 0)
        every = words(value)
        firsts = "".join(w[0] for w in every if w not in _SMALL)
        for run in (firsts[i : i + n] for n in self.lengths for i in range(len(firsts) - n + 1)):
            if hit := self.short.get(run):  # a spelling of initials written out
                found = max(found, (len(run) - SHORT, *hit))
        for i, typed in enumerate(every):
            if hit := self.initials.get(typed):
                found = max(found, (len(typed) - SHORT, *hit))
            for w, letters in self.options(typed).items():
                places[w].append((i, letters))
        for phrase in {p for w in places for p in self.within[w]}:
            score = self.score(phrase, places)
            if score > 0 and score >= found[0]:
                found = max(found, (score, *self.phrases[phrase]))
        return found[0], found[1], -found[2]

    def score(self, phrase: tuple[str, ...], places: dict[str, list[tuple[int, float]]]) -> float:
        """The letters of a spelling that are in a value, less a part of those that are not."""
        spots = [dict(places.get(w, ())) for w in phrase]
        runs = [sum(hits) for i in spots[0] if None not in (hits := [spot.get(i + k) for k, w, spot in zip(range(len(phrase)), phrase, spots)])]
        sure = [max((x for x in spot.values() if x >= len(stem(w)) - STEM), default=None) for w, spot in zip(phrase, spots)]
        lost = sum(len(w) for w, x in zip(phrase, sure) if x is None)
        return max([*runs, sum(x for x in sure if x is not None) - MISSING * lost - SCATTERED])


def spellings(terms: DataFrame, aliases: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """``field, term, spelling`` of a reference list (``field, term, label``): labels and their other spellings."""
    rows = [(field, label, other) for field, labels in aliases.items() for label, others in labels.items() for other in others]
    spark = terms.sparkSession
    other = spark.createDataFrame(rows or [("", "", "")], "field string, label string, spelling string")
    own = terms.where("label IS NOT NULL AND term IS NOT NULL").select("field", "term", F.col("label").alias("spelling"))
    return own.unionByName(terms.join(other, ["field", "label"]).select("field", "term", "spelling"))


def match(
    values: DataFrame, id_: str, fields: list[str], terms: DataFrame, aliases: dict[str, dict[str, tuple[str, ...]]],
    edits: tuple[tuple[int, int], ...] = EDITS, abbreviations: bool = True,
) -> DataFrame:
    """``id_, field_name, term_id``: one row for each value of ``fields`` that is neither null nor blank.

    The dictionary goes to the workers, so the reference list with its frequencies is read when the query is built: one scan
    of the values, summed by spelling, whatever the length of the list."""
    entries = spellings(terms, aliases)
    n = entries.count()
    n_blocks = max(1, math.ceil(n / BLOCK_ENTRIES))
    best = values.select(
        F.col(id_).alias("id"), *[F.col(f).alias(f"v{k}") for k, f in enumerate(fields)],
        *[c for k in range(len(fields)) for c in (F.lit(0.0).alias(f"s{k}"), F.lit(-1).cast("bigint").alias(f"f{k}"), F.lit(0).cast("bigint").alias(f"t{k}"))],
    )
    frequency = _frequencies(values, fields, entries, n <= BLOCK_ENTRIES)
    if n_blocks > 1:
        frequency = materialise(frequency, "frequency")
    for block in range(n_blocks):
        part = frequency.where(F.pmod(F.xxhash64("field", "spelling"), F.lit(n_blocks)) == block)
        rows = [(r.field, tuple(words(r.spelling)), r.term, r.n) for r in part.collect()]
        books = [Dictionary([(p, t, c) for field, p, t, c in rows if field == f], edits, abbreviations) for f in fields]
        best = _better(best, len(fields), values.sparkSession.sparkContext.broadcast(books))
    release(frequency)
    cells = [F.struct(F.lit(f).alias("field_name"), F.col(f"v{k}").alias("value"), F.col(f"t{k}").alias("term_id")) for k, f in enumerate(fields)]
    long = best.select("id", F.explode(F.array(*cells)).alias("c"))
    return long.where(r"c.value IS NOT NULL AND c.value RLIKE '(?U)[^\\s\\p{Cf}]'").select(F.col("id").alias(id_), "c.field_name", F.col("c.term_id").alias("term_id"))


def _frequencies(values: DataFrame, fields: list[str], entries: DataFrame, few: bool) -> DataFrame:
    """``field, term, spelling, n``: the rows of the whole table that hold just the spelling, apart from case. few: the list is
    short enough to go to the workers, where values that no entry spells are dropped before anything is shuffled."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.col(f))).alias("low")) for f in fields])).alias("c")
    wanted = entries.withColumn("low", F.lower(F.trim("spelling")))
    found = values.select(cells).select("c.*").where("low IS NOT NULL")
    if few:
        found = found.join(F.broadcast(wanted.select("field", "low").distinct()), ["field", "low"], "left_semi")
    counts = found.groupBy("field", "low").agg(F.count("*").alias("n"))
    return wanted.join(counts, ["field", "low"], "left").select("field", "term", "spelling", F.coalesce("n", F.lit(0)).alias("n"))


def _better(best: DataFrame, n_fields: int, books) -> DataFrame:
    """``best`` with better matches from one block of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, tuple[float, int, int]]] = [{} for _ in range(n_fields)]
        for batch in batches:
            names, columns = list(batch.schema.names), list(batch.columns)
            for k in range(n_fields):
                coded = batch.column(f"v{k}").dictionary_encode()
                cache = kept[k]
                if len(cache) > CACHE:
                    cache.clear()
                found = []
                for value in coded.dictionary.to_pylist():
                    hit = cache.get(value)
                    if hit is None:
                        hit = cache[value] = books.value[k].best(value)
                    found.append(hit)
                at = [names.index(f"{c}{k}") for c in "sft"]
                old = zip(*(columns[i].to_pylist() for i in at))
                rows = [max(o, found[i], key=lambda x: (x[0], x[1], -x[2])) if i is not None else o for o, i in zip(old, coded.indices.to_pylist())]
                for i, kind, column in zip(at, (pa.float64(), pa.int64(), pa.int64()), zip(*rows) if rows else ((), (), ())):
                    columns[i] = pa.array(column, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return best.mapInArrow(run, best.schema)
