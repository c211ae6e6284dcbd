"""Splitting of oversized texts at natural boundaries, with overlap, in tokens of a public tokenizer.

Python's part is one letter per token that tells how strong a boundary its end is; the cutting itself is a regular
expression with bounded quantifiers over those letters, whose alternatives are ordered by strength and consume up to the
limit, the last of them at any character. Array functions turn the matches into pieces and look back for the overlap. Work
grows in proportion to a text's length: stops are running sums over blocks, and pieces are cut from bytes at known places.

Defined results: texts within the limit are one piece; null and empty texts are one empty piece with no tokens. Only the
first cut of a text could lie less than ``overlap`` tokens from its start, and never does while the text has a
character that ends later. A cut falls inside a character only where no token in reach ends with a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.patterns import let
from tallyforge.llm.tokens import BYTE_BPE_50K, Block, Encoder, _ddl, _with, blocks, char_classes, ship_file

#: Pieces whose sizes are summed in one block.
BLOCK = 64
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, NONE = "PNSCWTm"
#: Characters that end sentences and clauses; the wide ones need no blank behind them.
_ENDERS, _WIDE_ENDERS, _CLOSERS = ".!?…;", "。！？", ")]\"'”’»」』"
_CLAUSES, _WIDE_CLAUSES = ",:—–", "、，；："


def _in(chars: np.ndarray, those: str) -> np.ndarray:
    return np.isin(chars, np.array([ord(c) for c in those], np.uint32))


def strengths(b: Block, n_bytes: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of a block: the letter of its end, and the byte at which the first character at or behind its end starts."""
    end = np.cumsum(n_bytes[b.ids])
    n = len(b.chars)
    chars = np.concatenate([np.array([0, 0], np.uint32), b.chars, np.array([0], np.uint32)])
    at = np.searchsorted(b.char_at, end)
    behind = np.append(b.char_at, len(b.data))[at]
    whole = behind == end
    last, one_back, nxt = chars[at + 1], chars[at], chars[np.minimum(at, n) + 2]
    kind = char_classes()
    blank_next, blank_last = kind[nxt] == 3, kind[last] == 3
    word = np.zeros(len(end), bool)
    word[b.word_end_id - 1] = True
    newline = _in(last, "\n\r  ")
    closed = _in(last, _CLOSERS) & _in(one_back, _ENDERS + _WIDE_ENDERS)
    letters = np.full(len(end), ord(NONE), np.uint8)
    rules = (
        (CHARACTER, whole),
        (WORD, word & (blank_next | blank_last)),
        (CLAUSE, (_in(last, _CLAUSES) & blank_next) | _in(last, _WIDE_CLAUSES)),
        (SENTENCE, ((_in(last, _ENDERS) | closed) & blank_next) | _in(last, _WIDE_ENDERS) | (closed & _in(one_back, _WIDE_ENDERS))),
        (LINE, newline & ~blank_next),
        (PARAGRAPH, (newline & ~blank_next & _in(one_back, "\n\r")) | ((last == 0x2029) & ~blank_next)),
    )
    for letter, where in rules:
        letters[where & whole] = ord(letter)
    if overlap:  # the next piece starts so many tokens before: a character must start there too
        back = np.ones(len(end), bool)
        back[overlap:] = whole[:-overlap] if overlap < len(end) else back[overlap:]
        letters[~back] = ord(NONE)
    return letters, behind


def pattern(limit: int, overlap: int) -> str:
    """The regular expression that cuts a text's letters: first to ``limit``, then to what the overlap leaves of it."""

    def one(most: int, least: int) -> str:
        half = max(least, most // 2)
        near = [f".{{{half - 1},{most - 1}}}{s}" for s in (PARAGRAPH, LINE, SENTENCE, CLAUSE)]
        far = [f".{{{least - 1},{most - 1}}}[{PARAGRAPH}{LINE}{SENTENCE}{CLAUSE}{WORD}]", f".{{{least - 1},{most - 1}}}[^{NONE}]"]
        return "|".join([rf".{{1,{most}}}\z", *near, *far, f".{{1,{most}}}"])

    return rf"\A(?:{one(limit, max(1, overlap))})|{one(limit - overlap, 1)}"


def boundaries(df: DataFrame, text: str, keep: list[str], limit: int, overlap: int, path: str) -> DataFrame:
    """``keep``, ``n_tokens``, ``_text`` as bytes, and for texts over the limit ``letters`` and ``ends`` (bytes up to each token)."""
    ship_file(df, path)
    schema = f"{_ddl(df, keep)}n_tokens bigint, letters string, ends array<int>, _text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for batch in batches:
            row = 0
            for part in blocks(batch.column("_text")):
                b = coder.block(part)
                sizes = np.diff(b.first_id)
                letters, at = strengths(b, coder.v.n_bytes, overlap) if len(b.ids) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
                text_letters, ends = [], []
                for k in range(len(part)):
                    if sizes[k] > limit:
                        i, j = b.first_id[k], b.first_id[k + 1]
                        text_letters.append(letters[i:j].tobytes().decode("ascii"))
                        ends.append((at[i:j] - b.first_byte[k]).astype(np.int32))
                    else:
                        text_letters.append(None)
                        ends.append(None)
                columns = [pa.array(sizes, pa.int64()), pa.array(text_letters, pa.string()), pa.array(ends, pa.list_(pa.int32())), part.cast(pa.binary())]
                yield _with(batch, keep, row, len(part), columns, ["n_tokens", "letters", "ends", "_text"])
                row += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _running(sizes: Column) -> Column:
    """Running sums of an array: within blocks, then over the sums of the blocks before, so no long list is copied often."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda a, k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK))

    def on(a: Column) -> Column:
        start, first = F.array(F.lit(0)), F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        bases = F.aggregate(F.transform(first, lambda k: total(block(a, k))), start, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        inside = lambda base, part: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1)))
        return let(bases, lambda at: F.flatten(F.transform(first, lambda k: let(block(a, k), lambda part: inside(F.get(at, k), part)))))

    return let(sizes, lambda a: F.when(F.size(a) > 0, on(a)).otherwise(F.array().cast("array<int>")))


def _cut(limit: int, overlap: int) -> Column:
    """array of (first, last) token numbers of the pieces, from ``letters``."""
    sizes = F.transform(F.regexp_extract_all("letters", F.lit(pattern(limit, overlap)), F.lit(0)), F.length)
    back = lambda ends, i: F.when(i == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.get(ends, i - 1) - overlap))
    return let(_running(sizes), lambda ends: F.transform(ends, lambda e, i: F.struct(back(ends, i).alias("start"), e.cast("int").alias("stop"))))


def ranges(df: DataFrame, text: str, keep: list[str], limit: int = 512, overlap: int = 64, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep``, ``n_tokens``, ``ranges`` (array of start and stop token of the pieces), and what ``boundaries`` gives."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_tokens").cast("int").alias("stop")))
    return boundaries(df, text, keep, limit, overlap, path).withColumn("ranges", F.when(F.col("letters").isNull(), whole).otherwise(_cut(limit, overlap)))


def split(df: DataFrame, text: str, keep: list[str], limit: int = 512, overlap: int = 64, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep``, ``n_tokens``, ``pieces`` (array of start and stop token, text): one row a text."""

    def with_text(body: Column, p: Column) -> Column:
        start = F.when(p["start"] == 0, F.lit(0)).otherwise(F.get("ends", p["start"] - 1))
        stop = F.get("ends", p["stop"] - 1)
        own = F.when(F.col("ends").isNull(), body).otherwise(F.substring(body, start + 1, stop - start))
        return F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.coalesce(own.cast("string"), F.lit("")).alias("text"))

    # the text is taken from its row once: reading it copies it
    cut = let(F.col("_text"), lambda body: F.transform("ranges", lambda p: with_text(body, p)))
    return ranges(df, text, keep, limit, overlap, path).select(*keep, "n_tokens", cut.alias("pieces"))


def pieces(df: DataFrame, text: str, keep: list[str], limit: int = 512, overlap: int = 64, path: str = BYTE_BPE_50K) -> DataFrame:
    """``keep``, ``piece``, ``start_token``, ``stop_token``, ``n_tokens``, ``text``: one row a piece."""
    cut = split(df, text, keep, limit, overlap, path).select(*keep, F.posexplode("pieces").alias("piece", "_p"))
    return cut.select(
        *keep, "piece", F.col("_p.start").alias("start_token"), F.col("_p.stop").alias("stop_token"),
        (F.col("_p.stop") - F.col("_p.start")).alias("n_tokens"), F.col("_p.text").alias("text"),
    )
