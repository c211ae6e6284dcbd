"""Encoding of a corpus with a public byte-level BPE tokenizer, by corpus-level merge replay.

``encode`` goes over the corpus twice. First each task gives its distinct words, which are counted over the corpus; those
that several tasks have (the ``SHARED_WORDS`` most shared at most) are encoded once, in ranges of their hash: an inverted
index from token pair to word positions is built for all words of a range, every merge that occurs is applied in rank
order to all its positions, and only the pairs beside a merged position are entered anew. This word table goes to the
workers, who split the texts into words with array operations and look them up; words that a task alone has are replayed
there in the same way, so every word is encoded, and about once. Merges never cross words, so results do not depend on how
the corpus is cut into tasks; no text is shuffled, and every text is encoded whole.

``count`` and the splitting of texts read the corpus once and replay the words of each task there (``shared=False``).

Defined results: a null text and an empty text have no ids (an empty list).
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; every function takes another path.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts are handled in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: A task's own words are forgotten when there are this many, to bound a worker's memory.
TABLE_WORDS = 400_000
#: Words that the corpus' word table holds at most (some 20 bytes each); the others are encoded where they are met.
SHARED_WORDS = 500_000

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: The characters with the property White_Space.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that the pattern splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = _LETTER
        elif kind == "N":
            table[cp] = _NUMBER
    table[list(_WHITE)] = _SPACE
    return table


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others in order for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """ids of single bytes, and of each pair of ids its (rank, merged id); byte lengths of all ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.pairs: dict[tuple[int, int], int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = rank
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; on workers, of the copy that ``ship_file`` sent."""
    sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory else path
    return Vocabulary(sent if os.path.exists(sent) else path)


def ship_file(df: DataFrame, path: str) -> None:
    """Sends a file of the driver to the workers, also those that start later, once a session."""
    sc = df.sparkSession.sparkContext
    sent = sc.__dict__.setdefault("_tallyforge_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each word."""
    sym: list[int] = []
    ends: list[int] = []
    of_byte = v.of_byte
    for w in words:
        sym.extend([of_byte[b] for b in w])
        sym.append(-1)  # no pair reaches over it
        ends.append(len(sym) - 1)
    n = len(sym)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of, merges = v.pairs.get, v.merges
    index: dict[int, list[int]] = {}
    for i, pair in enumerate(zip(sym, sym[1:])):
        r = rank_of(pair)
        if r is not None:
            index.setdefault(r, []).append(i)
    due = list(index)
    heapq.heapify(due)
    while due:
        r = heapq.heappop(due)
        places = index.pop(r)
        a, b, ab = merges[r]
        if a == b:
            places.sort()  # overlapping pairs merge from the left
        for i in places:
            if sym[i] != a:
                continue
            j = after[i]
            if sym[j] != b:
                continue
            sym[i], sym[j] = ab, -2
            k = after[j]
            after[i], before[k] = k, i
            h = before[i]
            for at, pair in ((h, (sym[h], ab)), (i, (ab, sym[k]))) if h >= 0 else ((i, (ab, sym[k])),):
                q = rank_of(pair)
                if q is not None:
                    known = index.get(q)
                    if known is None:
                        index[q] = [at]
                        heapq.heappush(due, q)
                    else:
                        known.append(at)
    out, start = [], 0
    for end in ends:
        out.append([s for s in sym[start:end] if s >= 0])
        start = end + 1
    return out


@dataclass
class Block:
    """Texts with their ids. first_byte, first_id: of each text and behind the last; char_at: the byte at which each
    character starts; word_end_id: number of ids up to and with each word."""

    data: np.ndarray
    chars: np.ndarray
    char_at: np.ndarray
    first_byte: np.ndarray
    ids: np.ndarray
    first_id: np.ndarray
    word_end_id: np.ndarray


class Encoder:
    """Encodes blocks of texts; keeps the word table. known: words with their ids, encoded before."""

    def __init__(self, path: str = BYTE_BPE_50K, known: tuple[list[bytes], np.ndarray, np.ndarray] | None = None) -> None:
        self.v = vocabulary(path)
        self.known = known or ([], np.zeros(0, np.int32), np.zeros(0, np.int64))
        self._reset()

    def _reset(self) -> None:
        words, self.flat, self.length = self.known
        self.table: dict[bytes, int] = dict(zip(words, range(len(words))))
        self.start = np.cumsum(self.length) - self.length

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers in the table of words, new ones entered."""
        if len(self.table) > TABLE_WORDS + len(self.known[0]):
            self._reset()
        table = self.table
        new = [w for w in words if w not in table]
        if new:
            coded = replay(new, self.v)
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            for w in new:
                table[w] = len(table)
            self.flat = np.concatenate([self.flat, np.array([i for c in coded for i in c], np.int32)])
            self.start, self.length = np.concatenate([self.start, starts]), np.concatenate([self.length, lengths])
        return np.fromiter((table[w] for w in words), np.int64, len(words))

    def block(self, texts: pa.StringArray) -> Block:
        cut = Words(texts)
        if cut.words is None:
            none = np.zeros(0, np.int64)
            return Block(cut.data, cut.chars, cut.char_at, cut.first_byte, none.astype(np.int32), np.zeros(len(texts) + 1, np.int64), none)
        number = self._numbers(cut.words.dictionary.to_pylist())[cut.words.indices.to_numpy()]
        length = self.length[number]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[number] - ends + length, length) + np.arange(ends[-1])]
        first_word = np.searchsorted(cut.starts, cut.first_char)
        return Block(cut.data, cut.chars, cut.char_at, cut.first_byte, ids, np.concatenate([[0], ends])[first_word], ends)


class Words:
    """Texts cut into words: ``words``, dictionary-encoded (None if there are none), and where texts and words start."""

    def __init__(self, texts: pa.StringArray) -> None:
        texts = texts.fill_null("") if texts.null_count else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.first_byte = offsets - offsets[0]
        self.chars = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.char_at = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.first_char = np.searchsorted(self.char_at, self.first_byte)
        self.starts = word_starts(self.chars, self.first_char)
        self.words = None
        if len(self.starts):
            at = np.append(self.char_at[self.starts], len(self.data)).astype(np.int32)
            self.words = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(at), pa.py_buffer(self.data)).cast(pa.binary()).dictionary_encode()


def word_starts(chars: np.ndarray, first_char: np.ndarray) -> np.ndarray:
    """The characters at which words start: runs of letters, of numbers or of others, each with one space before it;
    endings after an apostrophe; the rest of white space, whose last character before a run stands alone."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[chars]
    edge = np.zeros(n + 1, bool)  # a text starts here, or all end
    edge[first_char] = True
    inner = ~edge[1:n]  # by character from the second on: it continues a text
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | ~inner
    blank = kind == _SPACE
    ends_blank = np.zeros(n, bool)  # last of white space with a run after it
    ends_blank[:-1] = blank[:-1] & ~blank[1:] & inner
    start |= ends_blank
    joins = ends_blank & (chars == 0x20)
    start[1:] &= ~joins[:-1]  # its run starts with the space
    quote = np.flatnonzero((chars == 0x27) & start)
    quote = quote[~np.append(False, joins[:-1])[quote]]
    for ending in _ENDINGS:
        size = len(ending)
        q = quote[quote + size < n]
        if not len(q):
            continue
        fits = np.ones(len(q), bool)
        for k, letter in enumerate(ending, 1):
            fits &= (chars[q + k] == ord(letter)) & ~edge[q + k]
        q = q[fits]
        start[q + 1] = False
        nxt = q + size + 1
        nxt = nxt[nxt < n]
        start[nxt] = True
    return np.flatnonzero(start)


def blocks(texts: pa.Array) -> Iterator[pa.StringArray]:
    """Slices of about BLOCK_BYTES."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def _with(batch: pa.RecordBatch, keep: list[str], at: int, n: int, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(k).slice(at, n) for k in keep] + columns, [*keep, *names])


def _ddl(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def word_table(df: DataFrame, text: str, path: str = BYTE_BPE_50K, least: int = 2, ranges: int = 16) -> DataFrame:
    """``word binary, ids array<int>``: the words that ``least`` tasks have or more, encoded once for the corpus."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in blocks(batch.column("_text")):
                words = Words(part).words
                if words is not None:
                    new = [w for w in words.dictionary.to_pylist() if w not in seen]
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary())], ["word"])
                    if len(seen) > TABLE_WORDS:
                        seen.clear()
                    seen.update(new)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        words = [w for batch in batches for w in batch.column("word").to_pylist()]  # a range of the bounded table
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(replay(words, v), pa.list_(pa.int32()))], ["word", "ids"])

    ship_file(df, path)
    met = df.select(F.col(text).alias("_text")).mapInArrow(distinct, "word binary")
    counted = met.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shared = counted.orderBy(F.col("n").desc(), "word").limit(SHARED_WORDS).select("word")
    return shared.repartition(ranges, "word").mapInArrow(coded, "word binary, ids array<int>")


def _known(df: DataFrame, text: str, path: str) -> Broadcast:
    """The word table, at most ``SHARED_WORDS`` rows, for the workers."""
    rows = word_table(df, text, path).toArrow()
    ids = rows.column("ids").combine_chunks()
    lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    flat = ids.flatten().to_numpy().astype(np.int32) if len(rows) else np.zeros(0, np.int32)
    return df.sparkSession.sparkContext.broadcast((rows.column("word").to_pylist(), flat, lengths))


def encode(df: DataFrame, text: str, keep: list[str], path: str = BYTE_BPE_50K, shared: bool = True) -> DataFrame:
    """The columns ``keep`` and ``ids array<int>`` of each row. shared: with the corpus' word table, made when the query is
    built; else each task encodes its own words."""
    ship_file(df, path)
    known = _known(df, text, path) if shared else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, known.value if known else None)
        for batch in batches:
            at = 0
            for part in blocks(batch.column("_text")):
                b = coder.block(part)
                ids = pa.ListArray.from_arrays(pa.array(b.first_id, pa.int32()), pa.array(b.ids, pa.int32()))
                yield _with(batch, keep, at, len(part), [ids], ["ids"])
                at += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{_ddl(df, keep)}ids array<int>")


def count(df: DataFrame, text: str, keep: list[str], path: str = BYTE_BPE_50K) -> DataFrame:
    """The columns ``keep`` and ``n_tokens bigint`` of each row."""
    ship_file(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for batch in batches:
            at = 0
            for part in blocks(batch.column("_text")):
                sizes = pa.array(np.diff(coder.block(part).first_id), pa.int64())
                yield _with(batch, keep, at, len(part), [sizes], ["n_tokens"])
                at += len(part)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{_ddl(df, keep)}n_tokens bigint")
