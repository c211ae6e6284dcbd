import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import splitting, tokens

ODD = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "٣", "!", "。", "　", "​", "𝖠", "é", "<|endoftext|>", "\x1c", "\x85", "aaaa", "日本", "x"]


@pytest.fixture(scope="module")
def public():
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.BYTE_BPE_50K)
    tk.encode_special_tokens = True
    return lambda texts: [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    return [None, "", "a" * 3000, " " * 400, "It's 'tis can't've", "one", "one"] + made


def test_blocks_against_library(public, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(tokens, "TABLE_WORDS", 500)
    coder, all_texts = tokens.Encoder(), texts()
    got = []
    for part in tokens.blocks(pa.array(all_texts)):
        b = coder.block(part)
        got += [b.ids[i:j].tolist() for i, j in zip(b.first_id, b.first_id[1:])]
    assert got == public(all_texts)


def test_encode_and_count(spark, public):
    rows = list(enumerate(texts()))[:500]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode(df, "text", ["doc_id"]).collect()}
    want = dict(zip([i for i, _ in rows], public([t for _, t in rows])))
    assert got == want
    assert {r.doc_id: r.ids for r in tokens.encode(df, "text", ["doc_id"], shared=False).collect()} == want
    assert {r.doc_id: r.n_tokens for r in tokens.count(df, "text", ["doc_id"]).collect()} == {i: len(w) for i, w in want.items()}
    assert tokens.encode(df.where("false"), "text", ["doc_id"]).count() == 0


def test_word_table(spark, public, monkeypatch):
    """Words of several tasks are in the table, up to its bound the most shared; results do not depend on it."""
    rows = [(1, "one two two"), (2, "one three"), (3, "one two"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "doc_id")
    table = {bytes(r.word): r.ids for r in tokens.word_table(df, "text").collect()}
    assert set(table) == {b"one", b" two"} and table[b" two"] == public([" two"])[0]
    monkeypatch.setattr(tokens, "SHARED_WORDS", 1)
    assert [bytes(r.word) for r in tokens.word_table(df, "text").collect()] == [b"one"]
    assert {r.doc_id: r.ids for r in tokens.encode(df, "text", ["doc_id"]).collect()} == dict(zip([i for i, _ in rows], public([t for _, t in rows])))
    assert tokens.word_table(df.where("false"), "text").count() == 0


SPEECH = "Mr Speaker, I beg to move. The road has been closed for ten weeks; who will open it?\n\nLet me turn to schools, which wait.\nNo one doubts it. "


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (32, 0), (100, 20)])
def test_pieces(spark, public, limit, overlap):
    rng = random.Random(4)
    sample = [SPEECH * 9, "日本語の演説です。次の文です。" * 40, "a" * 900, "".join(rng.choice(ODD) for _ in range(900)), "Ω" * 300, "short", "", None, "word " * 500, "😀" * 200]
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string")
    found = {}
    for r in splitting.pieces(df, "text", ["doc_id"], limit, overlap).orderBy("doc_id", "piece").collect():
        found.setdefault(r.doc_id, []).append(r)
    ids = public(sample)
    for k, text in enumerate(sample):
        own, n = found[k], len(ids[k])
        assert own[0].start_token == 0 and own[-1].stop_token == n
        assert all(p.n_tokens <= limit for p in own)
        assert (len(own) == 1) == (n <= limit)
        for a, b in zip(own, own[1:]):
            assert a.stop_token - b.start_token == overlap
        assert [p.piece for p in own] == list(range(len(own)))
        if len(own) == 1:
            assert own[0].text == (text or "")
        else:  # pieces follow each other in the text, and cover it
            at = 0
            for p in own:
                start = text.index(p.text, max(0, at - 4 * limit * 4)) if k == 0 else None
                if start is not None:
                    assert start <= at
                    at = start + len(p.text)
            assert own[0].text == text[: len(own[0].text)] and text.endswith(own[-1].text)
    assert found[0][0].text.endswith((".", "?", "\n", "; ", ";", ",", " ")) or found[0][0].text[-1].isalnum()


def test_natural_boundaries_first(spark):
    df = spark.createDataFrame([(1, SPEECH * 20)], "doc_id long, text string")
    ends = [p.text.rstrip()[-1] for p in splitting.pieces(df, "text", ["doc_id"], 128, 16).collect()]
    assert set(ends) <= set(".?")


def test_found_agrees_with_counts(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id for r, w in zip(rows, public([r.text for r in rows])) if len(w) > 512}
    from tallyforge.llm.queries import p8_found

    assert {r.doc_id for r in p8_found(spark, "/root/testdata/sf0.001").collect()} == want


def test_running_sums(spark):
    rng = random.Random(9)
    rows = [(n, [rng.randint(1, 9) for _ in range(n)]) for n in (0, 1, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame(rows, "n int, a array<int>")
    got = {r.n: r.s for r in df.select("n", splitting._running(F.col("a")).alias("s")).collect()}
    assert got == {n: [sum(a[: i + 1]) for i in range(n)] for n, a in rows}


def strength(text, at):
    """How strong a boundary a text has at a place: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word, 0 inside a word."""
    blank = lambda c: c != "" and ord(c) in tokens._WHITE
    last, before, nxt = text[at - 1], text[at - 2 : at - 1], text[at : at + 1]
    if last in "\n\r\u2028\u2029" and nxt and not blank(nxt):
        return 5 if before in ("\n", "\r") or last == "\u2029" else 4
    closed = last in ")]\"'”’»」』" and before != "" and before in ".!?…;。！？"
    if ((last in ".!?…;" or closed) and blank(nxt)) or last in "。！？" or (closed and before in "。！？"):
        return 3
    if (last in ",:—–" and blank(nxt)) or last in "、，；：":
        return 2
    return 1 if blank(nxt) or blank(last) else 0


def test_pieces_of_the_corpus(spark, public):
    """Every cut is the strongest in the second half of its reach, latest first; every pair shares 64 tokens; the pieces are the text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 1200")
    texts_ = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {}
    for r in splitting.pieces(docs, "text", ["doc_id"]).orderBy("doc_id", "piece").collect():
        found.setdefault(r.doc_id, []).append(r)
    n_bytes = tokens.vocabulary(tokens.BYTE_BPE_50K).n_bytes
    cuts = 0
    for doc, ids in zip(texts_, public(list(texts_.values()))):
        text, own = texts_[doc], found[doc]
        place = {0: 0}  # of each byte that starts a character, the character
        for i, c in enumerate(text):
            place[max(place) + len(c.encode())] = i + 1
        ends, at = [0], 0
        for i in ids:
            at += int(n_bytes[i])
            ends.append(place.get(at))
        assert own[0].start_token == 0 and own[-1].stop_token == len(ids)
        for a, b in zip(own, own[1:]):
            assert a.stop_token - b.start_token == 64 and a.n_tokens <= 512
            whole = [k for k in range(a.start_token + 1, a.start_token + 513) if k < len(ends) and ends[k] is not None and ends[k - 64] is not None]
            first = a.start_token + (64 if a is own[0] else 128)  # no piece lies wholly in the overlap
            rank = lambda k: strength(text, ends[k])
            reach = [k for k in whole if k >= first]
            half = a.start_token + (256 if a is own[0] else 64 + 224)
            near = [k for k in reach if k >= half and rank(k) >= 2]
            best = max(rank(k) for k in near) if near else None
            if best is not None:
                assert rank(a.stop_token) == best, (doc, a.stop_token)
            cuts += 1
        for p in own:
            if ends[p.start_token] is not None and ends[p.stop_token] is not None:
                assert p.text == text[ends[p.start_token] : ends[p.stop_token]]
    assert cuts > 10


def test_long_texts_are_cut_in_proportion(spark):
    """Eight times the text takes about eight times as long, not sixty-four times."""
    import time

    took = []
    for times in (1, 8):
        df = spark.createDataFrame([(1, SPEECH * (1500 * times))], "doc_id long, text string")
        began = time.perf_counter()
        rows = splitting.pieces(df, "text", ["doc_id"]).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
        took.append(time.perf_counter() - began)
        assert rows.n > 80 * times
    assert took[1] < 24 * max(took[0], 0.5)
