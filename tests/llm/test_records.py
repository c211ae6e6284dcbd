import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from tests.twins import assert_twin, connect

from tallyforge.functions import refs
from tallyforge.llm import canonical, mixing, queries, survivors, textform


@pytest.mark.parametrize("name", list(queries.SQL))
def test_twin(spark, name):
    assert_twin(spark, connect(), queries.QUERIES[name], queries.SQL[name])


def test_text_forms(spark):
    raw = ["ＤＢ－０１", "DB​-01 ", "ЩO-01", "DВ-01", "CAFÉ", "ΔP", "𝖳𝖷", " a  b ", "", None, "x" * 100_000 + "é", "ＤＢ－０１", "tab\there"]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string").withColumn("form", F.lit("clash"))
    got = {r.id: r.form for r in textform.consistent(df, "raw", "form", ["id"]).collect()}
    want = {r.id: r.f for r in df.select("id", refs.consistent_form(F.col("raw")).alias("f")).collect()}
    assert got == want and len(got) == len(raw)
    assert got[0] == "DB-01" and got[4] == unicodedata.normalize("NFC", "CAFÉ") and got[7] == "a  b"
    assert textform.consistent(df.where("false"), "raw", "form", ["id"]).count() == 0


def test_survivors_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0.0, 0.5, 0.9]), rng.choice([1, 2, None]), rng.choice(["v", "w", "", None]), "x") for i in range(200)]
    rows += [("single", 900, 0.1, 1, "v", "x"), ("dry", 901, 0.1, 1, "", "x"), ("dry", 902, 0.1, 1, None, "x")]
    df = spark.createDataFrame(rows, "k string, id long, c double, t int, v string, record string")
    got = {r.k: (r.n_rows, r.record, r.v, r.v_from) for r in survivors.surviving(df, ["k"], "id", F.col("c"), "t", {"v": (F.col("v") != "", F.col("v"))}).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], -(r[3] or 0), r[1]))
        if len(own) > 1:
            full = next((r for r in own if r[4]), None)
            want[k] = (len(own), own[0][1], full and full[4], full and full[1])
    assert got == want
    assert survivors.surviving(df.where("false"), ["k"], "id", F.col("c"), "t", {}).count() == 0


def test_confidence_and_way_numbers(spark):
    c = spark.createDataFrame([("0.91",), ("91%",), ("0,4",), (".5",), ("high",), ("",), (None,)], "c string")
    assert [r[0] for r in c.select(queries.confidence_number(F.col("c"))).collect()] == [0.91, 0.91, 0.4, 0.5, 0.0, 0.0, 0.0]
    w = spark.createDataFrame([("01",), ("Way 2",), ("W3",), ("4.0",), ("",), (None,), ("x",)], "w string")
    assert [r[0] for r in w.select(queries.way_number(F.col("w"))).collect()] == [1, 2, 3, 4, None, None, None]


TERMS = [("f", 1, "MCB"), ("f", 2, "MCCB"), ("f", 3, "Emergency lighting"), ("f", 4, "Lighting"), ("f", 5, "Spare"), ("f", 6, "Space"), ("f", 8, "Air handling unit"), ("g", 7, "Boiler")]
CASES = {
    "mcb": 1, "M.C.B.": 1, "16A MCCB (new)": 2, "emergsncy lighting L3": 3, "gym lihgting": 4, "emergency lightng": 3, "SPARE": 5, "space.": 6, "spice": 6, "kiln": 0, "luminaire": 4, "??": 0, "Li\xa0ghting": 0,
    "Lighting " + "x" * 5000: 4, "ＭＣＢ": 1, "emergenyc lgihting": 3, "emrgncy lighting": 3, "em ltg": 4, "ltg L2": 4, "emerg. ltg": 3, "AHU 2": 8, "miniature circuit breaker": 1, "moulded case circuit breaker": 2,
    "lights": 4, "lit": 0, "unit (air handling)": 8, "mbc": 0,
}


@pytest.mark.parametrize("size", [20_000, 3, 1])  # in one block, and in several
def test_mapping(spark, monkeypatch, size):
    terms = spark.createDataFrame(TERMS, "field string, term long, label string")
    rows = [(i, v, None, 1) for i, v in enumerate(CASES)] + [(100, None, "boilr", 1), (101, "  ", "", 1), (102, None, "bioler", 1), (0, "mcb", None, 1)]
    df = spark.createDataFrame(rows, "id long, f string, g string, term_id int")
    aliases = {"f": {"Lighting": ("luminaire",)}}
    want = sorted([(i, "f", t) for i, t in enumerate(CASES.values())] + [(100, "g", 7), (102, "g", 7), (0, "f", 1)])
    monkeypatch.setattr(canonical, "BLOCK_ENTRIES", size)
    got = sorted(map(tuple, canonical.match(df, "id", ["f", "g"], terms, aliases).collect()))
    assert got == want
    assert canonical.match(df.where("false"), "id", ["f"], terms, aliases).count() == 0
    assert {r.term_id for r in canonical.match(df, "id", ["f"], terms.where("false"), {}).collect()} == {0}


@pytest.mark.parametrize("size", [20_000, 1])
def test_known_words_do_not_hide_others(spark, monkeypatch, size):
    """A word that one spelling knows may stand for the word of another, in however many blocks the list goes."""
    monkeypatch.setattr(canonical, "BLOCK_ENTRIES", size)
    terms = spark.createDataFrame([("f", 1, "boilers house"), ("f", 2, "boiler")], "field string, term long, label string")
    df = spark.createDataFrame([(1, "boilers"), (2, "boilers house"), (3, "boiler")], "id long, f string")
    assert {r.id: r.term_id for r in canonical.match(df, "id", ["f"], terms, {}).collect()} == {1: 2, 2: 1, 3: 2}


def test_edits_and_abbreviations_are_parameters(spark):
    terms = spark.createDataFrame([("f", 1, "lift"), ("f", 2, "chiller"), ("f", 3, "transformer")], "field string, term long, label string")
    df = spark.createDataFrame([(1, "lft"), (2, "chlier"), (3, "trnsfomer"), (4, "trf")], "id long, f string")
    ask = lambda **kw: [r.term_id for r in canonical.match(df, "id", ["f"], terms, {}, **kw).orderBy("id").collect()]
    assert ask() == [0, 0, 3, 3]
    assert ask(edits=((4, 1), (7, 2)), abbreviations=False) == [1, 2, 3, 0]
    assert ask(edits=(), abbreviations=False) == [0, 0, 0, 0]


def test_edits_against_brute_force():
    """Words within the edits share a string of deletes, and the distance is the least number of edits."""
    rng = random.Random(1)

    def within_one(w):
        swaps = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        gone = {w[:i] + w[i + 1 :] for i in range(len(w))}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "ab"}
        other = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "ab"}
        return swaps | gone | more | other | {w}

    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) for _ in range(2))
        d = canonical.distance(a, b)
        assert (d <= 1) == (b in within_one(a)) and canonical.distance(b, a) == d
        if d <= 2:
            assert canonical.deletes(a, d) & canonical.deletes(b, d) and canonical.cost(a, b) <= 1.3 * d
            assert d <= 1 or any(b in within_one(x) for x in within_one(a))


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "small", None, "unwanted"]), rng.choice([0, 5, 9, 40]), "x") for i in range(3000)]
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long, budget string").repartition(5)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.1, 5), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets, rows=100).collect()
    caps = {"big": (0.5, 1), "mid": (0.3, 3), "small": (0.1, 5)}
    total = {s: sum(r[2] for r in rows if r[1] == s) for s in caps}
    budget = int(min(total[s] * m / w for s, (w, m) in caps.items()) * 0.9)
    used = sum(r.n_tokens for r in mixed)
    assert budget - 50 <= used <= budget and max(r.tokens_so_far for r in mixed) == used
    for s, (w, m) in caps.items():
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.n_tokens for r in own) / used - w / 0.9) < 0.01
        assert len({(r.id, r.use) for r in own}) == len(own) and max(r.use for r in own) <= m
    assert {r.source for r in mixed} == set(caps) and all(r.n_tokens > 0 for r in mixed)
    ordered = sorted(mixed, key=lambda r: r.tokens_so_far)
    assert all(a.finish <= b.finish for a, b in zip(ordered, ordered[1:]))
    again = mixing.mix(sizes.repartition(3), targets, rows=17).collect()
    assert {(r.id, r.use) for r in again} == {(r.id, r.use) for r in mixed}
    report = {r.source: r for r in mixing.shares(mixing.mix(sizes, targets), sizes, targets).collect()}
    assert set(report) == {"big", "mid", "small", "absent"} and report["absent"].n_tokens == 0
    for s in caps:
        own = [r for r in mixed if r.source == s]
        r = report[s]
        assert (r.n_tokens, r.n_uses, r.most_uses, r.available_tokens) == (sum(x.n_tokens for x in own), len(own), max(x.use for x in own), total[s])
        assert r.actual_share == round(r.n_tokens / used, 6) and r.target_share == caps[s][0]
    for b in (500, 20_000, 10**9):  # in reach of all, with sources that give out, and beyond everything
        order = {r.id: r.o for r in sizes.select("id", F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 1).alias("o")).collect()}
        queue = []
        for s, (w, m) in caps.items():
            at = 0
            for use in range(1, m + 1):
                for r in sorted((r for r in rows if r[1] == s and r[2]), key=lambda r: (order[r[0]], r[0])):
                    at += r[2]
                    queue.append((at / w, s, use, order[r[0]], r[0], r[2]))
        want, at = [], 0
        for q in sorted(queue):
            at += q[5]
            if at <= b:
                want.append((q[4], q[2], at))
        got = sorted(((r.id, r.use, r.tokens_so_far) for r in mixing.mix(sizes, targets, budget=b, rows=100).collect()), key=lambda x: x[2])
        assert got == want
    small = mixing.mix(sizes, targets, budget=500).collect()
    assert sum(r.n_tokens for r in small) <= 500
    assert mixing.mix(sizes.where("false"), targets).count() == 0
    assert mixing.mix(sizes, targets.where("false")).count() == 0
