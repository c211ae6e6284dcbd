import random

import pytest

from tallyforge.operators import hierarchy

SCHEMA = "scope string, child string, parent string, id int, root string"


def brute(links):
    parent = {}
    for s, c, p, *_ in links:
        if c is not None and p is not None:
            k = (s or "", c)
            parent[k] = min(parent.get(k, p), p)
    pairs = set()
    for s, c in parent:
        seen, at = set(), parent[s, c]
        while at is not None and at not in seen:
            seen.add(at)
            pairs.add((s, at, c))
            at = parent.get((s, at))
    return pairs


def cases():
    rng = random.Random(5)
    trees = [("s", f"n{i}", f"n{rng.randint(0, i - 1)}", 0, "x") for i in range(1, 60)]
    rings = [("r", "a", "b", 0, "x"), ("r", "b", "c", 0, "x"), ("r", "c", "a", 0, "x"), ("r", "d", "a", 0, "x"), ("r", "e", "d", 0, "x"), ("r", "self", "self", 0, "x"), ("r", "f", "self", 0, "x")]
    chain = [("c", f"{i:03}", f"{i + 1:03}", 0, "x") for i in range(40)]
    odd = [(None, "a", "b", 0, "x"), ("", "b", "c", 0, "x"), ("s", None, "n1", 0, "x"), ("s", "n1", None, 0, "x")]
    star = [("h", f"k{i}", "hub", 0, "x") for i in range(300)]
    return {"mixed": trees + rings + odd + trees[:9], "chain": chain + rings, "star": star, "none": [], "ring only": rings[:3]}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("jumps", [1, 3])
def test_ancestors(spark, monkeypatch, name, jumps):
    monkeypatch.setattr(hierarchy, "JUMPS", jumps)
    links = cases()[name]
    got = [tuple(r) for r in hierarchy.forest(spark.createDataFrame(links, SCHEMA)).ancestors().select("scope", "ancestor", "node").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(links)


def test_paths(spark):
    links = [("s", "b", "a", 0, ""), ("s", "c", "b", 0, ""), ("s", "d", "b", 0, ""), ("r", "x", "y", 0, ""), ("r", "y", "x", 0, ""), ("r", "z", "x", 0, "")]
    got = {(r.scope, r.node): (r.root, r.depth, r.path, r.n_below, r.on_circle) for r in hierarchy.forest(spark.createDataFrame(links, SCHEMA)).paths().collect()}
    assert got["s", "a"] == ("a", 0, "a", 3, False)
    assert got["s", "d"] == ("a", 2, "a > b > d", 0, False)
    assert got["r", "x"] == ("x", 0, "x", 2, True) and got["r", "y"] == ("x", 1, "x > y", 0, True) and got["r", "z"] == ("x", 1, "x > z", 0, False)
    assert len(got) == 7


def test_path_beside_a_circle(spark):
    """b hangs from the circle's first node a; the circle's other node c stands beside it."""
    links = [("s", "a", "c", 0, ""), ("s", "c", "a", 0, ""), ("s", "b", "a", 0, ""), ("s", "d", "b", 0, "")]
    f = hierarchy.forest(spark.createDataFrame(links, SCHEMA))
    assert {r.node: r.path for r in f.paths().collect()} == {"a": "a", "b": "a > b", "c": "a > c", "d": "a > b > d"}
    assert {(r.ancestor, r.node) for r in f.ancestors().collect()} == {("a", "a"), ("c", "a"), ("a", "c"), ("c", "c"), ("a", "b"), ("c", "b"), ("b", "d"), ("a", "d"), ("c", "d")}


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_large_interval_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(hierarchy, "LEVELS", levels)
    links = cases()["star"] + cases()["chain"]
    got = {tuple(r) for r in hierarchy.forest(spark.createDataFrame(links, SCHEMA)).ancestors().select("scope", "ancestor", "node").collect()}
    assert got == brute(links)
