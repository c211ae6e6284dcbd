"""Parent links of unknown depth to depth, root, path, ancestors and descendants, with circles detected.

Method: leaves are peeled off, twice as many layers a round: a node outlives 2**k layers exactly if it lies in the image of
the parent map taken 2**k times, so composing the map with itself and keeping what is in its image peels 1, 2, 4, ...
layers until only circles remain. The smallest id of each circle comes along and tells the circles apart. Each circle is cut above its node
of the smallest key, which makes every component a tree. Euler tours of all trees are linked (entry and exit event of each node) and ranked in parallel by
pointer jumping, three jumps a round, so the number of rounds is half the logarithm of the longest tour; only events
that have not reached their end jump, the others are put aside and looked up. Entry-exit intervals then give depth and
subtree size, and ancestor pairs come from an equi-join on aligned blocks of 8**k places in preorder: each pair meets in
exactly one block, and no block holds more than ``8**LEVELS`` places, so no key is hot however large a tree is.

Defined results: links with a null end are no links; repeated links count once; a node given several parents keeps the
smallest. A node that is its own parent is a circle of one. Empty input gives empty results. A null scope counts as ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import materialise, observed, release

#: Levels of blocks above single places; each block holds eight of the level below.
LEVELS = 4
#: Parts of a component that meet the nodes of its circle in tasks of their own.
PARTS = 32
#: Jumps along the lists in one round: so many and one times as far.
JUMPS = 3
#: Siblings are linked within this many buckets of a parent, then bucket to bucket.
SIBLING_BUCKETS = 1024


class Forest:
    """nodes: ``id, scope, key, root, lo, hi, depth, on_circle``; events of a subtree lie between ``lo`` and ``hi``."""

    def __init__(self, nodes: DataFrame) -> None:
        self.nodes = nodes

    def ancestors(self) -> DataFrame:
        """``scope, ancestor, node, ancestor_depth``: one row for each pair; a node on a circle is its own ancestor."""
        return self._pairs().drop("above")

    def _pairs(self) -> DataFrame:
        """Pairs with ``above``: whether the ancestor lies above the node in the cut tree, too."""
        place, below = F.expr("shiftright(hi - depth - 1, 1)"), F.expr("shiftright(hi - lo - 1, 1)")  # entries behind, descendants
        up = self.nodes.where("hi - lo > 1 AND NOT on_circle").withColumns({"a": place - below, "b": place - 1})
        level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
        of = lambda k: ("shiftright(a + shiftleft(1L, {0}) - 1, {0})".format(f"3 * ({k})"), f"shiftright(b + 1, 3 * ({k})) - 1")  # noqa: E731  whole blocks in a .. b
        (low, high), (low2, high2) = of("level"), of("level + 1")
        span = lambda x, y: F.expr(f"CASE WHEN {x} <= {y} THEN sequence({x}, {y}) END")
        inner = F.expr(f"level < {LEVELS} AND low2 <= high2")  # the next level takes the middle
        both = F.flatten(F.array_compact(F.array(span("low", "least(high, 8 * low2 - 1)"), span("greatest(low, 8 * high2 + 8)", "high"))))
        own = F.coalesce(span("low", "high"), F.array().cast("array<bigint>"))
        blocks = (
            up.select("root", F.col("key").alias("ancestor"), F.col("depth").alias("ancestor_depth"), "a", "b", level)
            .withColumns({name: F.expr(rule) for name, rule in (("low", low), ("high", high), ("low2", low2), ("high2", high2))})
            .where("low <= high")
            .select("root", "ancestor", "ancestor_depth", "level", F.explode(F.when(inner, both).otherwise(own)).alias("block"))
        )
        down = self.nodes.where("depth > 0").select("root", "scope", F.col("key").alias("node"), place.alias("place"), level)
        places = down.select("root", "scope", "node", "level", F.expr("shiftright(place, 3 * level)").alias("block"))
        in_tree = places.join(blocks, ["root", "level", "block"])
        part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
        ring = self.nodes.where("on_circle").select("root", F.col("key").alias("ancestor"), F.col("depth").alias("ancestor_depth"), "lo", "hi", part)
        below_ring = self.nodes.select("root", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), "scope", F.col("key").alias("node"), F.col("hi").alias("at"))
        in_ring = below_ring.join(ring, ["root", "part"]).withColumn("above", F.expr("at > lo AND at < hi"))
        cols = ["scope", "ancestor", "node", "ancestor_depth", "above"]
        return in_tree.withColumn("above", F.lit(True)).select(*cols).unionByName(in_ring.select(*cols))

    def paths(self) -> DataFrame:
        """``scope, node, root, depth, path, n_below, on_circle``, one row a node; a circle is cut at its smallest node."""
        own = self.nodes.select("scope", F.col("key").alias("node"), F.col("key").alias("ancestor"), F.col("depth").alias("ancestor_depth"))
        # nodes of a circle below or beside a node are its ancestors, but not on its path
        on_path = self._pairs().where("above").drop("above").unionByName(own)
        path = on_path.groupBy("scope", "node").agg(F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("steps"))
        facts = self.nodes.select("scope", F.col("key").alias("node"), "depth", F.expr("cast((hi - lo - 1) / 2 as bigint)").alias("n_below"), "on_circle")
        return path.join(facts, ["scope", "node"]).select(
            "scope",
            "node",
            F.col("steps")[0]["ancestor"].alias("root"),
            "depth",
            F.array_join(F.transform("steps", lambda s: s["ancestor"]), " > ").alias("path"),
            "n_below",
            "on_circle",
        )


def forest(links: DataFrame, lone: DataFrame | None = None) -> Forest:
    """Builds the forest of ``links`` (``scope, child, parent``). lone: ``scope, key`` of nodes that may have no link; those
    without one are roots of depth 0."""
    clean = (
        links.where("child IS NOT NULL AND parent IS NOT NULL")
        .select(F.coalesce("scope", F.lit("")).alias("scope"), "child", "parent")
        .groupBy("scope", "child")
        .agg(F.min("parent").alias("parent"))
    )
    clean = materialise(clean, "links", by_size=True)
    names = clean.select("scope", F.col("child").alias("key")).union(clean.select("scope", "parent"))
    if lone is not None:
        names = names.union(lone.where("key IS NOT NULL").select(F.coalesce("scope", F.lit("")), "key"))
    names = names.distinct()
    names = materialise(names.withColumn("id", F.monotonically_increasing_id()), "names", by_size=True)
    c, p = names.alias("c"), names.alias("p")
    edges = (
        clean.join(c, (clean["scope"] == F.col("c.scope")) & (clean["child"] == F.col("c.key")))
        .join(p, (clean["scope"] == F.col("p.scope")) & (clean["parent"] == F.col("p.key")))
        .select(F.col("c.id").alias("child"), F.col("p.id").alias("parent"))
    )
    edges = materialise(edges, "edges", by_size=True, n=F.count(F.lit(1)))
    release(clean)
    cuts = _circles(edges, names)
    marked = edges.join(cuts.select(F.col("node").alias("child"), "label"), "child", "left")
    tree = materialise(
        marked.select("child", F.when(~F.coalesce(F.col("label") == F.col("child"), F.lit(False)), F.col("parent")).alias("parent")), "tree", by_size=True
    )
    ranked, parts = _rank(_tour(tree, names))
    nodes = (
        ranked.groupBy(F.shiftright("event", 1).alias("id"))
        .agg(
            F.max(F.when(F.col("event") % 2 == 0, F.col("after"))).alias("hi"),
            F.max(F.when(F.col("event") % 2 == 1, F.col("after"))).alias("lo"),
            F.max(F.when(F.col("event") % 2 == 0, F.col("closed"))).alias("closed"),
            F.max("tail").alias("tail"),
        )
        .join(names, "id")
        .join(cuts.select(F.col("node").alias("id"), F.lit(True).alias("on_circle")), "id", "left")
        .select(
            "id", "scope", "key", F.shiftright("tail", 1).alias("root"), "lo", "hi", (F.col("closed") - 1).alias("depth"),
            F.coalesce("on_circle", F.lit(False)).alias("on_circle"),
        )
    )
    done = materialise(nodes, "nodes")  # pairs are made from it, the larger part of the work
    release(*parts, edges, tree, names, cuts)
    return Forest(done)


def _circles(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``node, label``: each node on a circle with the node of it whose key is the smallest."""
    size = observed(edges)["n"]
    now = edges.select("child", "parent", F.col("child").alias("least"))
    while size:
        outlive = now.join(now.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        further = outlive.select(F.col("child").alias("parent"), F.col("parent").alias("parent2"), F.col("least").alias("least2"))
        step = outlive.join(further, "parent").select(
            "child", F.col("parent2").alias("parent"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved")
        )
        step = materialise(step, "peel", by_size=True, n=F.count(F.lit(1)), moved=F.max("moved"))
        got = observed(step)
        release(now)
        now = step
        if got["n"] == size and not got["moved"]:  # the map only turns circles round, and each has seen its smallest node
            break
        size = got["n"]
    keyed = now.join(names.select(F.col("id").alias("child"), "key"), "child")
    first = keyed.groupBy("least").agg(F.min_by("child", "key").alias("label"))
    found = materialise(now.join(first, "least").select(F.col("child").alias("node"), "label"), "circles", by_size=True)
    release(now)
    return found


def _tour(tree: DataFrame, names: DataFrame) -> DataFrame:
    """``event, next``: the Euler tours as linked lists; entry of node i is event 2i, exit 2i+1; the last has no next."""
    kids = tree.where("parent IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("child"), F.lit(SIBLING_BUCKETS)))
    inside = Window.partitionBy("parent", "bucket").orderBy("child")
    linked = kids.withColumn("sibling", F.lead("child").over(inside))
    heads = linked.groupBy("parent", "bucket").agg(F.min("child").alias("head"))
    across = Window.partitionBy("parent").orderBy("bucket")
    heads = heads.withColumn("next_head", F.lead("head").over(across)).withColumn("first", F.row_number().over(across) == 1)
    exits = linked.join(heads.select("parent", "bucket", "next_head"), ["parent", "bucket"]).select(
        (F.col("child") * 2 + 1).alias("event"),
        F.coalesce(F.coalesce("sibling", "next_head") * 2, F.col("parent") * 2 + 1).alias("next"),
    )
    firsts = heads.where("first").select(F.col("parent").alias("id"), "head")
    entries = names.join(firsts, "id", "left").select(
        (F.col("id") * 2).alias("event"), F.coalesce(F.col("head") * 2, F.col("id") * 2 + 1).alias("next")
    )
    ends = names.join(tree.where("parent IS NOT NULL").select(F.col("child").alias("id")), "id", "left_anti").select(
        (F.col("id") * 2 + 1).alias("event"), F.lit(None).cast("long").alias("next")
    )
    return entries.union(exits).union(ends)


def _rank(tour: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``event, tail, after, closed`` of each event: the last event of its list, the events after it, and exits less entries
    among them; and the tables that hold it. A list's events that have reached its end stay where they were written."""
    zero = F.lit(0).cast("long")
    up = F.when(F.col("next") % 2 == 1, 1).otherwise(-1).cast("long")
    has_next = F.col("next").isNotNull()
    start = tour.select(  # what has reached its end keeps the end, as -1 - event, for its next
        "event", F.coalesce("next", -1 - F.col("event")).alias("next"), F.when(has_next, 1).otherwise(zero).cast("long").alias("after"), F.when(has_next, up).otherwise(zero).alias("closed"),
    )
    left = F.count(F.when(F.col("next") >= 0, 1))
    tables = [materialise(start, "rank", by_size=True, left=left)]
    open_, ended = tables[0].where("next >= 0"), [tables[0].where("next < 0")]
    while observed(tables[-1])["left"]:
        known = reduce(DataFrame.unionByName, [open_, *ended])
        known = known.select(*[F.col(c).alias(f"{c}2") for c in ("event", "next", "after", "closed")])
        step = open_
        for jump in range(JUMPS):
            on = F.expr("CASE WHEN next >= 0 THEN next ELSE -1 - event END = event2")  # ended events go through, by keys of their own
            step = step.join(known, on, "left" if jump else "inner").select(
                "event", F.coalesce("next2", "next").alias("next"), (F.col("after") + F.coalesce("after2", zero)).alias("after"), (F.col("closed") + F.coalesce("closed2", zero)).alias("closed")
            )
        tables.append(materialise(step, "rank", by_size=True, left=left))
        open_ = tables[-1].where("next >= 0")
        ended.append(tables[-1].where("next < 0"))
    return reduce(DataFrame.unionByName, ended).withColumn("tail", -1 - F.col("next")), tables
