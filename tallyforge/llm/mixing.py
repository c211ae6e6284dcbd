"""Mixing of sources to target weights by weighted fair queueing.

Each record gets a place in a shuffled order of its source (by a seeded hash) and a virtual finish time: the tokens of
its source up to and with it, divided by the source's target weight. Second and later uses of a record follow after all
first uses. The mix is what finishes first, up to the total budget, in order of finish time.

The finish time by which the budget is used up is known from the sources' totals before any record is queued, so only
uses that may enter the mix are made, and the order is cut into ranges of finish time, which hold equal parts of the
budget (each source's tokens are spread evenly over finish time). Running sums are two-level: within ranges of the
shuffled order (or of finish time), then over the small table of their totals; the number of ranges follows from the
numbers of records. No source, however large its part of the rows, is ever sorted in one task.

Defined results: records whose source is null or has no target, and records without tokens, are not used. Without a
budget the total is the largest at which every source that has tokens reaches its share. Ties of finish time go by
source, use and id. Rows that repeat an id are each used. Empty input gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records in a range of the shuffled order or of finish time, about; and the least number of ranges.
ROWS, LEAST_RANGES = 50_000, 8
#: Up to so many sources, tables of a row a source and range are broadcast.
MOST_SOURCES = 100


def _small(targets: DataFrame):
    """A broadcast hint for tables of at most one row a source and bucket, where the sources are few; else none."""
    return F.broadcast if targets.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else lambda df: df


def _before(df: DataFrame, group: list[str], bucket: str, size: str) -> DataFrame:
    """group, bucket, base: the sum of ``size`` in the buckets before."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(size).alias("_sum"))
    return sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("base"))


def capacities(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """``source, share, max_repeats, total, n_records, budget, until``: tokens of each wanted source; the budget (by default what
    all can share exactly); the finish time behind which nothing can enter it."""
    want = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats")
    )
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n_records"), F.max("n_tokens").alias("largest"))
    zero = F.lit(0).cast("bigint")
    joined = want.join(have, "source", "left").select(
        "source", "share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_records", "largest")]
    )
    every = Window.partitionBy()  # over one row a source
    joined = joined.withColumn("reach", F.col("total") * F.col("max_repeats") / F.col("share"))
    able = F.sum(F.when(F.col("total") > 0, F.col("share"))).over(every)
    exact = F.floor(F.min(F.when(F.col("total") > 0, F.col("reach"))).over(every) * able)
    joined = joined.withColumn("budget", exact if budget is None else F.lit(budget).cast("bigint"))
    # at finish time t all sources together have given the sum of least(reach, t) * share, less a record each at most
    line = Window.orderBy("reach", "source")
    spent = F.coalesce(F.sum(F.col("reach") * F.col("share")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    going = F.sum("share").over(line.rowsBetween(0, Window.unboundedFollowing))
    goal = F.col("budget") + F.sum("largest").over(every) + 1
    before = F.coalesce(F.lag("reach").over(line), F.lit(0.0))
    joined = joined.withColumn("_until", F.greatest(before, (goal - spent) / going))  # the time, if no source but those before gives out
    until = F.coalesce(F.min(F.when(F.col("_until") <= F.col("reach"), F.col("_until"))).over(every), F.max("reach").over(every))
    return joined.select("source", "share", "max_repeats", "total", "n_records", "budget", until.alias("until"))


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, rows: int = ROWS) -> DataFrame:
    """``id, source, use, n_tokens, finish, tokens_so_far`` of the mix. sizes: ``id, source, n_tokens``; targets:
    ``source, target_share, max_repeats`` (one row a source: the number of sources bounds what is broadcast). rows: the
    records of a range, about."""
    sizes, hint = sizes.select("id", "source", "n_tokens"), _small(targets)
    ranges = lambda n: F.greatest(F.lit(LEAST_RANGES), F.ceil(n / rows)).cast("bigint")
    expected = F.sum(F.col("n_records") * F.least(F.col("max_repeats"), F.col("until") * F.col("share") / F.greatest(F.col("total"), F.lit(1)))).over(Window.partitionBy())
    caps = capacities(sizes, targets, budget).withColumns({"_buckets": ranges(F.col("n_records")), "_slots": ranges(expected)})
    own = sizes.where("n_tokens > 0").join(hint(caps), "source").withColumn("_order", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1))
    own = own.withColumn("_bucket", F.floor(F.shiftright("_order", 31) * F.col("_buckets") / F.lit(float(1 << 32))))  # a range of the order
    base = _before(own, ["source"], "_bucket", "n_tokens")
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "id").rowsBetween(Window.unboundedPreceding, 0)
    queued = own.withColumn("_inside", F.sum("n_tokens").over(inside)).join(hint(base), ["source", "_bucket"])
    first = F.col("base") + F.col("_inside")
    last = F.least(F.col("max_repeats"), F.floor((F.col("until") * F.col("share") - first) / F.col("total")) + 2).cast("int")  # one more for rounding
    uses = queued.where(last >= 1).withColumn("use", F.explode(F.sequence(F.lit(1), last)))
    finish = ((F.col("use") - 1) * F.col("total") + first) / F.col("share")
    timed = uses.select("id", "source", "use", "n_tokens", finish.alias("finish"), "budget", "until", "_slots", "_order").where("finish <= until")
    timed = timed.withColumn("_slot", F.floor(F.col("finish") * F.col("_slots") / F.col("until")))
    slots = _before(timed.withColumn("_all", F.lit(0)), ["_all"], "_slot", "n_tokens").drop("_all")
    line = Window.partitionBy("_slot").orderBy("finish", "source", "use", "_order", "id").rowsBetween(Window.unboundedPreceding, 0)
    near = timed.join(hint(slots), "_slot").where("base < budget")
    out = near.withColumn("tokens_so_far", F.col("base") + F.sum("n_tokens").over(line)).where("tokens_so_far <= budget")
    return out.select("id", "source", "use", "n_tokens", F.round("finish", 3).alias("finish"), "tokens_so_far")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_uses, most_uses, available_tokens`` of every wanted source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.max("use").alias("most_uses"))
    zero = F.lit(0).cast("bigint")
    joined = capacities(sizes, targets).join(got, "source", "left")
    tokens = F.coalesce("n_tokens", zero)
    return joined.select(
        "source",
        F.col("share").alias("target_share"),
        F.round(F.coalesce(tokens / F.nullif(F.sum(tokens).over(Window.partitionBy()), zero), F.lit(0.0)), 6).alias("actual_share"),
        tokens.alias("n_tokens"),
        F.coalesce("n_uses", zero).alias("n_uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.col("total").alias("available_tokens"),
    )
