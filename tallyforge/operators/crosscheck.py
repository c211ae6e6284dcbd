"""Comparison of two readings of the same things, and filling one from the other. Nothing is resolved silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.dedup import keep_best

#: Tasks over which rows with vague keys are spread.
PARTS = 32
#: Ranges within which places are counted.
RANGES = 1000


def cross_check(primary: DataFrame, second: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column] | None], ordinal: str) -> DataFrame:
    """``keys, kind, field, first_value, second_value``: rows one side lacks, and fields known on both that differ.

    Of rows with the same key the last one counts. fields: name to None, or a pair of conditions under which the value of
    either side (columns ``p`` and ``s``) is compared at all. Null keys compare as equal.
    """
    last = lambda df: keep_best(df, keys, F.col(ordinal), ordinal)
    p, s = last(primary).withColumn("_in", F.lit(True)).alias("p"), last(second).withColumn("_in", F.lit(True)).alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    both = p.join(s, on, "full_outer")
    none = F.lit(None).cast("string")
    cells = [
        F.when(F.col("p._in").isNull(), F.struct(F.lit("missing_in_primary").alias("kind"), none.alias("field"), none.alias("first_value"), none.alias("second_value"))),
        F.when(F.col("s._in").isNull(), F.struct(F.lit("missing_in_second").alias("kind"), none.alias("field"), none.alias("first_value"), none.alias("second_value"))),
    ]
    for name, allowed in fields.items():
        a, b = F.col(f"p.{name}"), F.col(f"s.{name}")
        differs = a.isNotNull() & b.isNotNull() & (a != b)
        if allowed is not None:
            differs = differs & allowed[0] & allowed[1]
        cells.append(F.when(differs, F.struct(F.lit("field_mismatch").alias("kind"), F.lit(name).alias("field"), a.cast("string").alias("first_value"), b.cast("string").alias("second_value"))))
    named = [F.coalesce(F.col(f"p.{k}"), F.col(f"s.{k}")).alias(k) for k in keys]
    return both.select(*named, F.explode(F.array_compact(F.array(*cells))).alias("m")).select(*keys, "m.*")


def fill_gaps(base: DataFrame, extra: DataFrame, equal: list[str], also: Column, vague: str, ordinal: str, parts: int = PARTS) -> DataFrame:
    """The rows of ``extra`` that no row of ``base`` covers: equal keys (null equals null) and the condition ``also`` over
    ``b`` (base) and ``e`` (extra). Keys of base are made distinct first where the condition allows it.

    vague: a condition on the keys of rows that say little (no board, no way), of which there may be very many: these are
    spread by ``ordinal`` over ``parts``, in each of which base's few such keys are."""
    here = F.when(F.expr(vague), F.pmod(F.xxhash64(ordinal), F.lit(parts))).otherwise(0).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.when(F.expr(vague), parts - 1).otherwise(0).cast("int")))
    b, e = base.withColumn("_part", everywhere).alias("b"), extra.withColumn("_part", here).alias("e")
    on = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}")) for k in equal], F.col("b._part") == F.col("e._part"))
    return e.join(b, on & also, "left_anti").drop("_part")


def upsert(base: DataFrame, extra: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """All keys of both; ``value`` from extra where its score is higher or base has none, else from base."""
    b, e = base.alias("b"), extra.alias("e")
    on = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    take = F.col(f"e.{value}").isNotNull() & (F.col(f"e.{score}") > F.coalesce(F.col(f"b.{score}"), F.lit(0.0)))
    return b.join(e, on, "full_outer").select(
        *[F.coalesce(F.col(f"b.{k}"), F.col(f"e.{k}")).alias(k) for k in keys],
        F.when(take, F.col(f"e.{value}")).otherwise(F.col(f"b.{value}")).alias(value),
        F.when(take, F.col(f"e.{score}")).otherwise(F.col(f"b.{score}")).alias(score),
        F.when(F.col(f"b.{keys[0]}").isNull(), "added").when(take, "replaced").otherwise("kept").alias("action"),
    )


def changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys, change, field, old_value, new_value``: added and removed keys, and fields that changed (null counts)."""
    o, n = old.withColumn("_in", F.lit(True)).alias("o"), new.withColumn("_in", F.lit(True)).alias("n")
    on = reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    entry = lambda change, field, a, b: F.struct(F.lit(change).alias("change"), F.lit(field).cast("string").alias("field"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))
    none = F.lit(None)
    cells = [F.when(F.col("o._in").isNull(), entry("added", None, none, none)), F.when(F.col("n._in").isNull(), entry("removed", None, none, none))]
    both = F.col("o._in").isNotNull() & F.col("n._in").isNotNull()
    cells += [F.when(both & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), entry("changed", f, F.col(f"o.{f}"), F.col(f"n.{f}"))) for f in fields]
    named = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    return o.join(n, on, "full_outer").select(*named, F.explode(F.array_compact(F.array(*cells))).alias("m")).select(*keys, "m.*")


def merge_boards(base: DataFrame, extra: DataFrame, keys: list[str], ordinal: str, worth: float = 0.75) -> DataFrame:
    """``keys, n_pages, parent, conf, added``: boards of both, their pages united. A board's own parent is its surest, the first
    in a tie; the first parent that ``extra`` names replaces it where its confidence is below ``worth``.

    Rows: ``keys, ordinal, parent`` (null for none), ``conf, file_id, page``. Distinct pages are counted, never listed.
    """
    every = base.withColumn("_base", F.lit(True)).unionByName(extra.withColumn("_base", F.lit(False)))
    named = F.col("parent").isNotNull()
    own = F.max_by(F.struct("parent", "conf"), F.when(F.col("_base") & named, F.struct("conf", -F.col(ordinal))))
    new = F.min_by("parent", F.when(~F.col("_base") & named, F.col(ordinal)))
    got = every.groupBy(*keys).agg(F.count_distinct(F.struct("file_id", "page")).alias("n_pages"), (~F.bool_or("_base")).alias("added"), own.alias("_own"), new.alias("_new"))
    sure = F.coalesce(F.col("_own.conf"), F.lit(0.0))
    take = F.col("_new").isNotNull() & (F.lit(worth) > sure)
    return got.select(*keys, "n_pages", F.when(take, F.col("_new")).otherwise(F.col("_own.parent")).alias("parent"), F.when(take, worth).otherwise(sure).alias("conf"), "added")


def placed(df: DataFrame, order: str) -> DataFrame:
    """Adds ``place``, the place of each row by a unique ``order`` from 1 on: counted within ranges, then over their totals."""
    from pyspark.sql import Window

    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if ends.lo is None:
        return df.withColumn("place", F.lit(None).cast("int"))
    width = max(1, (ends.hi - ends.lo + 1) // RANGES)
    ranged = df.withColumn("_range", F.floor((F.col(order) - ends.lo) / width))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    base = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_inside", inside).join(base, "_range").withColumn("place", (F.col("_before") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_before")
