"""Keeping the best of rows that say the same.

Ties go to the smaller ordinal, then to the row whose values sort first, so a result does not depend on partitioning.
Rows with a null key are rows of one key; a null score is the worst. No group is collected: ranking is a window whose
partial limit drops all but the best rows before the shuffle, and the rows left out are found by an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], score: Column, ordinal: str) -> DataFrame:
    """One row a key: the highest score, the earliest in a tie."""
    best = Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), F.col(ordinal).asc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def with_retained(df: DataFrame, keys: list[str], score: Column, ordinal: str) -> DataFrame:
    """All rows with ``retained``: the ordinal of the row kept instead, null for the rows that are kept.

    The best row of each key comes from an aggregation that is combined before the shuffle and goes back by an equi-join, so
    the rows of a hot key are never sorted in one task. Ordinals must be unique, or a tie keeps several rows.
    """
    order = F.struct(score.isNotNull().alias("known"), score.alias("score"), F.col(ordinal).isNotNull().alias("o"), (-F.col(ordinal)).alias("less"))
    best = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(F.struct(F.col(ordinal).alias("kept")), order).alias("_kept"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    kept = F.col("_kept.kept")
    out = df.join(best, on).withColumn("retained", F.when(~F.col(ordinal).eqNullSafe(kept), kept))
    return out.drop("_kept", *[f"_k_{k}" for k in keys])


def excluded(df: DataFrame, keys: list[str], score: Column, ordinal: str) -> DataFrame:
    """The rows that ``keep_best`` leaves out, with ``retained``, the ordinal of the row kept instead."""
    return with_retained(df, keys, score, ordinal).where("retained IS NOT NULL")


def fingerprint(board: Column, way: Column, phase: Column, spec: Column, file_id: Column, page: Column, bbox: Column, line: Column, source: Column) -> Column:
    """The key under which rows are the same: circuit if board and way are known, else region on the page, else source."""
    none = F.lit("")
    part = lambda c: F.coalesce(c.cast("string"), none)
    corners = F.array_join(F.transform(bbox, lambda x: F.call_function("format_number", x, F.lit("0.0"))), ",")
    circuit = F.concat_ws("|", F.lit("circuit"), part(board), part(way), part(phase), part(spec))
    region = F.concat_ws("|", F.lit("region"), part(file_id), part(page), corners, part(spec))
    anywhere = F.concat_ws("|", F.lit("source"), part(file_id), part(page), part(line), part(source))
    return F.when((part(board) != "") & way.isNotNull(), circuit).when((part(file_id) != "") & page.isNotNull() & (F.size(bbox) > 0), region).otherwise(anywhere)
