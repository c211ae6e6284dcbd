"""Ordered fills within a partition (a page, a board): state machines over rows in their closed window forms.

``part`` and ``order`` name the partition and order columns. Partitions are pages or boards, which are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.patterns import has


def _over(part: list[str], order: list[str]):
    w = Window.partitionBy(*part).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fill_ways(df: DataFrame, part: list[str], order: list[str], way: str = "way", rank: str = "phase_rank") -> DataFrame:
    """Adds ``filled_way`` and ``inferred``: rows take the way of the last explicit row, unless the phase starts anew;
    these take the next explicit way, or at the end one more than the last."""
    w, _ = _over(part, order)
    before = F.last(way, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(way, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    anew = F.col(way).isNull() & F.coalesce(F.col(rank) <= F.lag(rank).over(w), F.lit(False))
    filled = F.coalesce(F.col(way), F.when(~F.col("_anew"), F.col("_before")), F.col("_after"), F.col("_before") + 1)
    out = df.withColumns({"_before": before, "_after": after, "_anew": anew}).withColumn("filled_way", filled)
    ended = F.col(way).isNull() & F.col("_anew") & F.col("_after").isNull() & F.col("_before").isNotNull()
    return out.withColumn("inferred", ended).drop("_before", "_after", "_anew")


def boundary_groups(df: DataFrame, part: list[str], order: list[str], phase: str = "phase", way: str = "way") -> DataFrame:
    """Adds ``group_no``: a group starts on L1, after L3, and on its second explicit way."""
    w, upto = _over(part, order)
    opens = (F.col(phase) == "L1") | F.coalesce(F.lag(phase).over(w) == "L3", F.lit(False)) | (F.row_number().over(w) == 1)
    out = df.withColumn("_open", opens.cast("int")).withColumn("_seg", F.sum("_open").over(upto))
    _, in_seg = _over([*part, "_seg"], order)
    out = out.withColumn("_sub", F.greatest(F.count(way).over(in_seg) - 1, F.lit(0)))
    number = F.dense_rank().over(Window.partitionBy(*part).orderBy("_seg", "_sub"))
    return out.withColumn("group_no", number).drop("_open", "_seg", "_sub")


def infer_sequence(df: DataFrame, part: list[str], order: list[str], group: str = "group_no", way: str = "way") -> DataFrame:
    """Adds ``group_way``: a group's first explicit way, else one more than the group's before; null before any."""
    firsts = df.groupBy(*part, group).agg(F.min_by(way, F.when(F.col(way).isNotNull(), F.struct(*order))).alias("_way"))
    w = Window.partitionBy(*part).orderBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_way", ignorenulls=True).over(w)
    at = F.last(F.when(F.col("_way").isNotNull(), F.col(group)), ignorenulls=True).over(w)
    firsts = firsts.withColumn("group_way", (last + F.col(group) - at).cast("int")).drop("_way")
    return df.join(firsts, [*part, group])


def carry_forward(df: DataFrame, part: list[str], order: list[str], value: str, resets: Column | None = None, out: str = "carried") -> DataFrame:
    """Adds ``out``: the value of the last row that has one, since the last row that resets."""
    _, upto = _over(part, order)
    if resets is None:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    segments = df.withColumn("_seg", F.sum(F.coalesce(resets, F.lit(False)).cast("int")).over(upto))
    _, in_seg = _over([*part, "_seg"], order)
    return segments.withColumn(out, F.last(value, ignorenulls=True).over(in_seg)).drop("_seg")


def running_flag(df: DataFrame, part: list[str], order: list[str], flag: Column, out: str) -> DataFrame:
    """Adds ``out``: true from the first row on which the flag holds."""
    _, upto = _over(part, order)
    return df.withColumn(out, F.max(F.coalesce(flag, F.lit(False))).over(upto))


HEADER = r"\b(?:WAY|CCT|CIRCUIT)\b.*\b(?:DESCRIPTION|RATING|DEVICE|PROTECTION)\b"


def stitch(df: DataFrame, part: list[str], order: list[str], line: str, board: str) -> DataFrame:
    """Rows of continued pages with the board carried forward and header lines dropped."""
    carried = carry_forward(df, part, order, board, out="board")
    return carried.where(~has(F.col(line), HEADER) & (F.trim(line) != ""))
