"""References to records that do not exist, judged per period.

Parent and child keys are unioned in one long form and grouped by parent table, scope and key. A group keeps, for each
key, the months in which it is referred to, the first month from whose end on a parent stays, and the months at whose
end only a parent deleted later was there: sets no larger than the calendar, however many rows share the key. Months
that lack the parent flag go back to the referring rows by an equi-join on key and month.

Defined results: children without key are no references and never come out. A child without a time is an orphan only
if its key never had a parent; its period is null. Parents without a received time were never received. A null scope is
a scope of its own. Repeated rows each come out. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import materialise

_NO_TIME = -1


def month_number(ts: Column) -> Column:
    """Months since year 0, an integer that grows by one a month."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_text(n: Column) -> Column:
    """``YYYY-MM`` of a month number; null for a missing time."""
    return F.when(n >= 0, F.concat_ws("-", F.lpad(F.floor(n / 12).cast("string"), 4, "0"), F.lpad((n % 12 + 1).cast("string"), 2, "0")))


def missing_months(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``parent_table, scope, key, month``: the months at whose end no parent of a key was there that children name.

    children: ``parent_table, scope, key, at``; parents: ``parent_table, scope, key, received_at, deleted_at``.
    """
    none = F.lit(None).cast("int")
    group = ["parent_table", "scope", "key"]
    asked = children.where(F.col("key").isNotNull()).select(
        *group, F.coalesce(month_number(F.col("at")), F.lit(_NO_TIME)).alias("asked"), none.alias("stays_from"), none.alias("there")
    )
    first, last = month_number(F.col("received_at")), month_number(F.col("deleted_at")) - 1
    known = parents.where(F.col("key").isNotNull() & F.col("received_at").isNotNull())
    stays = known.where(F.col("deleted_at").isNull()).select(*group, none, first, none)
    short = known.where(F.col("deleted_at").isNotNull() & (last >= first)).select(*group, none, none, F.explode(F.sequence(first, last)))
    long = asked.union(stays).union(short)
    flags = long.groupBy(*group).agg(F.collect_set("asked").alias("asked"), F.min("stays_from").alias("stays_from"), F.collect_set("there").alias("there"))

    def there(m: Column) -> Column:
        ever = F.col("stays_from").isNotNull() | (F.size("there") > 0)
        return F.when(m == _NO_TIME, ever).otherwise(F.coalesce(m >= F.col("stays_from"), F.lit(False)) | F.array_contains("there", m))

    return flags.select(*group, F.explode(F.filter("asked", lambda m: ~there(m))).alias("month"))


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """The children, with ``month``, whose key had no parent at the end of the month of ``at``; other columns stay."""
    children = materialise(children.where(F.col("key").isNotNull()), "children")  # keys are made once, for both uses
    lack = missing_months(children, parents).select(*[F.col(c).alias(f"_m_{c}") for c in ("parent_table", "scope", "key", "month")])
    dated = children.where(F.col("key").isNotNull()).withColumn("month", F.coalesce(month_number(F.col("at")), F.lit(_NO_TIME)))
    on = (
        dated["parent_table"].eqNullSafe(lack["_m_parent_table"])
        & dated["scope"].eqNullSafe(lack["_m_scope"])
        & (dated["key"] == lack["_m_key"])
        & (dated["month"] == lack["_m_month"])
    )
    return dated.join(lack, on, "left_semi")


def orphans_by_period(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``src_table, ref_month, n_refs, n_orphans, n_orphan_keys``: counts are summed by key before anything is joined."""
    children = materialise(children.where(F.col("key").isNotNull()), "children")
    lack = missing_months(children, parents).withColumn("gone", F.lit(True))
    lack = lack.select(*[F.col(c).alias(f"_m_{c}") for c in ("parent_table", "scope", "key", "month")], "gone")
    counted = (
        children.where(F.col("key").isNotNull())
        .withColumn("month", F.coalesce(month_number(F.col("at")), F.lit(_NO_TIME)))
        .groupBy("src_table", "parent_table", "scope", "key", "month")
        .agg(F.count("*").alias("n"))
    )
    on = (
        counted["parent_table"].eqNullSafe(lack["_m_parent_table"])
        & counted["scope"].eqNullSafe(lack["_m_scope"])
        & (counted["key"] == lack["_m_key"])
        & (counted["month"] == lack["_m_month"])
    )
    gone = F.coalesce("gone", F.lit(False))
    return (
        counted.join(lack, on, "left")
        .groupBy("src_table", month_text(F.col("month")).alias("ref_month"))
        .agg(
            F.sum("n").alias("n_refs"),
            F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("n_orphans"),
            F.count(F.when(gone, 1)).alias("n_orphan_keys"),
        )
    )
