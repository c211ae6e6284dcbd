"""Consolidation of rows under a key: totals, distinct lists, quantity matrix, conflicts, and the gate of equal totals.

"Missing" is a value of its own in keys, never merged with a known one. Quantities are summed before the shuffle; lists
hold distinct short values only. Provenance stays a table of contributors, it is never nested into one row of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(rows: DataFrame, keys: list[str], qty: str, confidence: str, lists: dict[str, str] | None = None, counts: dict[str, str] | None = None) -> DataFrame:
    """``keys``, ``quantity``, ``n_rows``, ``confidence`` (the least), sorted distinct lists and distinct counts."""
    found = [F.concat_ws("; ", F.array_sort(F.collect_set(c))).alias(name) for name, c in (lists or {}).items()]
    found += [F.count_distinct(F.col(c)).alias(name) for name, c in (counts or {}).items()]
    least = F.round(F.least(F.lit(1.0), F.min(confidence)), 6)
    return rows.groupBy(*keys).agg(F.sum(qty).alias("quantity"), F.count("*").alias("n_rows"), least.alias("confidence"), *found)


def matrix(rows: DataFrame, keys: list[str], over: str, labels: list[str], qty: str) -> DataFrame:
    """One row a key and a grand total row (null keys), one column a label; absent quantities are null. The labels are
    given, so no job looks for them, and values beyond them count in ``total`` only."""
    cells = [F.nullif(F.coalesce(F.sum(F.when(F.col(over) == x, F.col(qty))), F.lit(0)), F.lit(0)).alias(x) for x in labels]
    return rows.rollup(*keys).agg(F.grouping_id().alias("_level"), *cells, F.sum(qty).alias("total")).where(F.col("_level").isin(0, 2 ** len(keys) - 1)).drop("_level")


def conflicts(rows: DataFrame, attributes: list[str], unknown: dict[str, list[str]]) -> DataFrame:
    """Adds ``conflicts``: the attributes of which rows that agree in all others have two known values or more.

    unknown: attribute to the values that count as not known. Known values are reduced to distinct ones by partial
    aggregation, and their least and greatest compared, so no group is gathered.
    """
    out, flags = rows, []
    for a in unknown:
        others = [x for x in attributes if x != a]
        known = rows.where(F.col(a).isNotNull() & ~F.col(a).isin(*unknown[a]))
        clash = known.groupBy(*others).agg(F.min(a).alias("_lo"), F.max(a).alias("_hi")).where("_lo != _hi")
        clash = clash.select(*[F.col(x).alias(f"_c_{x}") for x in others], F.lit(a).alias(f"_clash_{a}"))
        on = reduce(lambda l, r: l & r, [F.col(x).eqNullSafe(F.col(f"_c_{x}")) for x in others])
        own = F.col(a).isNotNull() & ~F.col(a).isin(*unknown[a])  # a missing value does not contradict
        out = out.join(clash, on & own, "left").drop(*[f"_c_{x}" for x in others])
        flags.append(f"_clash_{a}")
    return out.withColumn("conflicts", F.concat_ws(", ", *flags)).drop(*flags)


def reasons(*rules: tuple[str, Column]) -> Column:
    """The texts of the rules that hold, in order, as one text; '' if none."""
    return F.concat_ws("; ", *[F.when(rule, F.lit(name)) for name, rule in rules])


def totals(rows: DataFrame, groups: list[str], qty: str) -> DataFrame:
    """``groups``, ``level`` and ``quantity`` of every group, its parents and everything."""
    return rows.rollup(*groups).agg(F.grouping_id().cast("bigint").alias("level"), F.sum(qty).alias("quantity"))


def gate(source: DataFrame, consolidated: DataFrame, board_totals: DataFrame, qty: str, keys: list[str]) -> DataFrame:
    """``issue, expected, actual``: every total that does not reconcile; empty when all do.

    source rows, consolidated lines and totals by board must agree in all, and each line with its own rows.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    by_key = source.groupBy(*keys).agg(F.sum(qty).alias("expected")).alias("s")
    lines_ = consolidated.select(*keys, F.col("quantity").alias("actual")).alias("l")
    line_issues = by_key.join(lines_, same, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
    line_issues = line_issues.select(F.lit("line").alias("issue"), F.col("expected").cast("double"), F.col("actual").cast("double"))
    sums = [source.agg(F.sum(qty).alias("q")).select(F.lit("source").alias("what"), "q"), consolidated.agg(F.sum("quantity").alias("q")).select(F.lit("lines").alias("what"), "q"), board_totals.agg(F.sum("quantity").alias("q")).select(F.lit("boards").alias("what"), "q")]
    wide = reduce(DataFrame.unionByName, sums).agg(*[F.max(F.when(F.col("what") == x, F.col("q"))).alias(x) for x in ("source", "lines", "boards")])
    checks = F.array(*[F.struct(F.lit(f"{a} and {b}").alias("issue"), F.col(a).cast("double").alias("expected"), F.col(b).cast("double").alias("actual")) for a, b in (("source", "lines"), ("source", "boards"))])
    overall = wide.select(F.explode(checks).alias("c")).select("c.*").where(~F.col("expected").eqNullSafe(F.col("actual")))
    return line_issues.unionByName(overall)


class NotReconciled(ValueError):
    """Totals differ; nothing was written."""


def assert_reconciled(issues: DataFrame) -> None:
    bad = issues.limit(5).collect()
    if bad:
        raise NotReconciled("reconciliation failed: " + "; ".join(f"{r.issue}: {r.expected} and {r.actual}" for r in bad))


def first_best(df: DataFrame, key: str, value: str, score: Column, ordinal: str) -> DataFrame:
    """``key``, ``value``, ``score``: the value with the greatest score, the first one in a tie."""
    pick = F.max_by(F.struct(F.col(value), score.alias("score")), F.struct(score.alias("s"), (-F.col(ordinal)).alias("o")))
    return df.groupBy(key).agg(pick.alias("_p")).select(key, F.col(f"_p.{value}").alias(value), "_p.score")


def contributors(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row for each row and field: ``field, value`` beside the row's other columns."""
    cells = F.array(*[F.struct(F.lit(name).alias("field"), F.col(c).cast("string").alias("value")) for name, c in fields.items()])
    return rows.withColumn("_cell", F.explode(cells)).select("*", "_cell.field", "_cell.value").drop("_cell")

