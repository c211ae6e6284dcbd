"""The best representative of each group of records, field by field.

One aggregation: for each attribute the maximum of a struct (has a usable value, source priority, time, smaller id,
value), which carries the value and the row it comes from. It is combined before the shuffle, so a hot group costs one
row a task.

Defined results: groups with a null key column keep together as their own group; unusable values never survive, an
attribute without a usable value is null; a null time is older than any; ties go to the smallest id, repeated ids to the
greatest value. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surviving(df: DataFrame, keys: list[str], id_: str, priority: Column, time: str, fields: dict[str, tuple[Column, Column]], least: int = 2) -> DataFrame:
    """``keys``, ``n_rows``, ``record`` (the best row's id) and for each field ``<field>`` and ``<field>_from``.

    fields: name to (usable, value). Groups of fewer than ``least`` rows are left out.
    """
    ranks = df.withColumns({"_priority": priority, "_less": -F.col(id_)})

    def best(usable: Column, value: Column) -> Column:
        entry = F.struct(F.coalesce(usable, F.lit(False)).alias("usable"), "_priority", F.col(time).alias("_time"), "_less", value.alias("value"), F.col(id_).alias("id"))
        return F.max(entry)

    got = ranks.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        best(F.lit(True), F.lit(None).cast("int")).alias("_record"),
        *[best(usable, value).alias(f"_f_{name}") for name, (usable, value) in fields.items()],
    )
    taken = [
        c
        for name in fields
        for c in (
            F.when(F.col(f"_f_{name}.usable"), F.col(f"_f_{name}.value")).alias(name),
            F.when(F.col(f"_f_{name}.usable"), F.col(f"_f_{name}.id")).alias(f"{name}_from"),
        )
    ]
    return got.where(F.col("n_rows") >= least).select(*keys, "n_rows", F.col("_record.id").alias("record"), *taken)
