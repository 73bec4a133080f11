"""Windows over groups of any size: rows are laid out by range, so that one group is many tasks.

`laid_out` sorts rows by group and order into ranges that sampling makes equally large, whatever a group's share of the
rows is, and numbers them; `positions` turns that into row numbers inside the groups by running sums over a group's ranges; `near`
finds neighbours across the borders of ranges by joining on positions, where a window would need the group in one task.
Nulls are keys like others. Rows that are equal in group and order stand in one range, in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tables import settle, small

_RANGE = 33  # bits below the number of a partition in monotonically_increasing_id


def laid_out(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with __at, which ascends with keys and order; settled, for the sample that cuts the ranges is taken anew in every run."""
    places = [F.col(k) for k in keys] + list(order)
    return settle(df.repartitionByRange(*places).sortWithinPartitions(*places).withColumn("__at", F.monotonically_increasing_id()), "laid-out")


def positions(laid: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A laid-out frame with the number of each row in its group, from 0."""
    part = F.shiftright("__at", _RANGE)
    ranges = laid.groupBy(*keys, part.alias("__range")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    told = ranges.withColumn("__before", F.coalesce(before, F.lit(0)))
    told = small(settle(told.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__range", "__first", "__before"), "ranges"))
    same = reduce(lambda a, b: a & b, (laid[k].eqNullSafe(told[f"__k{i}"]) for i, k in enumerate(keys)))
    met = laid.join(told, same & (F.shiftright(laid["__at"], _RANGE) == told["__range"]))
    return met.withColumn(name, (F.col("__before") + F.col("__at") - F.col("__first")).cast("long")).drop("__first", "__before", "__range", *(f"__k{i}" for i in range(len(keys))))


def near(placed: DataFrame, marked: DataFrame, keys: list[str], at: str, radius: int) -> DataFrame:
    """Rows of placed within `radius` positions of a row of marked (keys, at) of their group."""
    asked = marked.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.explode(F.sequence(F.col(at) - radius, F.col(at) + radius)).alias("__near")).distinct()
    same = reduce(lambda a, b: a & b, (placed[k].eqNullSafe(asked[f"__k{i}"]) for i, k in enumerate(keys)))
    return placed.join(asked, same & (placed[at] == asked["__near"]), "left_semi")
