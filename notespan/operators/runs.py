"""Windows over long groups, cut into ranges of positions: a group may hold a third of all rows.

Each range of SPAN positions is a window of its own. What it needs from the ranges before and after (the
last match, how many rows or runs there are) is one row a range, made by a partial aggregate; those few
rows are put in order per group and joined back. Positions are whole numbers; rows of one position stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def ranged(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_range", F.coalesce(F.floor(F.col(order) / SPAN), F.lit(-(1 << 62))).cast("long"))


def joined(rows: DataFrame, ranges: DataFrame, within: list[str]) -> DataFrame:
    """rows with what is known of their range; groups with a null name are groups too."""
    other = ranges.select(*(F.col(c).alias(f"_{c}_") for c in [*within, "_range"]), *(c for c in ranges.columns if c not in [*within, "_range"]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*within, "_range"]]
    return rows.join(other, same).drop(*(f"_{c}_" for c in [*within, "_range"]), "_range")


def matched(rows: DataFrame, match: Column, order: str, within: list[str]) -> DataFrame:
    """rows with next_at and previous_at: the positions of the next row of the group that matches and of the one before, around the ends; null if none does."""
    at = F.when(match, F.col(order))
    own = ranged(rows, order).withColumn("_at", at)
    ranges = own.groupBy(*within, "_range").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    group = Window.partitionBy(*within)
    before, after = (group.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_range"), F.desc("_range")))
    ranges = ranges.withColumns({"_before": F.last("_high", ignorenulls=True).over(before), "_after": F.last("_low", ignorenulls=True).over(after), "_first": F.min("_low").over(group), "_last": F.max("_high").over(group)}).drop("_low", "_high")
    inside = Window.partitionBy(*within, "_range")
    earlier, later = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(order), F.desc(order)))
    own = own.withColumns({"_up": F.last("_at", ignorenulls=True).over(later), "_down": F.last("_at", ignorenulls=True).over(earlier)})
    out = joined(own, ranges, within)
    return out.withColumns({"next_at": F.coalesce("_up", "_after", "_first"), "previous_at": F.coalesce("_down", "_before", "_last")}).drop("_at", "_up", "_down", "_before", "_after", "_first", "_last")


def in_runs(rows: DataFrame, key: str, order: str, within: list[str]) -> DataFrame:
    """rows with run: a number, from 1, that goes up whenever the key changes, in order: what is flushed together."""
    own = ranged(rows, order)
    inside, group = Window.partitionBy(*within, "_range").orderBy(order), Window.partitionBy(*within).orderBy("_range")
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(inside))).cast("long")
    own = own.withColumn("_changed", F.when(F.row_number().over(inside) == 1, F.lit(0).cast("long")).otherwise(changed))
    # Of a range: how often the key changes in it, and whether its first key is the last one of the range before.
    ranges = own.groupBy(*within, "_range").agg(F.sum("_changed").alias("_n"), F.min_by(F.struct(F.col(key).alias("k")), order).alias("_head"), F.max_by(F.struct(F.col(key).alias("k")), order).alias("_tail"))
    new = F.when(F.lag("_tail").over(group).isNull() | ~F.col("_head.k").eqNullSafe(F.lag("_tail").over(group)["k"]), 1).otherwise(0).cast("long")
    ranges = ranges.withColumn("_new", new).withColumn("_base", F.coalesce(F.sum(F.col("_n")).over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_new").over(group)).drop("_n", "_head", "_tail", "_new")
    own = own.withColumn("_run", F.sum("_changed").over(inside))
    return joined(own, ranges, within).withColumn("run", F.col("_base") + F.col("_run")).drop("_base", "_run", "_changed")


def ranked(rows: DataFrame, order: str, tie: str, within: list[str], name: str) -> DataFrame:
    """rows with their place (from 1) in the group, by order and then tie."""
    own = ranged(rows, order)
    ranges = own.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy(*within, "_range").orderBy(order, tie)))
    return joined(own, ranges, within).withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_base", "_place")
