"""Ordered functions over groups of any size: what all earlier rows of a group hold.

A window over a group runs in one task, so a group with a third of all rows would
too.  Here rows are cut into range partitions by (group, order); inside a block a
window sees the block's part of a group only, and what the earlier blocks of the
group hold is added.  Only the first and the last group of a block can reach into
another, so what has to be added is at most two rows per block.

Defined cases: a null group is a group; rows that are equal in the order are taken
one after the other, in any order; before the first row of a group everything is
null (sums too); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.plans.runtime import partitions_for, stage

BLOCK = 1_000_000  #: rows per block; results don't depend on it

_WITHIN = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c)}


def _blocks(df: DataFrame, order: list[str], block: int) -> DataFrame:
    parts = partitions_for(df.count(), block)
    ranged = df.repartitionByRange(parts, "__key", *order) if parts > 1 else df.coalesce(1)
    return stage(ranged.withColumn("__block", F.spark_partition_id()), "ordered")


def before(df: DataFrame, group: list[str], order: list[str], *, block: int | None = None, **values: tuple[str, str]) -> DataFrame:
    """``df`` with a column per value: (how, column) over all earlier rows of the
    group; how is sum, max, min or last (the row just before, null or not)."""
    keyed = stage(df.withColumn("__key", F.to_json(F.struct(*group), {"ignoreNullFields": "false"})), "keyed")
    held = _blocks(keyed, order, block or BLOCK)
    place = F.struct(*order)
    earlier = Window.partitionBy("__key", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = held.withColumns({f"__{n}": _WITHIN[how](c).over(earlier) for n, (how, c) in values.items()} | {"__first": F.row_number().over(Window.partitionBy("__key", "__block").orderBy(*order)) == 1})
    # groups at the edges of blocks, at most two per block
    edges = held.groupBy("__block").agg(F.array_distinct(F.array(F.min("__key"), F.max("__key"))).alias("k")).select("__block", F.explode("k").alias("__key"))
    of_block = {"last": lambda c: F.max_by(F.struct(c), place)}
    sums = held.join(F.broadcast(edges), ["__block", "__key"]).groupBy("__key", "__block").agg(
        *[(of_block.get(how) or (lambda c, how=how: _WITHIN[how](c)))(c).alias(n) for n, (how, c) in values.items()]
    )
    prior = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks
    carried = stage(sums.select("__key", "__block", *[_WITHIN[how](n).over(prior).alias(f"__c_{n}") for n, (how, _) in values.items()]), "carried")
    met = inside.join(F.broadcast(carried), ["__key", "__block"], "left")

    def both(n: str, how: str):
        own, carry = F.col(f"__{n}"), F.col(f"__c_{n}")
        if how == "sum":
            return F.when(own.isNotNull() | carry.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        if how == "last":
            return F.when(F.col("__first"), carry.getField(values[n][1])).otherwise(own)
        return F.greatest(own, carry) if how == "max" else F.least(own, carry)

    return met.select(*df.columns, *[both(n, how).alias(n) for n, (how, _) in values.items()])


def ranked(df: DataFrame, order: list[str], name: str, *, block: int | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order, over all rows."""
    parts = partitions_for(df.count(), block or BLOCK)
    held = stage(df.repartitionByRange(parts, *order).withColumn("__block", F.spark_partition_id()), "ranked")
    sizes = held.groupBy("__block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = sizes.select("__block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    here = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    return held.withColumn("__here", here).join(F.broadcast(starts), "__block").select(*df.columns, (F.col("__start") + F.col("__here")).alias(name))


def asof(df: DataFrame, group: list[str], order: str, value: str, name: str, *, later: bool = False, block: int | None = None) -> DataFrame:
    """``df`` with the highest ``value`` of the group's rows whose ``order`` is lower,
    or with ``later`` the lowest of those whose order is higher; rows without an
    order meet nothing.  Equal orders do not see each other."""
    step = F.min if later else F.max
    at = df.withColumns({"__at": (-F.col(order) if later else F.col(order)), "__group": F.to_json(F.struct(*group), {"ignoreNullFields": "false"})})
    points = at.where("__at is not null").groupBy("__group", "__at").agg(step(value).alias("__v"))
    placed = before(points, ["__group"], ["__at"], block=block, **{name: ("min" if later else "max", "__v")})
    return at.join(placed.select("__group", "__at", name), ["__group", "__at"], "left").select(*df.columns, name)
