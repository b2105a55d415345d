"""Points in intervals without pairs: dyadic intervals.

An interval of whole numbers falls into at most 2 x levels aligned intervals, and a number
lies in one of each size. So of all intervals over a number the best is found by keeping the best
of each aligned one (an aggregation that combines before the shuffle) and looking up levels + 1 of them,
however many intervals overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<struct<level:int,node:bigint>>"


def cover(left: Column, right: Column, levels: int) -> Column:
    """The aligned intervals that make up [left, right), numbers from 0 to 2^levels."""
    none = F.array().cast(NODES)
    begun = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"), none.alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        l, r = acc["l"], acc["r"]  # noqa: E741
        odd_l, odd_r = (l < r) & (l % 2 == 1), (l < r) & (r % 2 == 1)
        low = F.when(odd_l, l + 1).otherwise(l)
        one = lambda n: F.array(F.struct(level.cast("int").alias("level"), n.cast("bigint").alias("node")))
        nodes = F.concat(acc["nodes"], F.when(odd_l, one(l)).otherwise(none), F.when(odd_r & (r - 1 >= low), one(r - 1)).otherwise(none))
        high = F.when(odd_r, r - 1).otherwise(r)
        return F.struct(F.when(l < r, F.shiftright(low, 1)).otherwise(l).alias("l"), F.when(l < r, F.shiftright(high, 1)).otherwise(r).alias("r"), nodes.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), begun, step)["nodes"]


def around(point: Column, levels: int) -> Column:
    """The aligned intervals that hold a number, one of each size."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.struct(i.cast("int").alias("level"), F.call_function("shiftright", point.cast("bigint"), i).alias("node")))
