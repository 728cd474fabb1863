"""Places of rows in an order, counted from saved ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's number inside its range, as Spark's own increasing numbers have them.
_BITS = 33


def ranges(df: DataFrame, order: list, save: Callable[[DataFrame, str], DataFrame], name: str = "ranges") -> DataFrame:
    """df in sorted ranges, saved, with _at: a number that grows with the order, without being gapless; its upper bits are the range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return save(ranged.withColumn("_at", F.monotonically_increasing_id()), name)


def range_of(at: str = "_at") -> Column:
    return F.shiftright(at, _BITS)


def numbered(df: DataFrame, order: list, save: Callable[[DataFrame, str], DataFrame], name: str = "places") -> DataFrame:
    """df with place, from 0 without gaps in that order, saved.

    Ranges are sorted apart and saved together with each row's range and number there, so
    that both uses of them see the same ranges however they are run again or coalesced; a
    place is the number in the range plus the sizes of the ranges before. No task holds
    more than a range. The order must be total but for rows that are equal, and no value of
    it may be that of very many rows: rows that tie share a range.
    """
    rows = ranges(df, order, save, name)
    part, own = range_of().alias("_part"), F.col("_at").bitwiseAND((1 << _BITS) - 1)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + own).drop("_at", "_part", "_before")
