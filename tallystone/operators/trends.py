"""Asking prices over time, from sketches that merge: by compound and month, and from there by anything coarser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of a sketch: ranks are off by about 1.65 % at this k (a single one, with 99 % confidence).
K = 200


def sketched(prices: DataFrame, keys: list[str], value: str, month: Column, k: int = K) -> DataFrame:
    """A sketch (and n, least, most) of the values of each key and month: a few kilobytes each, however many values."""
    v = F.col(value).cast("double")
    rows = prices.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.trunc(month, "month").alias("month"), v.alias("v"))
    return rows.groupBy(*keys, "month").agg(F.kll_sketch_agg_double("v", k).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches joined over whatever the keys leave out, without another look at the values."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' keys and figures with a column for each share."""
    return sketches.select("*", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in shares.items())).drop("sketch")
