"""How long listings stay: spells on the market from their versions, and product-limit estimates with censored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spells(versions: DataFrame, now: Column) -> DataFrame:
    """property_id, started, days and left of each time a listing was on the market; those still there are censored at `now`.

    versions: property_id, captured_at, change_type. A spell begins with created or
    relisted and ends with the next removed. What repeats (a second start without a
    removal between) does not begin a new one.
    """
    w = Window.partitionBy("property_id").orderBy("captured_at", F.when(F.col("change_type") == "removed", 0).otherwise(1))
    start = F.col("change_type").isin("created", "relisted")
    marks = versions.where(start | (F.col("change_type") == "removed")).select("property_id", "captured_at", "change_type", start.alias("starts"))
    marks = marks.withColumn("before", F.lag("starts").over(w)).where("starts <> coalesce(before, false)")
    marks = marks.withColumn("until", F.lead("captured_at").over(w)).where("starts")
    left = F.col("until").isNotNull()
    days = F.date_diff(F.to_date(F.coalesce("until", now)), F.to_date("captured_at"))
    return marks.select("property_id", F.col("captured_at").alias("started"), F.greatest(days, F.lit(0)).alias("days"), left.alias("left"))


def survival(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group and each day on which a spell ended: at_risk, ended and survival, the share that stays longer.

    rows: the keys, days and left. Spells are counted by day first, so that what is ordered
    in a group is its days, not its spells. A spell censored on a day was at risk on it.
    """
    by_day = rows.where("days IS NOT NULL").groupBy(*keys, "days").agg(F.count_if("left").alias("ended"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("days"))
    by_day = by_day.withColumn("at_risk", F.sum("n").over(w))
    up = Window.partitionBy(*keys).orderBy("days")
    # Sums of logarithms; once all that are left end, nothing survives.
    none = F.max((F.col("ended") == F.col("at_risk")).cast("int")).over(up) == 1
    log = F.when(F.col("ended") < F.col("at_risk"), F.log1p(-F.col("ended") / F.col("at_risk"))).otherwise(0.0)
    out = by_day.withColumn("survival", F.when(none, 0.0).otherwise(F.exp(F.sum(log).over(up))))
    return out.where("ended > 0").select(*keys, "days", "at_risk", "ended", F.round("survival", 6).alias("survival"))


def medians(curve: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """The first day on which at most `share` of each group is left; null where it never is."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= share, F.col("days"))).alias("median_days"), F.max("at_risk").alias("spells"), F.sum("ended").alias("ended"))
