"""The hierarchical price model: shrunken means by class, district, developer and compound, with unit effects."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.places import numbered
from ..plans.storage import saver

# Fixed values of the model.
SHRINK, SHRINK_EFFECT, CLIP, OUTLIER, ROUNDS, CALIBRATION = 4.0, 25.0, 0.6, math.log(2.5), 5, 50
BAND, LEAST = (math.log(0.75), math.log(1.25)), math.log(1.10)
REFERENCE_TYPE = {"apartment": "apartment", "chalet": "chalet", "house": "villa"}
FACTORS = (("type", None), ("finishing", "finished"), ("delivery", "ready"), ("plan", "cash"))


@dataclass
class Model:
    """What a fit leaves; every map has one entry for each class or level of a factor, so it is small."""

    base: dict[str, float] = field(default_factory=dict)
    effects: dict[str, dict[str, float]] = field(default_factory=lambda: {f: {} for f, _ in FACTORS})
    center: dict[str, float] = field(default_factory=dict)
    slope: dict[str, float] = field(default_factory=dict)
    stats: DataFrame | None = None  # key, total, n
    units: DataFrame | None = None  # the units learnt from, with their own residuals


def _of(table: dict[str, float], column: str, default: float = 0.0) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column)), F.lit(default))


def adjustment(m: Model, without: str | None = None) -> Column:
    size = _of(m.slope, "cls") * (F.col("log_area") - F.coalesce(_of(m.center, "cls", float("nan")), F.col("log_area")))
    total = F.when(F.isnan(size), 0.0).otherwise(size) if without != "area" else F.lit(0.0)
    for f, _ in FACTORS:
        if f != without:
            total = total + _of(m.effects[f], f)
    return total


def keys(df: DataFrame) -> DataFrame:
    """k1, k2, k3: a unit's groups below its class. A unit without a developer has its compound in the developer's place."""
    gated = F.coalesce("in_compound", F.col("compound") != "") if "in_compound" in df.columns else F.col("compound") != ""
    join = lambda *c: F.concat_ws("\t", *c)
    path = F.array_compact(F.array(
        join(F.lit("district"), "cls", F.lower("district"), gated.cast("string")),
        F.when(F.col("developer") != "", join(F.lit("developer"), "cls", F.lower("district"), "developer")),
        F.when(F.col("compound") != "", join(F.lit("compound"), "cls", "compound")),
    ))
    return df.withColumns({f"k{d}": F.try_element_at(path, F.lit(d)) for d in (1, 2, 3)})


def drop_outliers(units: DataFrame) -> DataFrame:
    """Without units priced implausibly far from the median of their district, or of their class; groups of five at least."""
    u = units.withColumn("dk", F.lower("district"))
    by = lambda name, *k: u.groupBy(*k).agg(F.median("y").alias(name), F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")
    j = u.join(by("dm", "cls", "dk"), ["cls", "dk"], "left").join(by("cm", "cls"), "cls", "left")
    return j.where(F.coalesce(F.abs(F.col("y") - F.coalesce("dm", "cm")) <= OUTLIER, F.lit(True))).drop("dm", "cm", "dk")


def fit(units: DataFrame, save, rounds: int = ROUNDS) -> Model:
    """Backfitting. save(df, name) writes an intermediate table to shared storage and reads it back.

    units: id, cls, type, district, developer, compound, finishing, delivery, plan,
    log_area, y. Only sums by class and by level of a factor come to the driver.
    """
    m = Model()
    u = save(keys(drop_outliers(units.where(F.col("y").isNotNull() & F.col("cls").isin(*REFERENCE_TYPE)))), "units")
    m.center = {r.cls: r.c for r in u.groupBy("cls").agg(F.median("log_area").alias("c")).collect()}
    for step in range(rounds):
        a = u.withColumn("adjusted", F.col("y") - adjustment(m))
        m.base = {r.cls: r.b for r in a.groupBy("cls").agg(F.avg("adjusted").alias("b")).collect()}
        a = a.withColumn("estimate", _of(m.base, "cls"))
        stats = None
        for d in (1, 2, 3):
            residual = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("adjusted") - F.col("estimate")))
            a = a.withColumn(f"r{d}", F.when(F.col(f"k{d}").isNotNull(), residual))
            s = a.where(f"k{d} IS NOT NULL").groupBy(F.col(f"k{d}").alias("key")).agg(F.sum(f"r{d}").alias("total"), F.count(F.lit(1)).alias("n"))
            a = a.join(s.select(F.col("key").alias(f"k{d}"), (F.col("total") / (F.col("n") + SHRINK)).alias("delta")), f"k{d}", "left")
            a = a.withColumn("estimate", F.col("estimate") + F.coalesce("delta", F.lit(0.0))).drop("delta")
            s = s.withColumn("depth", F.lit(d))
            stats = s if stats is None else stats.unionByName(s)
        a = save(a, f"round{step}")
        for f, anchor in FACTORS:
            left = a.withColumn("left", F.col("y") - F.col("estimate") - adjustment(m, without=f))
            new = {r[f]: r.s / (r.n + SHRINK_EFFECT) for r in left.groupBy(f).agg(F.sum("left").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
            if f == "type":
                from ..functions.lookups import CLASSES

                at = {c: new.get(REFERENCE_TYPE[c], 0.0) for c in m.base}
                new = {k: v - at.get(CLASSES.get(k), 0.0) for k, v in new.items()}
            else:
                new = {k: v - new.get(anchor, 0.0) for k, v in new.items()}
            m.effects[f] = new
        x = F.col("log_area") - _of(m.center, "cls")
        r = F.col("y") - F.col("estimate") - adjustment(m, without="area")
        sums = a.withColumns({"x": x, "r": r}).groupBy("cls").agg(F.sum(F.col("x") * F.col("r")).alias("xr"), F.sum(F.col("x") * F.col("x")).alias("xx")).collect()
        m.slope = {s.cls: max(-0.8, min(0.3, s.xr / s.xx)) if s.xx else 0.0 for s in sums}
        m.stats = save(stats.groupBy("key").agg(F.max_by("total", "depth").alias("total"), F.max_by("n", "depth").alias("n")), f"stats{step}")
        m.units = a
    return m


def predict(m: Model, units: DataFrame, exclude: bool = False) -> DataFrame:
    """log_fair and a grade for each unit (columns k1 to k3); exclude takes the unit's own residuals r1 to r3 out."""
    u = units.withColumn("estimate", _of(m.base, "cls", float("nan")))
    count = {lv: F.lit(0.0) for lv in ("district", "developer", "compound")}
    for d in (1, 2, 3):
        u = u.join(m.stats.select(F.col("key").alias(f"k{d}"), F.col("total").alias(f"t{d}"), F.col("n").alias(f"n{d}")), f"k{d}", "left")
        own = F.col(f"r{d}") if exclude else F.lit(0.0)
        n = F.coalesce(F.col(f"n{d}") - (1 if exclude else 0), F.lit(0))
        u = u.withColumn(f"c{d}", n).withColumn("estimate", F.col("estimate") + F.when(n > 0, (F.col(f"t{d}") - F.coalesce(own, F.lit(0.0))) / (n + SHRINK)).otherwise(0.0))
        for lv in count:
            count[lv] = F.when(F.startswith(f"k{d}", F.lit(lv + "\t")), F.col(f"c{d}")).otherwise(count[lv])
    grade = F.when(count["compound"] >= 6, "A").when((count["compound"] >= 2) | (count["developer"] >= 6), "B").when(count["district"] >= 6, "C")
    return u.withColumns({"grade": grade, "log_fair": F.col("estimate") + adjustment(m)}).where("NOT isnan(estimate)").drop("t1", "t2", "t3", "n1", "n2", "n3", "c1", "c2", "c3")


def backtest(m: Model) -> DataFrame:
    """Of each grade, valued as if each unit were not in the data: errors, shares within 10 and 20 %, the range of p10 to p90."""
    p = predict(m, m.units, exclude=True).where("grade IS NOT NULL").withColumn("error", F.col("y") - F.col("log_fair"))
    off = F.abs(F.exp("error") - 1)
    g = p.withColumn("off", off).groupBy("grade").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.median("off"), 4).alias("median_abs_error"), F.bround(F.avg((F.col("off") <= 0.1).cast("double")), 4).alias("within_10pct"),
        F.bround(F.avg((F.col("off") <= 0.2).cast("double")), 4).alias("within_20pct"), F.percentile("error", 0.1).alias("p10"), F.percentile("error", 0.9).alias("p90"),
    )
    enough = F.col("n") >= CALIBRATION
    low, high = F.least(F.when(enough, F.col("p10")).otherwise(BAND[0]), F.lit(-LEAST)), F.greatest(F.when(enough, F.col("p90")).otherwise(BAND[1]), F.lit(LEAST))
    return g.select("grade", "n", "median_abs_error", "within_10pct", "within_20pct", F.bround(F.exp(low) - 1, 4).alias("range_low"), F.bround(F.exp(high) - 1, 4).alias("range_high"), enough.alias("calibrated"))


def naive(units: DataFrame) -> DataFrame:
    """Each unit's error against the median of the others of its class and district (five at least).

    The median without one member follows from the group's sorted prices and the member's
    rank: only the two or three middle values are looked at. Ranks come from places in the
    whole table, so that a district of any size is not sorted in one task.
    """
    u = units.select("id", "cls", F.lower("district").alias("dk"), "y")
    u = numbered(u, ["cls", "dk", "y", "id"], saver(units.sparkSession), "naive")
    groups = u.groupBy("cls", "dk").agg(F.min("place").alias("first"), F.count(F.lit(1)).cast("int").alias("n")).where("n >= 6")
    u = u.join(groups, ["cls", "dk"]).withColumn("r", (F.col("place") - F.col("first") + 1).cast("int"))
    mid = u.where("abs(2 * r - n - 1) <= 3").groupBy("cls", "dk").agg(F.map_from_entries(F.collect_list(F.struct("r", "y"))).alias("m"))  # four at most
    j = u.join(mid, ["cls", "dk"])
    at = lambda k: F.try_element_at("m", F.when(F.col("r") <= k, k + 1).otherwise(k).cast("int"))
    lo, hi = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") + 1) / 2).cast("int")
    return j.select("id", F.abs(F.exp(F.col("y") - (at(lo) + at(hi)) / 2) - 1).alias("naive_error"))


def summarize_effects(m: Model) -> list[tuple[str, str, float]]:
    """(factor, level, premium) of each fitted adjustment, and what twice the area changes in each class."""
    pct = lambda v: round(math.exp(v) - 1, 4)
    out = [(f, level, pct(v)) for f, _ in FACTORS for level, v in sorted(m.effects[f].items()) if level is not None]
    return out + [("area_doubling", c, pct(s * math.log(2))) for c, s in sorted(m.slope.items())]


def reference(m: Model, units: DataFrame) -> DataFrame:
    """id and the price per square metre of a finished, ready unit of usual type and size at each unit's place."""
    u = predict(m, units)
    return u.select("id", F.exp(F.col("log_fair") - adjustment(m)).alias("reference_ppm"))
