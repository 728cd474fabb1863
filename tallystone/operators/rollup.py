"""Figures of compounds, developers, districts, sources and the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .compare import LEVELS, cash_ppm

HISTORY_DAYS = 56


def median(expr: str, digits: int, where: str = "true", of: int | None = None) -> Column:
    """The median of figures that are rounded to `of` digits (default: digits), itself rounded half to even.

    Computed in whole units of the last digit, where halves are exact.
    """
    unit = 10 ** max(0, digits if of is None else of)
    mid = F.expr(f"median(round(({expr}) * {unit})) FILTER (WHERE {where})") if unit > 1 else F.expr(f"median({expr}) FILTER (WHERE {where})")
    return F.bround(mid, digits - len(str(unit)) + 1) / unit


def share(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part, whole), 4)


def figures() -> list[Column]:
    """What is said of any group of units: delivery, payment plans and levels."""
    known, plans = F.expr("count_if(delivery_bucket <> 'unknown')"), F.expr("count_if(terms = 'plan')")
    return [
        F.count(F.lit(1)).alias("units"), share(F.expr("count_if(delivery_bucket = 'ready')"), known).alias("ready_share"), known.alias("delivery_known"),
        median("delivery_years", 1, "delivery_years > 0", of=2).alias("median_years_to_delivery"), F.max(F.substring("delivery_date", 1, 4).cast("int")).alias("latest_delivery_year"),
        share(plans, F.expr("count_if(terms IN ('plan', 'cash'))")).alias("plan_share"), median("remaining_share", 4, "terms = 'plan'").alias("median_remaining_share"),
        median("years", 1, "terms = 'plan'").alias("median_plan_years"), median("discount", 4, "terms = 'plan'").alias("median_plan_discount"),
        F.min("area_m2").alias("area_min"), F.max("area_m2").alias("area_max"), F.expr("count_if(level IN ('strong', 'good'))").alias("good_count"), *(F.count_if(F.col("level") == v).alias(v) for v in LEVELS),
    ]


def profile(items: DataFrame, keys: list[str]) -> DataFrame:
    """The figures of each group."""
    return items.groupBy(*keys).agg(*figures())


def all_levels(resale: DataFrame) -> DataFrame:
    """level, key and the figures of each compound, developer and district, and of all: one scan, one Expand, one exchange.

    The rows of a level are those that `profile` gives for it alone: units without a
    compound or developer count for the other levels only. A key is null for all.
    """
    keys = ["compound_key", "developer_key", "district_key"]
    items = resale.withColumn("district_key", T.slug(F.col("district")))
    named = items.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in keys[:2]})
    rows = named.groupingSets([[F.col(k)] for k in keys] + [[]], *(F.col(k) for k in keys)).agg(*figures(), *(F.grouping(k).alias(f"_{k}") for k in keys))
    level = F.when(F.col("_compound_key") == 0, "compound").when(F.col("_developer_key") == 0, "developer").when(F.col("_district_key") == 0, "district").otherwise("all")
    out = rows.select(level.alias("level"), F.coalesce(*keys).alias("key"), *[c for c in rows.columns if c not in keys and not c.startswith("_")])
    return out.where("level IN ('all', 'district') OR key IS NOT NULL")


def finishing_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Units of each finishing of each group."""
    return items.groupBy(*keys, "finishing_class").agg(F.count(F.lit(1)).alias("units"))


def developer_compounds(compound_rows: DataFrame) -> DataFrame:
    """The compounds of each developer: units, good ones, the median gap to the developer's own prices; the largest first."""
    c = compound_rows.where("developer_key <> ''")
    place = F.row_number().over(Window.partitionBy("developer_key").orderBy(F.desc("units"), "compound_key"))
    return c.select("developer_key", place.alias("place"), "compound_key", "compound", "district", "units", "good_count", "median_gap")


def developer_districts(resale: DataFrame) -> DataFrame:
    """The districts of each developer's resale units, by their number; of equal ones the one met first."""
    n = resale.where("developer_key <> ''").groupBy("developer_key", "district").agg(F.count(F.lit(1)).alias("units"), F.min("id").alias("met"))
    place = F.row_number().over(Window.partitionBy("developer_key").orderBy(F.desc("units"), "met"))
    return n.select("developer_key", place.alias("place"), "district", "units")


def district_classes(resale: DataFrame, matched: DataFrame, compound_rows: DataFrame) -> DataFrame:
    """price_classes of each district: its resale units, and the launch units of the compounds that lie in it."""
    items = resale.withColumn("district_key", T.slug(F.col("district")))
    units = matched.where("compound_key IS NOT NULL").join(compound_rows.select("compound_key", "district_key"), "compound_key")
    return price_classes(items, units, ["district_key"])


def coverage(matched: DataFrame, compound_rows: DataFrame, developer_rows: DataFrame, district_rows: DataFrame, established: int = 5) -> DataFrame:
    """One row: launch units and how many are matched, to how many compounds; entities with `established` units at least."""
    m = matched.agg(F.count(F.lit(1)).alias("launch_units"), F.count("compound_key").alias("launch_matched"), F.count_distinct("compound_key").alias("launch_compounds"))
    for name, df in (("compound", compound_rows), ("developer", developer_rows), ("district", district_rows)):
        m = m.join(F.broadcast(df.agg(F.count_if(F.col("units") >= established).alias(f"{name}_count"))))  # one row each
    return m.withColumn("launch_unmatched", F.col("launch_units") - F.col("launch_matched"))


def thresholds() -> dict[str, float]:
    """The rules that decide a level, as they are published."""
    from . import compare as c

    return {"strong_all": c.STRONG_ALL, "strong_one": c.STRONG_ONE, "good_all": c.GOOD_ALL, "good_one": c.GOOD_ONE, "pricier": c.PRICIER, "check_developer": c.CHECK_DEVELOPER, "check_peers": c.CHECK_PEERS, "check_cheapest": c.CHECK_CHEAPEST}


def price_classes(items: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group and class: observed prices, the developer's prices, and the gap between them."""
    like = "launch_same_finishing"
    own = items.where("class IS NOT NULL").withColumn("cash_ppm", cash_ppm()).groupBy(*keys, "class").agg(
        F.count(F.lit(1)).alias("units"), median("price_per_m2", -2).alias("median_asking_ppm"), median("cash_ppm", -2).alias("median_cash_ppm"),
        median("launch_gap", 4, like).alias("median_gap"), F.count_if(like).alias("compared"), F.bround(F.median("contract_year")).cast("int").alias("median_contract_year"),
    )
    dev = units.where("class IS NOT NULL").withColumn("cash_ppm", cash_ppm()).groupBy(*keys, "class").agg(median("price_per_m2", -2).alias("developer_ppm"), median("cash_ppm", -2).alias("developer_cash_ppm"))
    return own.join(dev, [*keys, "class"], "left")


def developer_prices(units: DataFrame, resale: DataFrame, keys: list[str]) -> DataFrame:
    """The developer's current units of each group, and how its resale units compare."""
    u = units.withColumn("cash_ppm", cash_ppm()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("launch_units"), median("price_per_m2", -2).alias("median_headline_ppm"), median("cash_ppm", -2).alias("median_cash_ppm"), median("years", 1).alias("launch_plan_years"),
        median("1 - coalesce(remaining_share, 0)", 4).alias("median_down_share"), F.max(F.substring("delivery_date", 1, 4).cast("int")).alias("launch_delivery_year"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.nullif("compound_name", F.lit("")))), 1, 6), "|").alias("phases"),
    )
    like = "launch_same_finishing"
    r = resale.groupBy(*keys).agg(F.count_if(like).alias("compared"), median("launch_gap", 4, like).alias("median_gap"), median("launch_contract_annual", 4).alias("median_since_contract"))
    return u.join(r, keys, "left").withColumn("compared", F.coalesce("compared", F.lit(0)))


def scope(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and share of each source in each group. The total is joined, not a window over the group."""
    n = items.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = n.join(total, keys) if keys else n.join(F.broadcast(total))  # one row
    return joined.select(*keys, "source", "n", share(F.col("n"), F.col("total")).alias("share"))


def best_of(items: DataFrame, key: str, values: list[str]) -> DataFrame:
    """What the best-ranked unit of each group says."""
    from .compare import level_order

    rank = F.struct(level_order().alias("l"), (-F.col("n_signals")).alias("s"), F.coalesce("score", F.lit(0.0)).alias("c"), "id")
    return items.where(F.col(key) != "").groupBy(key).agg(F.min_by(F.struct(*values), rank).alias("b")).select(key, *(F.col(f"b.{v}").alias(v) for v in values))


def compounds(resale: DataFrame, matched: DataFrame) -> DataFrame:
    """A row for each compound with resale units."""
    items = resale.where("compound_key <> ''")
    head = best_of(items, "compound_key", ["compound", "district", "developer_key", "developer", *(c for c in ("compound_ar", "developer_ar") if c in items.columns)])
    prices = developer_prices(matched.where("compound_key IS NOT NULL"), items, ["compound_key"])
    return profile(items, ["compound_key"]).join(head, "compound_key").join(prices, "compound_key", "left").withColumn("district_key", T.slug(F.col("district")))


def developers(resale: DataFrame, matched: DataFrame, compound_rows: DataFrame) -> DataFrame:
    """A row for each developer with resale units; its launch units are those of its compounds."""
    items = resale.where("developer_key <> ''")
    own = compound_rows.where("developer_key <> ''").select("compound_key", "developer_key")
    units = matched.where("compound_key IS NOT NULL").join(own, "compound_key")
    n = own.groupBy("developer_key").agg(F.count(F.lit(1)).alias("compound_count"))
    head = best_of(items, "developer_key", ["developer", *(c for c in ("developer_ar",) if c in items.columns)])
    prices = developer_prices(units, items, ["developer_key"])
    return profile(items, ["developer_key"]).join(head, "developer_key").join(n, "developer_key", "left").join(prices, "developer_key", "left").withColumn("compound_count", F.coalesce("compound_count", F.lit(0)))


def districts(resale: DataFrame, compound_rows: DataFrame) -> DataFrame:
    """A row for each district with resale units."""
    from .entities import vote

    items = resale.withColumn("district_key", T.slug(F.col("district")))
    inside = compound_rows.groupBy("district_key").agg(F.count(F.lit(1)).alias("compound_count"))
    out = profile(items, ["district_key"]).join(vote(items, "district_key", "district", [F.col("id")], "district"), "district_key", "left").join(inside, "district_key", "left")
    return out.withColumn("compound_count", F.coalesce("compound_count", F.lit(0)))


def delivery_changes(moves: DataFrame, resale: DataFrame) -> DataFrame:
    """Of each developer: dated units, and those whose latest change put delivery off or brought it forward.

    moves: property_id, captured_at, changed_fields (a map of old and new values).
    """
    m = moves.withColumn("c", F.try_element_at("changed_fields", F.lit("delivery_date"))).where("c.old IS NOT NULL AND c.new IS NOT NULL")
    m = m.groupBy("property_id").agg(F.max_by(F.when(F.col("c.new") > F.col("c.old"), 1).when(F.col("c.new") < F.col("c.old"), -1).otherwise(0), "captured_at").alias("move"))
    items = resale.where("developer_key <> ''").join(m.withColumnRenamed("property_id", "id"), "id", "left")
    return items.groupBy("developer_key").agg(F.count("delivery_date").alias("tracked_units"), F.expr("count_if(move = 1)").alias("postponed"), F.expr("count_if(move = -1)").alias("brought_forward"))


def observed(rows: DataFrame, primary: tuple[str, ...]) -> DataFrame:
    """One row: how many records there are, and when they were seen."""
    a = rows.agg(F.count_if(~F.col("source").isin(*primary)).alias("total_records"), F.max("last_seen_at").alias("last_updated"), F.min("first_seen_at").alias("first_observed"))
    days = F.date_diff(F.to_date("last_updated"), F.to_date("first_observed")) + 1
    return a.withColumns({"observation_days": F.coalesce(days, F.lit(0)), "history_ready": F.coalesce(days >= HISTORY_DAYS, F.lit(False))})


def plan_discount() -> Column:
    """The median discount of payment plans: of resale units as they are, before any comparison."""
    return median("discount", 4, "terms = 'plan'").alias("plan_median_discount")


def overview(rows: DataFrame, records: DataFrame, resale: DataFrame, primary: tuple[str, ...]) -> DataFrame:
    """One row of counts, medians and dates of everything."""
    like = "launch_same_finishing"
    b = records.agg(F.count(F.lit(1)).alias("total_eligible"))
    c = resale.agg(
        F.count(F.lit(1)).alias("total_resale"), F.expr("count_if(level <> 'unrated')").alias("rated_count"), *(F.count_if(F.col("level") == v).alias(v) for v in LEVELS),
        *(F.count_if(F.col("terms") == t).alias(f"terms_{t}") for t in ("plan", "cash", "partial", "unknown")), plan_discount(),
        F.count_if(like).alias("compared"), median("launch_gap", 4, like).alias("median_gap"), F.count("peer_gap").alias("ranked"), F.count("launch_contract_annual").alias("since_units"),
        median("launch_contract_annual", 4).alias("since_median"),
    )
    return observed(rows, primary).join(F.broadcast(b)).join(F.broadcast(c))  # three tables of one row


def source_rows(rows: DataFrame, resale: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each source: rows, resale and rated units, the latest observation, the status of the last run."""
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.max("last_seen_at").alias("last_seen"))
    r = resale.groupBy("source").agg(F.count(F.lit(1)).alias("resale_count"), F.expr("count_if(level <> 'unrated')").alias("rated_count"))
    s = runs.groupBy("source").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"))
    out = n.join(r, "source", "left").join(s, "source", "left")
    return out.select("source", "rows", "last_seen", F.coalesce("resale_count", F.lit(0)).alias("resale_count"), F.coalesce("rated_count", F.lit(0)).alias("rated_count"), F.coalesce("status", F.lit("unknown")).alias("status"))


def unique_urls(records: DataFrame) -> DataFrame:
    """url_key and id of links that only one listing has."""
    k = records.select("id", T.url_key(F.col("source_url")).alias("url_key")).where("url_key IS NOT NULL")
    return k.groupBy("url_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
