"""Filtered, ranked pages of units and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as T
from .compare import ranking

RANK_MIN = {"compound": 5, "developer": 20}


def within(price_max=None, cash_max=None, signing_max=None, area_min=None, area_max=None, bedrooms_min=None, delivery: str = "", newer_than=None) -> Column:
    """A buyer's limits; a figure that is not published meets none."""
    out = F.lit(True)
    limits = (
        (F.col("price"), price_max, "<="), (F.col("cash_equivalent"), cash_max, "<="), (M.signing(F.col("price"), F.col("remaining")), signing_max, "<="), (F.col("area_m2"), area_min, ">="),
        (F.col("area_m2"), area_max, "<="), (F.col("bedrooms"), bedrooms_min, ">="), (F.col("id"), newer_than, ">"),
    )
    for value, limit, sign in limits:
        if limit is not None:
            out = out & F.coalesce(value <= limit if sign == "<=" else value >= limit if sign == ">=" else value > limit, F.lit(False))
    if delivery:
        soon = F.lit(False) if delivery == "ready" else F.coalesce(F.substring("delivery_date", 1, 4) <= delivery, F.lit(False))
        out = out & ((F.col("delivery_bucket") == "ready") | soon)
    return out


def order_of(sort: str) -> list[Column]:
    """The total order of a sort: ties go by id."""
    ids = F.asc("id")
    return {
        "opportunity": ranking(), "launch_gap": [F.asc("launch_gap"), ids], "peer_gap": [F.asc("peer_gap"), ids], "cash_ppm_asc": [F.col("cash_equivalent") / F.col("area_m2"), ids],
        "newest": [F.desc("id")], "price_asc": [F.asc("price"), ids], "price_desc": [F.desc("price"), ids], "area_desc": [F.desc("area_m2"), ids],
    }[sort]


def unit_query(units: DataFrame, *, resale: bool = True, q: str = "", district: str = "", compound: str = "", developer: str = "", property_type: str = "", level: str = "", terms: str = "", source: str = "", launch: bool = False, sort: str = "opportunity", **limits) -> DataFrame:
    """The units that a request asks for, in order (page_of cuts a page)."""
    u = units.where("is_resale") if resale else units
    if q.strip():
        u = u.where(T.matches(q, *(F.col(c) for c in ("title", "district", "compound_name", "developer_name", "compound", "developer"))))
    if district.strip():
        u = u.where(T.slug(F.col("district")) == T.slug(F.lit(district)))
    if compound.strip():
        u = u.where(F.col("compound_key") == T.slug(F.lit(compound)))
    if developer.strip():
        u = u.where((F.col("developer_key") == developer.strip()) | (F.col("developer_key") == T.developer_key(F.lit(developer))))
    for column, value in (("property_type", property_type.strip().lower()), ("level", level), ("terms", terms), ("source", source.strip().lower())):
        if value:
            u = u.where(F.col(column) == value)
    if launch or sort == "launch_gap":
        u = u.where("launch_gap IS NOT NULL")
    if any(v not in (None, "") for v in limits.values()):
        u = u.where(within(**limits))
    if sort == "launch_gap":
        u = u.where("level <> 'check' AND launch_same_finishing")
    elif sort == "peer_gap":
        u = u.where("level <> 'check' AND peer_gap IS NOT NULL")
    elif sort == "cash_ppm_asc":
        u = u.where("coalesce(cash_equivalent, 0) <> 0")
    return u.orderBy(*order_of(sort))


def page_of(df: DataFrame, page: int, size: int) -> DataFrame:
    """One page of an ordered table: the feature is the limit."""
    return df.offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def entity_query(entities: DataFrame, kind: str, *, q: str = "", district: str = "", developer: str = "", sort: str = "units") -> DataFrame:
    """Compounds or developers in order; sorts by gap leave out those with too few compared units."""
    key = f"{kind}_key"
    e = entities
    if q.strip():
        e = e.where(T.matches(q, *(F.col(c) for c in ("compound", "district", "developer") if c in e.columns)))
    if district.strip():
        e = e.where(F.col("district_key") == T.slug(F.lit(district)))
    if developer.strip():
        e = e.where(F.col("developer_key") == developer.strip())
    if sort.startswith("gap"):
        e = e.where((F.col("compared") >= RANK_MIN[kind]) & F.col("median_gap").isNotNull())
    base = [F.desc("units"), F.asc(key)]
    first = {"units": [], "name": [F.lower(F.col(kind))], "opportunities": [F.desc("good_count")], "gap_asc": [F.asc("median_gap")], "gap_desc": [F.desc("median_gap")]}[sort]
    return e.orderBy(*first, *base)


def lookup_url(urls: DataFrame, url: str) -> DataFrame:
    return urls.where(F.col("url_key") == T.url_key(F.lit(url)))


def newer(units: DataFrame, seen: int) -> DataFrame:
    """How many units came after the newest that a saved search has seen."""
    return units.where(F.col("id") > seen).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("newest"))
