"""What readers see: public rows, details, listings with their history, totals of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cdc import KEY

# The columns that are published of a unit; those that only its own page has; those of a stored listing.
PUBLIC = (
    "id", "source", "source_url", "title", "property_type", "class", "price", "area_m2", "price_per_m2", "bedrooms", "district", "compound", "developer", "finishing_class",
    "delivery_bucket", "delivery_date", "delivery_years", "terms", "cash_equivalent", "remaining", "years", "launch_gap", "peer_gap", "level", "score", "contract_year", "is_resale",
)
FULL = ("bathrooms", "finishing", "installments", "down_payment", "installment_months", "resale_evidence", "last_seen_at", "unknowns", "images")
LISTING = (
    "id", "source", "source_listing_id", "url", "title", "purpose", "property_type", "is_resale", "resale_evidence", "price", "currency", "area_m2", "bedrooms", "bathrooms", "finishing",
    "compound", "developer", "governorate", "city", "district", "seller_type", "phone", "posted_at", "status", "first_seen_at", "last_seen_at", "removed_at",
)
DESCRIPTION, LISTED, REMOVED = 10_000, 50, 200


def fields(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns in this order; those that df lacks are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names))


def public_unit(records: DataFrame, full: bool = False) -> DataFrame:
    """What is published of units, the first photo among it; full adds what a unit's own page shows."""
    names = [c for c in (*PUBLIC, *(FULL if full else ())) if c in records.columns]
    return records.select(*names, F.get("images", F.lit(0)).alias("photo"))


def details(records: DataFrame, listings: DataFrame, comparables: DataFrame) -> DataFrame:
    """A row for each unit: all that is published, its description, and its comparables: ids with their prices (comparable_lists), or what is made of them.

    Descriptions are read and cleaned for these units only.
    """
    text = listings.select("id", "description").join(records.select("id"), "id", "left_semi")
    text = text.select("id", T.clean_text(F.col("description"), DESCRIPTION).alias("description"))
    return public_unit(records, full=True).join(text, "id", "left").join(comparables, "id", "left")


def rehydrated(detail: DataFrame, units: DataFrame) -> DataFrame:
    """The comparables of details as rows with their public columns; one that the units lack is an error, not a gap."""
    ids = detail.select(F.col("id").alias("of"), F.posexplode("comparables").alias("position", "c")).select("of", "position", F.col("c.id").alias("id"), F.col("c.cash_ppm").alias("cash_ppm"))
    joined = ids.join(public_unit(units).withColumn("known", F.lit(True)), "id", "left")
    return joined.withColumn("id", F.when(F.col("known"), F.col("id")).otherwise(F.raise_error(F.lit("a comparable is missing from the units")).cast("long"))).drop("known")


def late(keys: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """A page's rows with wide columns that were not read to find the page. keys: one page, in order."""
    w = Window.orderBy(F.monotonically_increasing_id())
    placed = keys.select(key, F.row_number().over(w).alias("place"))
    return documents.join(F.broadcast(placed), key).orderBy("place")  # a page is small by what it is


def entity_links(records: DataFrame, compounds: DataFrame, developers: DataFrame) -> DataFrame:
    """Of each unit, how many units its compound and its developer have."""
    c = compounds.select("compound_key", F.col("units").alias("compound_units"))
    d = developers.select("developer_key", F.col("units").alias("developer_units"))
    return records.select("id", "compound_key", "developer_key").join(c, "compound_key", "left").join(d, "developer_key", "left")


def one(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key: none where there is none."""
    return df.where(F.col(key) == F.lit(value))


def status_table(listings: DataFrame, runs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Of each source: its last run, and its listings by status."""
    n = listings.groupBy("source").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("active", "removed")))
    last = runs.groupBy("source").agg(F.max_by(F.struct("started_at", "status", "seen"), F.struct("started_at", "id")).alias("r")).select("source", F.col("r.started_at").alias("last_run"), F.col("r.status").alias("last_status"), F.col("r.seen").alias("seen"))
    out = n.join(last, "source", "full_outer")
    out = out if names is None else names.select("source").distinct().join(out, "source", "left")
    return out.select("source", "last_run", "last_status", "seen", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("removed", F.lit(0)).alias("removed"))


def listing_page(listings: DataFrame, source=None, status: str = "active", city=None, min_price=None, max_price=None, since: Column | None = None, resale: bool = False, limit: int = LISTED, order: str = "last_seen_at") -> DataFrame:
    """Stored listings by what a reader asks for, the latest first."""
    q = listings
    q = q.where(F.col("source") == source) if source else q
    q = q.where(F.col("status") == status) if status != "all" else q
    q = q.where(F.col("city").ilike(f"%{city}%")) if city else q
    q = q.where(F.col("price") >= min_price) if min_price is not None else q
    q = q.where(F.col("price") <= max_price) if max_price is not None else q
    q = q.where(F.col(order) >= since) if since is not None else q
    q = q.where("is_resale") if resale else q
    return fields(q.orderBy(F.desc(order), "id").limit(limit), LISTING)


def removed_listings(listings: DataFrame, since: Column | None = None, source=None, limit: int = REMOVED, order: str = "last_seen_at") -> DataFrame:
    """What disappeared from its source, the latest first."""
    q = listings.where("status = 'removed'")
    q = q.where(F.col(order) >= since) if since is not None else q
    q = q.where(F.col("source") == source) if source else q
    return fields(q.orderBy(F.desc(order), "id").limit(limit), LISTING)


def history(versions: DataFrame) -> DataFrame:
    """Each version of a listing in order, with the names of the fields that changed."""
    names = F.array_join(F.array_sort(F.map_keys("changed_fields")), ", ")
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("captured_at", "change_type"))
    return versions.select(*KEY, at.alias("step"), "captured_at", "change_type", F.coalesce(names, F.lit("-")).alias("changed"))


def sync_stats(actions: DataFrame, removed: DataFrame) -> DataFrame:
    """Of each source, what a run did: seen, created, updated, unchanged, relisted, marked_removed."""
    kinds = ("created", "updated", "unchanged", "relisted")
    a = actions.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), *(F.count_if(F.col("action") == k).alias(k) for k in kinds))
    r = removed.groupBy("source").agg(F.count(F.lit(1)).alias("marked_removed"))
    out = a.join(r, "source", "full_outer")
    return out.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", *kinds, "marked_removed")))


def known_versions(state: DataFrame) -> DataFrame:
    """source, source_listing_id and the version that a site gave of each active listing (lastmod in its raw payload)."""
    return state.where("status = 'active'").select(*KEY, F.get_json_object("raw", "$.lastmod").alias("lastmod"))


def photos_to_check(state: DataFrame, checked: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Active listings without photos that were not looked at yet: first those of `order` (id, rank), then the newest."""
    none = F.coalesce(F.size(F.from_json("images", "array<string>")), F.lit(0)) <= 0
    todo = state.where((F.col("status") == "active") & none).join(checked.select(*KEY), KEY, "left_anti")
    todo = todo.withColumn("rank", F.lit(None).cast("long")) if order is None else todo.join(order.select("id", F.col("rank").cast("long")), "id", "left")
    return todo.select("id", *KEY, "rank").orderBy(F.asc_nulls_last("rank"), F.desc("id"))


def lowest(figures: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Marks the lowest known figure of each row of a comparison, where there are two different ones at least."""
    g = figures.groupBy(*keys).agg(F.min(value).alias("least"), F.count_distinct(value).alias("kinds"))
    return figures.join(g, keys).withColumn("is_lowest", F.coalesce((F.col("kinds") > 1) & (F.col(value) == F.col("least")), F.lit(False))).drop("least", "kinds")
