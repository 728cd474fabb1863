"""A registry of sources and the contract of a run: rows, and whether they are all there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Run:
    """What a source read: its rows, the scopes read to their end, the ids present without being read, and errors."""

    rows: DataFrame
    complete: bool = True
    scopes_completed: tuple[str, ...] = ()
    present: DataFrame | None = None
    errors: tuple[str, ...] = field(default=())


_SOURCES: dict[str, Callable[..., Run]] = {}


def register(name: str):
    """Adds a function (spark, **params) → Run under a name."""

    def add(read: Callable[..., Run]):
        _SOURCES[name] = read
        return read

    return add


def names() -> list[str]:
    return sorted(_SOURCES)


def read(spark: SparkSession, name: str, **params) -> Run:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; known: {', '.join(names())}")
    return _SOURCES[name](spark, **params)


def manifest(spark: SparkSession, run: Run, source: str) -> DataFrame:
    """The row that closes a run: what it saw, whether its scopes are all there, which of them ended."""
    n = run.rows.agg(F.count(F.lit(1)).alias("seen"), F.count_distinct("source_listing_id").alias("n_distinct")) if "source_listing_id" in run.rows.columns else run.rows.agg(F.count(F.lit(1)).alias("seen"), F.count(F.lit(1)).alias("n_distinct"))
    text = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return n.select(F.lit(source).alias("source"), "seen", "n_distinct", F.lit(run.complete).alias("complete"), text(run.errors).alias("errors"), F.lit(False).alias("crashed"), text(run.scopes_completed).alias("scopes_completed"))


@register("pages")
def _pages(spark: SparkSession, path: str, **_) -> Run:
    from .pages import page_listings

    return Run(page_listings(spark.read.parquet(path)))


@register("embedded")
def _embedded(spark: SparkSession, path: str, primary: bool = False, **_) -> Run:
    """Pages with units in a script element; a scope is complete when its last page has none."""
    from .pages import listing_of, units_of

    return Run(units_of(spark.read.parquet(path)).select(*listing_of(primary=primary)))


@register("results")
def _results(spark: SparkSession, path: str, now: str = "1970-01-01", pages: int = 50, **_) -> Run:
    """Pages of search results as JSON lists; as many pages as the cap mean that the rest was not read."""
    from .cards import item_listings, items

    df = spark.read.parquet(path)
    cut = df.agg(F.count_distinct("page_id").alias("n")).first()["n"] >= pages
    return Run(item_listings(items(df), F.lit(now).cast("timestamp")), complete=not cut, errors=("page cap reached",) if cut else ())


@register("cards")
def _cards(spark: SparkSession, path: str, **_) -> Run:
    from .cards import card_listings, cards

    return Run(card_listings(cards(spark.read.parquet(path))))


@register("catalogue")
def _catalogue(spark: SparkSession, path: str, details: str, budget: int = 100, **_) -> Run:
    """Cards, then the pages of as many as the budget has."""
    from .cards import card_listings, cards, merged, offers

    rows = card_listings(cards(spark.read.parquet(path)))
    wanted = rows.select("source_listing_id").distinct().orderBy("source_listing_id").limit(budget)
    return Run(merged(rows, offers(spark.read.parquet(details).join(wanted, "source_listing_id", "left_semi"))))


@register("inventory")
def _inventory(spark: SparkSession, path: str, details: str, budget: int = 200, least: int = 100, **_) -> Run:
    """A sitemap's newest entries with their pages; every entry is present, read or not."""
    from .cards import newest, offers
    from .pages import sitemap

    entries = sitemap(spark.read.parquet(path), least)
    ids = newest(entries, budget).select(F.col("id").alias("source_listing_id"))
    return Run(offers(spark.read.parquet(details).join(ids, "source_listing_id", "left_semi")), present=entries.select(F.col("id").alias("source_listing_id")))


@register("microdata")
def _microdata(spark: SparkSession, path: str, details: str, **_) -> Run:
    """Cards with microdata, and the structured data of each one's own page where that was read."""
    from .cards import card_listings, cards, with_detail

    return Run(with_detail(card_listings(cards(spark.read.parquet(path))), spark.read.parquet(details)))


@register("hinted")
def _hinted(spark: SparkSession, path: str, details: str, hub: str, budget: int = 200, least: int = 100, evidence: str = "listed on a resale page", **_) -> Run:
    """A sitemap's newest entries with their pages; those that a hub page lists are resales, and every entry is present."""
    from .cards import newest, offers, with_hints
    from .pages import sitemap

    entries = sitemap(spark.read.parquet(path), least)
    ids = newest(entries, budget).select(F.col("id").alias("source_listing_id"))
    rows = offers(spark.read.parquet(details).join(ids, "source_listing_id", "left_semi"))
    rows = rows.withColumns({"is_resale": F.lit(None).cast("boolean"), "resale_evidence": F.lit(None).cast("string")})
    return Run(with_hints(rows, spark.read.parquet(hub), evidence), present=entries.select(F.col("id").alias("source_listing_id")))


from .stored import ListingSource  # noqa: E402, F401  (the stored-page format is part of this registry)
