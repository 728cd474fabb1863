"""Which listings count, and what of them is published."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as T

PRICE, AREA, UNCONFIRMED_DAYS = (100_000, 200_000_000), (20, 5_000), 14


@dataclass(frozen=True)
class Roles:
    """What a source's listings mean: no plan is a cash price; prices of a first sale; prices of the original contract."""

    cash: tuple[str, ...] = ("portal", "contract", "benchmark")
    primary: tuple[str, ...] = ("benchmark",)
    contract: tuple[str, ...] = ("contract",)
    names: dict[str, str] = field(default_factory=dict)


def known_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The named columns; those that df lacks are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def eligible(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Active sales in EGP with a plausible price and area, a type and a place. Invalid optional fields become null.

    Texts are cleaned and figures read once for a row; what follows reads the results.
    """
    rows = rows.where((F.col("status") == "active") & (F.col("purpose") == "sale") & (F.upper("currency") == "EGP"))
    texts = ("property_type", "district", "compound", "finishing", "developer", "delivery_status", "source", "title")
    out = T.computed(rows, {"t": T.clean_texts(*(F.col(c) for c in texts)), "price": T.number(F.col("price"), *PRICE), "area_m2": T.number(F.col("area_m2"), *AREA)})
    out = out.where("price IS NOT NULL AND area_m2 IS NOT NULL")
    text = {c: F.get("t", F.lit(k)) for k, c in enumerate(texts)}
    out = T.computed(out, {
        "property_type": T.canonical_type(text["property_type"]), "district": T.canonical_district(F.coalesce(text["district"], text["compound"])), "finishing_class": T.finishing_class(text["finishing"]),
        "source": F.coalesce(F.substring(text["source"], 1, 32), F.lit("unknown")), "installment_months": F.nullif(T.integer(F.col("installment_months"), 360), F.lit(0)),
        "down_payment": T.number(F.col("down_payment"), 0, F.col("price")), "installments": F.when(F.col("is_installment"), F.lit(True)), "year": F.col("contract_year").cast("string").substr(1, 4).try_cast("int"),
    }).where("property_type IS NOT NULL AND district IS NOT NULL")
    date = F.when(F.col("delivery_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring("delivery_date", 1, 10))
    terms = M.payment_terms(F.col("price"), F.col("down_payment"), F.col("installment_months"), F.col("installments"), F.col("source").isin(*roles.cash))
    out = T.computed(out, {"payment": terms})
    return out.select(
        "id", "source", T.safe_url(F.col("url")).alias("source_url"), F.substring(text["title"], 1, 300).alias("title"), "property_type",
        T.property_class(F.col("property_type")).alias("class"), "price", "area_m2", F.bround(F.col("price") / F.col("area_m2")).alias("price_per_m2"),
        T.integer(F.col("bedrooms"), 12).alias("bedrooms"), T.integer(F.col("bathrooms"), 12).alias("bathrooms"),
        "district", text["compound"].alias("compound_name"), text["developer"].alias("developer_name"),
        text["finishing"].alias("finishing"), "finishing_class", text["delivery_status"].alias("delivery_status"),
        date.alias("delivery_date"), "installments", "down_payment", "installment_months", "is_resale",
        F.when(F.col("source").isin(*roles.contract) & F.col("year").between(2000, 2100), F.col("year")).alias("contract_year"), "first_seen_at", "last_seen_at",
        T.photo_urls(F.col("images")).alias("images"), "payment.*",
    )


def confirmed(df: DataFrame, days: int = UNCONFIRMED_DAYS) -> DataFrame:
    """Without listings not seen for `days` before their source's latest observation; unknown times stay."""
    gap = F.col("source_latest").cast("long") - F.col("last_seen_at").cast("long")
    return df.where(F.coalesce(gap < days * 86400, F.lit(True)))


def without_hidden(df: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Without listings whose price is flagged as a down payment."""
    return df.join(enrichments.where(F.array_contains("flags", "price_is_down_payment")).select(F.col("property_id").alias("id")), "id", "left_anti")


def unknowns(compound_key="compound_key", developer_key="developer_key", bucket="delivery_bucket"):
    """What a comparison cannot see, in a fixed order; the last four no source publishes."""
    missing = F.array(
        F.when(F.col("terms") == "unknown", "payment_terms"), F.when(F.col("terms") == "partial", "installment_term"),
        F.when(F.coalesce(F.col(compound_key), F.lit("")) == "", "compound"), F.when(F.coalesce(F.col(developer_key), F.lit("")) == "", "developer"),
        F.when(F.col("finishing_class") == "unknown", "finishing"), F.when(F.col(bucket) == "unknown", "delivery"),
    )
    return F.concat(F.array_compact(missing), F.array(*map(F.lit, ("floor_and_view", "legal_status", "transfer_fee", "maintenance_deposit"))))
