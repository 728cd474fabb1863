"""Listings out of stored pages: embedded JSON, JSON-LD, sitemaps, cards, label and value pairs."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T

#: A unit as sites embed it in their pages.
UNIT = "struct<id:bigint,name:string,property_type:string,min_price:double,area:double,bedrooms:int,bathrooms:int,finishing:string,ready_by:string,compound:string,developer:string,area_name:string,plans:array<struct<price:double,down_payment:double,years:double,cash:boolean,instalment:double>>>"


def embedded_json(html: Column, element: str = "__NEXT_DATA__") -> Column:
    """The text of the script element with an id."""
    return T.or_null(F.regexp_extract(html, rf'(?s)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1))


def units_of(pages: DataFrame, path: str = "$.props.pageProps.units") -> DataFrame:
    """page_id and a unit for each element of the embedded list; a page without one gives nothing."""
    units = F.from_json(F.get_json_object(embedded_json(F.col("html")), path), f"array<{UNIT}>")
    return pages.select("page_id", F.explode(units).alias("unit"))


def listing_of(unit: str = "unit", primary: bool = False) -> list[Column]:
    """Columns of a listing: the plan of the least price; instalments where it is not cash and has a payment."""
    plan = F.element_at(F.array_sort(F.col(f"{unit}.plans"), lambda a, b: F.when(a["price"] < b["price"], -1).when(a["price"] > b["price"], 1).otherwise(0)), 1)
    plan = F.when(F.size(f"{unit}.plans") > 0, plan)
    split = ~F.coalesce(plan["cash"], F.lit(False)) & plan["instalment"].isNotNull()
    return [
        F.col(f"{unit}.id").cast("string").alias("source_listing_id"), F.coalesce(plan["price"], F.col(f"{unit}.min_price")).alias("price"), F.col(f"{unit}.area").alias("area_m2"),
        T.property_type(F.col(f"{unit}.property_type")).alias("property_type"), F.col(f"{unit}.bedrooms").alias("bedrooms"), split.alias("is_installment"),
        F.when(split, plan["down_payment"]).alias("down_payment"), F.when(split, F.bround(plan["years"] * 12).cast("int")).alias("installment_months"),
        delivery_date(F.col(f"{unit}.ready_by")).alias("delivery_date"), F.col(f"{unit}.compound").alias("compound"), F.col(f"{unit}.developer").alias("developer"),
        F.when(F.lit(primary), False).otherwise(F.lit(None).cast("boolean")).alias("is_resale"),
    ]


def delivery_date(value: Column) -> Column:
    day = T.or_null(F.regexp_extract(value, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    return F.when(F.substring(day, 1, 4).cast("int").between(2000, 2040), day)


def sitemap(xml: DataFrame, least: int = 100) -> DataFrame:
    """id and lastmod of each entry of sitemaps (column xml); fewer than `least` entries in all are an error."""
    entry = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    e = xml.select(entry.alias("e")).select(F.regexp_extract("e", r"<loc>\s*[^<]*?([^/<\s]+)/?\s*</loc>", 1).alias("id"), T.or_null(F.regexp_extract("e", r"<lastmod>\s*([^<\s]+)", 1)).alias("lastmod"))
    e = e.where("id <> ''").groupBy("id").agg(F.max("lastmod").alias("lastmod"))
    if least and e.limit(least).count() < least:
        raise ValueError("a sitemap this short is truncated")
    return e


def posted_at(text: Column, now: Column) -> Column:
    """The time of "n minutes / hours / days / weeks / months / years ago" (English or Arabic)."""
    n = F.coalesce(T.or_null(F.regexp_extract(T.western_digits(text), r"[0-9]+", 0)).cast("int"), F.lit(1))
    unit = F.when(text.rlike("(?i)minute|دقيق"), 60).when(text.rlike("(?i)hour|ساع"), 3600).when(text.rlike("(?i)week|أسبوع|اسبوع|أسابيع"), 604800).when(text.rlike("(?i)month|شهر|أشهر"), 2592000)
    unit = unit.when(text.rlike("(?i)year|سنة|سنوات"), 31536000).when(text.rlike("(?i)day|يوم|أيام"), 86400)
    return F.timestamp_seconds(now.cast("long") - n * unit)


def flags_by_position(html: DataFrame, flag: str, listing: str) -> DataFrame:
    """page_id, listing_id and the flag that stands before it: each flag goes to the next listing, a listing keeps its first.

    flag and listing are patterns with one group each; matches are merged in the order in
    which they stand in the page.
    """
    both = f"(?:{flag})|(?:{listing})"
    m = html.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(both), F.lit(0))).alias("pos", "m"))
    m = m.select("page_id", "pos", T.or_null(F.regexp_extract("m", flag, 1)).alias("flag"), T.or_null(F.regexp_extract("m", listing, 1)).alias("listing_id"))
    w = Window.partitionBy("page_id").orderBy("pos")
    m = m.withColumn("before", F.lag("flag").over(w)).where("listing_id IS NOT NULL AND before IS NOT NULL")
    return m.groupBy("page_id", "listing_id").agg(F.min_by("before", "pos").alias("flag"))


def same_as_before(pages: DataFrame) -> DataFrame:
    """Pages of a run whose listings are those of the page before: broken paging."""
    w = Window.partitionBy("run_id").orderBy("page")
    return pages.withColumn("repeats", F.coalesce(F.col("signature") == F.lag("signature").over(w), F.lit(False)))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.found = {"title": "", "heading": "", "text": [], "links": [], "jsonld": []}
        self.script = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.found["links"].append(a["href"])
        self.script = (a.get("type") or "") if tag == "script" else self.script
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        self.script = None if tag == "script" else self.script

    def handle_data(self, data):
        at = self.stack[-1] if self.stack else ""
        if at == "script":
            if self.script and "ld+json" in self.script:
                self.found["jsonld"].append(data)
        elif at == "title":
            self.found["title"] += data
        elif at == "h1":
            self.found["heading"] += data
        elif at not in ("style",) and data.strip():
            self.found["text"].append(data.strip())


_PAGE = StructType([StructField(n, IntegerType() if n == "n_links" else StringType()) for n in ("title", "heading", "text", "n_links", "jsonld")])


@pandas_udf(_PAGE)
def parse_page(html: pd.Series) -> pd.DataFrame:
    """What a page says: title, heading, visible text, number of links, first JSON-LD object."""
    rows = []
    for h in html:
        p = _Page()
        p.feed(h or "")
        f = p.found
        rows.append((f["title"].strip(), f["heading"].strip(), "\n".join(f["text"]), len(f["links"]), next((j for j in f["jsonld"] if _is_json(j)), None)))
    return pd.DataFrame(rows, columns=["title", "heading", "text", "n_links", "jsonld"])


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def facts(text: Column, labels: dict[str, str]) -> Column:
    """field → value of lines "label: value" (labels: field → pattern of its label)."""
    return F.struct(*(T.or_null(F.trim(F.regexp_extract(text, rf"(?m)^\s*(?:{re.sub(r'[()]', '', p)})\s*:\s*(.*)$", 1))).alias(f) for f, p in labels.items()))


def page_listings(pages: DataFrame) -> DataFrame:
    """page_id, url_key, title, heading, words, links, phone of each page."""
    p = pages.select("page_id", T.url_key(F.col("url")).alias("url_key"), parse_page(F.col("html")).alias("p"))
    return p.select("page_id", "url_key", T.clean_plain(F.col("p.title")).alias("title"), T.clean_plain(F.col("p.heading")).alias("heading"), F.size(F.split(F.col("p.text"), r"\s+")).alias("words"), F.col("p.n_links").alias("n_links"), T.phone(F.col("p.text")).alias("phone"))
