"""Listings out of search results: JSON items, cards with microdata, and the pages behind them. All of it native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import posted_at

#: An item of a page of search results. The names of its fields.
ITEM = "struct<id:string,title:string,price_amount:string,price_currency_iso:string,cps:array<string>,highlights:string,masked_description:string,city_label:string,nhood_label:string,phone_number:string,posted_at:string,image_uri:string,post_url:string>"
# Attributes in an item's list, and facts that a card's text states in fixed words.
_ATTRIBUTE = {"bedrooms": r"(?i)(\d+)\s*bed", "bathrooms": r"(?i)(\d+)\s*bath", "area_m2": r"(?i)([\d,]+(?:\.\d+)?)\s*m2", "finishing": r"(?i)(semi furnished|unfurnished|furnished)"}
_ROOMS, _DOWN, _MONTHS = r"(\d+)\s*غرف", r"(?:مقدم|دفعة أولى)[^0-9]{0,20}([\d,]+)", r"على\s*(\d+)\s*شهر"
_IN_PARTS, _NEGOTIABLE, _DOWN_WORD = "بالتقسيط", "قابل للتفاوض", "مقدم"
NO_SIGNAL = "no resale signals in title/attributes"


def items(pages: DataFrame, body: str = "body") -> DataFrame:
    """page_id and an item for each element of a page's JSON list; a page that is no list gives nothing."""
    return pages.select("page_id", F.explode(F.from_json(body, f"array<{ITEM}>")).alias("i"))


def item_listings(found: DataFrame, now: Column, link: str = "https://www.example.com/", image: str = "https://images.example.com/") -> DataFrame:
    """A listing for each item with an id: highlights first, the attribute list where they are silent."""
    i = lambda c: F.col(f"i.{c}")
    d = T.computed(found.where("i.id IS NOT NULL"), {"cps": F.array_join(i("cps"), " | "), "h": T.highlights(i("highlights"))})
    attribute = lambda c: T.or_null(F.regexp_extract("cps", _ATTRIBUTE[c], 1))
    first = lambda c, kind: F.coalesce(F.nullif(F.col(f"h.{c}").cast(kind), F.lit(0).cast(kind)), F.regexp_replace(attribute(c), ",", "").try_cast(kind))
    evidence = T.resale_evidence(F.concat_ws(" ", i("title"), T.or_null(F.col("cps"))))
    return d.select(
        i("id").alias("source_listing_id"), F.when(T.or_null(i("post_url")).isNotNull(), F.concat(F.lit(link), i("post_url"))).alias("url"), i("title").alias("title"), i("masked_description").alias("description"),
        F.lit("sale").alias("purpose"), F.when(evidence.isNotNull(), True).alias("is_resale"), F.coalesce(evidence, F.lit(NO_SIGNAL)).alias("resale_evidence"), T.parse_number(i("price_amount")).alias("price"),
        F.coalesce(T.or_null(i("price_currency_iso")), F.lit("EGP")).alias("currency"), first("area_m2", "double").alias("area_m2"), first("bedrooms", "int").alias("bedrooms"), first("bathrooms", "int").alias("bathrooms"),
        F.regexp_replace(F.lower(attribute("finishing")), " ", "_").alias("finishing"), T.or_null(F.lower(i("city_label"))).alias("city"), i("nhood_label").alias("district"), F.lit("unknown").alias("seller_type"),
        i("phone_number").alias("phone"), posted_at(i("posted_at"), now).alias("posted_at"), F.when(T.or_null(i("image_uri")).isNotNull(), F.array(F.concat(F.lit(image), i("image_uri"), F.lit(".webp")))).otherwise(F.array().cast("array<string>")).alias("images"),
    )


def stated(text: Column) -> dict[str, Column]:
    """What a card's text states: bedrooms (20 at most), finishing, down payment, months of a plan, whether there is one, whether the price is open."""
    t = T.western_digits(text)
    number = lambda p: T.or_null(F.regexp_extract(t, p, 1))
    rooms, down, months = number(_ROOMS).try_cast("int"), T.parse_number(number(_DOWN)), number(_MONTHS).try_cast("int")
    return {
        "bedrooms": F.when(rooms <= 20, rooms), "finishing": T.finishing(t), "down_payment": down, "installment_months": months,
        "is_installment": F.coalesce(down.isNotNull() | months.isNotNull() | F.contains(t, F.lit(_IN_PARTS)), F.lit(False)), "price_negotiable": F.coalesce(F.contains(t, F.lit(_NEGOTIABLE)), F.lit(False)),
    }


def cards(pages: DataFrame, start: str = r'<(?:article|li|div)[^>]*class="[^"]*card') -> DataFrame:
    """page_id, place and the markup of each card of a page: what stands between one start and the next."""
    parts = F.split("html", f"(?={start})")
    c = pages.select("page_id", F.posexplode(parts).alias("place", "card"))
    return c.where(F.col("card").rlike(f"^{start}"))


def _prop(name: str) -> tuple[Column, Column]:
    """The content attribute and the visible text of an element with an itemprop."""
    attribute = F.coalesce(T.or_null(F.regexp_extract("card", rf'itemprop="{name}"[^>]*\bcontent="([^"]*)"', 1)), T.or_null(F.regexp_extract("card", rf'content="([^"]*)"[^>]*itemprop="{name}"', 1)))
    inner = F.regexp_extract("card", rf'(?s)itemprop="{name}"[^>]*>(.*?)</', 1)
    return attribute, T.or_null(T.squeeze(F.regexp_replace(inner, "<[^>]*>", " ")))


def card_listings(found: DataFrame, id_pattern: str = r"/(\d+)") -> DataFrame:
    """A listing for each card with a link that has an id. A shown price that is called a down payment is one, unless it is the whole price."""
    link = F.regexp_extract("card", r'<a[^>]*class="[^"]*card-link[^"]*"[^>]*href="([^"]*)"', 1)
    c = found.withColumn("url", T.or_null(link)).withColumn("source_listing_id", T.or_null(F.regexp_extract("url", id_pattern, 1))).where("source_listing_id IS NOT NULL")
    shown = T.or_null(T.squeeze(F.regexp_replace(F.regexp_extract("card", r'(?s)<span[^>]*class="price[^"]*"[^>]*>(.*?)</span>', 1), "<[^>]*>", " ")))
    c = T.computed(c, {
        "title": _prop("name")[1], "description": _prop("description")[0], "district": _prop("addressRegion")[1], "locality": _prop("addressLocality")[1], "price": T.parse_number(_prop("price")[0]), "shown": shown,
        "rooms": _prop("numberOfRooms")[1].try_cast("int"), "area_m2": T.parse_number(_prop("value")[1]), "image": T.or_null(F.regexp_extract("card", r'<img[^>]*itemprop="image"[^>]*src="([^"]*)"', 1)),
        "rent": F.col("card").rlike(r'businessFunction"[^>]*href="[^"]*#LeaseOut"'), "schema_type": T.or_null(F.lower(F.regexp_extract("card", r'itemtype="[^"]*/([^"/]+)"', 1))),
    })
    c = T.computed(c, {f"s_{k}": v for k, v in stated(F.col("description")).items()} | {"by_down": F.coalesce(F.contains("shown", F.lit(_DOWN_WORD)), F.lit(False))})
    c = c.withColumn("down_payment", F.coalesce(F.nullif(F.when(F.col("by_down"), T.parse_number(F.col("shown"))), F.lit(0.0)), F.col("s_down_payment")))
    c = c.withColumn("down_payment", F.when(~F.coalesce(F.col("down_payment") >= F.col("price"), F.lit(False)), F.col("down_payment")))
    evidence = F.when(~F.col("rent"), T.resale_evidence(F.concat_ws(" ", "title", "description")))
    return c.select(
        "source_listing_id", "url", "title", "description", F.when(F.col("rent"), "rent").otherwise("sale").alias("purpose"), F.coalesce(T.property_type(F.col("title")), "schema_type").alias("property_type"),
        F.when(evidence.isNotNull(), True).alias("is_resale"), F.coalesce(evidence, F.when(F.col("rent"), "rent listing"), F.lit("no resale signals in title/description")).alias("resale_evidence"), "price", F.lit("EGP").alias("currency"),
        F.col("s_price_negotiable").alias("price_negotiable"), (F.col("by_down") | F.col("s_is_installment")).alias("is_installment"), "down_payment", F.col("s_installment_months").alias("installment_months"),
        F.col("s_finishing").alias("finishing"), "area_m2", F.coalesce("rooms", "s_bedrooms").alias("bedrooms"), "district", T.governorate(F.col("locality")).alias("governorate"),
        T.seller_type(F.col("description")).alias("seller_type"), F.array_compact(F.array("image")).alias("images"),
    )


def with_detail(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Listings with the phone and the price of their page's JSON-LD (pages: source_listing_id, html), where it has them."""
    ld = F.regexp_extract("html", r'(?s)<script type="application/ld\+json">\s*(\{.*?\})\s*</script>', 1)
    d = pages.select("source_listing_id", ld.alias("ld"))
    phone = F.coalesce(F.get_json_object("ld", "$.offers.seller.telephone"), F.get_json_object("ld", "$.telephone"))
    d = d.select("source_listing_id", phone.alias("d_phone"), T.parse_number(F.coalesce(F.get_json_object("ld", "$.offers.price"), F.get_json_object("ld", "$.price"))).alias("d_price"))
    j = listings.join(d, "source_listing_id", "left")
    old = F.col("phone") if "phone" in listings.columns else F.lit(None).cast("string")
    return j.withColumns({"phone": F.coalesce("d_phone", old), "price": F.coalesce("d_price", "price")}).drop("d_phone", "d_price")


def offers(pages: DataFrame) -> DataFrame:
    """source_listing_id and what a page's list of label and value pairs says of a unit."""
    pair = F.regexp_extract_all("html", F.lit(r'(?s)product-offer-item[^>]*>(.*?)</li>'), F.lit(1))
    text = lambda x, tag: T.squeeze(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " "))
    m = F.map_from_entries(F.filter(F.transform(pair, lambda x: F.struct(F.lower(text(x, "strong")).alias("k"), text(x, "small").alias("v"))), lambda e: e["k"] != ""))
    p = T.computed(pages, {"o": m})
    of = lambda k: F.try_element_at("o", F.lit(k))
    count = lambda k: F.nullif(T.parse_number(of(k)).cast("int"), F.lit(0))
    plan = F.when(of("method payment").isNotNull(), F.contains(F.lower(of("method payment")), F.lit("installment"))).when(of("down payment").isNotNull(), True)
    return p.select(
        "source_listing_id", T.parse_number(of("area")).alias("area_m2"), count("bedrooms").alias("bedrooms"), count("bathrooms").alias("bathrooms"), T.parse_number(of("down payment")).alias("down_payment"), plan.alias("is_installment"),
        F.regexp_replace(F.lower(of("finishing")), " ", "_").alias("finishing"), of("delivery date").alias("delivery_status"),
    )


def merged(listings: DataFrame, detail: DataFrame) -> DataFrame:
    """Listings whose fields take what their own page says, where it says something."""
    fields = [c for c in detail.columns if c != "source_listing_id"]
    j = listings.join(detail.select("source_listing_id", *(F.col(c).alias(f"d_{c}") for c in fields)), "source_listing_id", "left")
    for c in fields:
        j = j.withColumn(c, F.coalesce(f"d_{c}", c) if c in listings.columns else F.col(f"d_{c}")).drop(f"d_{c}")
    return j


def newest(inventory: DataFrame, budget: int) -> DataFrame:
    """The entries of an inventory that a run reads: those of the highest ids, as many as its budget has."""
    return inventory.orderBy(F.desc(F.col("id").cast("long"))).limit(budget)


def with_hints(listings: DataFrame, hub: DataFrame, evidence: str) -> DataFrame:
    """Listings of unknown kind that a hub page lists are resales; what is known stays."""
    j = listings.join(hub.select("source_listing_id").distinct().withColumn("hint", F.lit(True)), "source_listing_id", "left")
    use = F.col("is_resale").isNull() & F.col("hint")
    use = F.coalesce(use, F.lit(False))
    return j.withColumns({"is_resale": F.when(use, True).otherwise(F.col("is_resale")), "resale_evidence": F.when(use, evidence).otherwise(F.col("resale_evidence"))}).drop("hint")


def detail_facts(pages: DataFrame, labels: dict[str, str], text: str = "text") -> DataFrame:
    """A listing's figures out of label and value lines; the price is what is paid now and what is still owed, and a bare year of delivery ends in June."""
    from .pages import facts

    p = T.computed(pages, {"f": facts(F.col(text), labels)})
    number = lambda c: T.parse_number(F.col(f"f.{c}")) if c in labels else F.lit(None).cast("double")
    year = F.regexp_extract("f.delivery", r"(20[0-4][0-9])", 1) if "delivery" in labels else F.lit("")
    price = F.coalesce(number("cash_now") + number("balance"), number("cash_now"), number("price"))
    return p.select("source_listing_id", price.alias("price"), number("area").alias("area_m2"), number("cash_now").alias("down_payment"), F.when(year != "", F.concat(year, F.lit("-06-30"))).alias("delivery_date"))


def broken_paging(pages: DataFrame) -> DataFrame:
    """Of each run, its first page that lists what the page before listed (run_id, page, ids)."""
    w = Window.partitionBy("run_id").orderBy("page")
    same = pages.withColumn("before", F.lag("ids").over(w)).where(F.col("before") == F.col("ids"))
    return same.groupBy("run_id").agg(F.min("page").alias("page"))
