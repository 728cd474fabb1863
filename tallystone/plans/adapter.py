"""The driver's tables as listings, launch units, run logs and change logs: the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suppliers that are broadcast.
SUPPLIERS = 500_000

#: All observations are at most this old; days count back from here.
LATEST = "2001-08-01"

COLUMNS = (
    "id", "source", "source_listing_id", "scope_key", "url", "title", "description", "purpose", "property_type", "is_resale",
    "resale_evidence", "price", "currency", "is_installment", "down_payment", "installment_months", "area_m2", "bedrooms",
    "bathrooms", "finishing", "delivery_status", "delivery_date", "compound", "developer", "city", "district", "images",
    "contract_year", "status", "first_seen_at", "last_seen_at",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each order with lines; see LISTING_SQL for the same in SQL."""
    t = lambda n: table(spark, sf_dir, n)
    flag = F.col("l_returnflag")
    # The least flag as a number: its first letter, and whether more follows. Numbers are aggregated by hashing, texts only by sorting.
    li = t("lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("partkey"), F.min("l_suppkey").alias("suppkey"), F.sum("l_quantity").alias("area"),
        F.max("l_linenumber").alias("ln"), F.max(F.col("l_discount") + 0.0).alias("disc"), F.min(F.ascii(flag) * 2 + (F.length(flag) > 1).cast("int")).alias("rf"),
        F.max("l_shipdate").alias("ship"),
    )
    # Orders cross the network with numbers only: names of nations come after the joins, the columns of parts with the last one.
    supplier = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("s_nation"))
    supplier = F.broadcast(supplier) if supplier.limit(SUPPLIERS + 1).count() <= SUPPLIERS else supplier
    customer = t("customer").select("c_custkey", F.col("c_nationkey").alias("c_nation"))
    o = t("orders").withColumn("first", F.substring("o_orderpriority", 1, 1)).drop("o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.join(supplier, F.col("suppkey") == F.col("s_suppkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("l_orderkey", "suppkey", "s_suppkey", "o_custkey", "c_custkey")
    o = o.join(t("part"), F.col("partkey") == F.col("p_partkey"))
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    of_customer = nation.join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nation"), F.col("n_name").alias("dist"), F.col("r_name").alias("reg"))
    o = o.join(F.broadcast(nation.select(F.col("n_nationkey").alias("s_nation"), F.col("n_name").alias("dev"))), "s_nation").join(F.broadcast(of_customer), "c_nation")  # 25 rows each
    i, first = F.col("o_orderkey"), F.col("first")
    price = F.bround(F.col("o_totalprice") * 60)
    plan = F.col("o_orderstatus").isin("O", "P")
    compound = F.concat("p_brand", F.lit(" "), "reg", F.when(i % 97 == 0, " Phase 2").otherwise(""))
    source = F.when(first.isin("1", "2"), "classified").when(first == "3", "contract").otherwise("portal")
    kind = F.expr("map('STANDARD', 'apartments', 'ECONOMY', 'studio', 'MEDIUM', 'apartment', 'PROMO', 'chalet', 'LARGE', 'villa', 'SMALL', 'office')[p_type]")
    day = lambda n: F.date_sub(F.lit(LATEST).cast("date"), n.cast("int")).cast("timestamp")
    null = lambda kind: F.lit(None).cast(kind)
    return o.select(
        i.alias("id"), source.alias("source"), i.cast("string").alias("source_listing_id"), F.concat("reg", F.lit("/"), "p_type").alias("scope_key"),
        F.concat(F.lit("https://www.example.com/unit/"), (i - F.when(i % 50 == 1, 1).otherwise(0)).cast("string"), F.lit("/?ref=x")).alias("url"),
        F.concat("p_name", F.lit(" in "), compound).alias("title"), F.concat(F.lit("<p>"), "p_name", F.lit("</p> call 01012345678")).alias("description"),
        F.lit("sale").alias("purpose"), kind.alias("property_type"),
        F.when(i % 20 == 0, null("boolean")).otherwise(i % 20 != 1).alias("is_resale"), F.when(i % 20 > 1, "owner").alias("resale_evidence"),
        price.alias("price"), F.when(i % 333 == 5, "USD").otherwise("EGP").alias("currency"), plan.alias("is_installment"),
        F.when(plan & ~((F.col("o_orderstatus") == "P") & (i % 4 == 0)), price * (0.1 + F.col("disc"))).alias("down_payment"),
        F.when(plan, 12 * F.col("ln")).cast("int").alias("installment_months"), F.col("area").alias("area_m2"),
        (i % 6).cast("int").alias("bedrooms"), (i % 4 + 1).cast("int").alias("bathrooms"),
        F.expr("map(130, 'lux', 156, 'semi_finished', 164, '-')[rf]").alias("finishing"), F.when(i % 9 == 0, "ready").alias("delivery_status"),
        F.when(i % 9 != 0, F.date_add(F.col("ship").cast("date"), (30 * (i % 60)).cast("int")).cast("string")).alias("delivery_date"),
        compound.alias("compound"), F.concat("dev", F.lit(" Developments")).alias("developer"), F.col("reg").alias("city"), F.col("dist").alias("district"),
        F.lit("[]").alias("images"), F.when(source == "contract", F.year("o_orderdate").cast("string")).alias("contract_year"),
        F.when(i % 25 == 0, "removed").otherwise("active").alias("status"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), day(i % 20).alias("last_seen_at"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A developer's unit for each part, as a listing of the source "benchmark"."""
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("p_partkey") % 5)
    k = F.col("p_partkey")
    area = (10 + 4 * F.col("p_size")).cast("double")
    price = F.bround(F.col("p_retailprice") * 150 * area)
    kind = F.expr("map('STANDARD', 'apartments', 'ECONOMY', 'studio', 'MEDIUM', 'apartment', 'PROMO', 'chalet', 'LARGE', 'villa', 'SMALL', 'office')[p_type]")
    have = {
        "id": k + 100_000_000, "source": F.lit("benchmark"), "source_listing_id": k.cast("string"), "scope_key": F.col("r_name"), "purpose": F.lit("sale"),
        "property_type": kind, "is_resale": F.lit(False), "price": price, "currency": F.lit("EGP"), "is_installment": F.lit(True),
        "down_payment": price * (0.05 + (k % 4) * 0.05), "installment_months": (12 * (5 + k % 6)).cast("int"), "area_m2": area,
        "finishing": F.when(k % 3 == 0, "semi_finished").otherwise("finished"), "delivery_date": F.concat((2002 + k % 4).cast("string"), F.lit("-06-30")),
        "compound": F.concat("p_brand", F.lit(" "), "r_name", F.when(k % 11 == 0, " New Phase").otherwise("")), "developer": F.concat(F.lit("NATION_"), (k % 25).cast("string"), F.lit(" Group")),
        "district": F.col("r_name"), "title": F.col("p_name"), "images": F.lit("[]"), "status": F.lit("active"),
        "first_seen_at": F.lit(LATEST).cast("timestamp"), "last_seen_at": F.lit(LATEST).cast("timestamp"),
    }
    kinds = {"bedrooms": "int", "bathrooms": "int"}
    return p.select(*(have.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in COLUMNS))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl run for each event."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.when(i % 7 < 4, "completed").when(i % 7 == 4, "partial").when(i % 7 == 5, "failed").otherwise("running")
    return e.select(
        i.alias("id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(status != "running", F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        status.alias("status"), F.floor("value").alias("seen"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("scope"),
    )


_KIND = "CASE p_type WHEN 'STANDARD' THEN 'apartments' WHEN 'ECONOMY' THEN 'studio' WHEN 'MEDIUM' THEN 'apartment' WHEN 'PROMO' THEN 'chalet' WHEN 'LARGE' THEN 'villa' ELSE 'office' END"

LISTING_SQL = rf"""
li AS (SELECT l_orderkey, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey, sum(l_quantity) AS area, max(l_linenumber) AS ln,
         max(l_discount + 0.0) AS disc, min(l_returnflag) AS rf, max(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey),
raw0 AS (SELECT o.o_orderkey AS id, o.*, li.*, p.*, sn.n_name AS dev, cn.n_name AS dist, r.r_name AS reg,
         p.p_brand || ' ' || r.r_name || CASE WHEN o.o_orderkey % 97 = 0 THEN ' Phase 2' ELSE '' END AS compound,
         round_even(o.o_totalprice * 60, 0) AS price, {_KIND} AS kind
       FROM orders o JOIN li ON li.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = li.partkey
       JOIN supplier s ON s.s_suppkey = li.suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
       JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = cn.n_regionkey),
listing AS (SELECT id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'classified' WHEN o_orderpriority[1] = '3' THEN 'contract' ELSE 'portal' END AS source,
         CAST(id AS VARCHAR) AS source_listing_id, reg || '/' || p_type AS scope_key,
         'https://www.example.com/unit/' || CAST(id - CASE WHEN id % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) || '/?ref=x' AS url,
         p_name || ' in ' || compound AS title, '<p>' || p_name || '</p> call 01012345678' AS description, 'sale' AS purpose, kind AS property_type,
         CASE WHEN id % 20 = 0 THEN NULL ELSE id % 20 <> 1 END AS is_resale, price,
         CASE WHEN id % 333 = 5 THEN 'USD' ELSE 'EGP' END AS currency, o_orderstatus IN ('O', 'P') AS is_installment,
         CASE WHEN o_orderstatus IN ('O', 'P') AND NOT (o_orderstatus = 'P' AND id % 4 = 0) THEN price * (0.1 + disc) END AS down_payment,
         CASE WHEN o_orderstatus IN ('O', 'P') THEN 12 * ln END AS installment_months, area AS area_m2, id % 6 AS bedrooms, id % 4 + 1 AS bathrooms,
         CASE rf WHEN 'A' THEN 'lux' WHEN 'N' THEN 'semi_finished' ELSE '-' END AS finishing, CASE WHEN id % 9 = 0 THEN 'ready' END AS delivery_status,
         CASE WHEN id % 9 <> 0 THEN CAST(CAST(ship AS DATE) + CAST(30 * (id % 60) AS INTEGER) AS VARCHAR) END AS delivery_date,
         compound, dev || ' Developments' AS developer, reg AS city, dist AS district,
         CASE WHEN o_orderpriority[1] = '3' THEN year(o_orderdate) END AS contract_year,
         CASE WHEN id % 25 = 0 THEN 'removed' ELSE 'active' END AS status, o_orderdate AS first_seen_at,
         CAST(DATE '{LATEST}' - CAST(id % 20 AS INTEGER) AS TIMESTAMP) AS last_seen_at FROM raw0),
launch0 AS (SELECT p_partkey + 100000000 AS id, {_KIND} AS kind, (10 + 4 * p_size) * 1.0::DOUBLE AS area_m2, p_partkey AS k,
         round_even(p_retailprice * 150 * CAST(10 + 4 * p_size AS DOUBLE), 0) AS price, p_brand || ' ' || r_name || CASE WHEN p_partkey % 11 = 0 THEN ' New Phase' ELSE '' END AS compound
       FROM part JOIN region ON r_regionkey = p_partkey % 5)"""

RUNS_SQL = """
runs AS (SELECT event_id AS id, event_type AS source, ts AS started_at,
         CASE WHEN event_id % 7 < 6 THEN ts + INTERVAL 10 MINUTE END AS finished_at,
         CASE WHEN event_id % 7 < 4 THEN 'completed' WHEN event_id % 7 = 4 THEN 'partial' WHEN event_id % 7 = 5 THEN 'failed' ELSE 'running' END AS status,
         CAST(floor(value) AS BIGINT) AS seen, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS VARCHAR) AS scope FROM events)"""
