"""Column functions against values worked out by hand."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tallystone import catalog
from tallystone.functions import money as M
from tallystone.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_keys(spark):
    assert values(spark, T.slug, ["Palm Hills  New-Cairo", "كمبوند باديا", None, "--"]) == ["palm-hills-new-cairo", "كمبوند-باديا", "", ""]
    assert values(spark, T.developer_key, ["Nile Developments", "NILE (Egypt) Group", "طلعت مصطفى", "TMG", None, "Group"]) == ["nile", "nile", "talaatmoustafa", "talaatmoustafa", "", "group"]
    assert values(spark, T.fold, ["Compound The Brooks", "أبراج", "ابراج", None]) == ["thebrooks", "ابراج", "ابراج", ""]
    assert values(spark, lambda c: T.alias_key(c, F.lit("Nile Group")), ["Garden", "project"]) == ["garden|nile", None]
    assert values(spark, T.canonical_district, ["fifth  settlement", "Somewhere", None]) == ["New Cairo", "Somewhere", None]


def test_numbers(spark):
    assert values(spark, T.parse_number, ["4,900,000 EGP", "٢٥٠ متر", "none", None]) == [4_900_000.0, 250.0, None, None]
    assert values(spark, T.parse_count, ["3 Bedrooms", "غرفتين", "ثلاث غرف", ""]) == [3, 2, 3, None]
    assert values(spark, lambda c: T.number(c, 0, 10), ["5", "11", "x", "NaN", None]) == [5.0, None, None, None, None]
    assert values(spark, lambda c: T.integer(c, 12), ["3", "3.5", "13"]) == [3, None, None]


def test_words(spark):
    assert values(spark, T.property_type, ["Twin House", "penthouse", "شقة للبيع", "car", None]) == ["twinhouse", "penthouse", "apartment", None, None]
    assert values(spark, T.finishing, ["Super Lux", "semi finished", "x"]) == ["super_lux", "semi_finished", None]
    assert values(spark, T.seller_type, ["by developer and broker", "by owner", "agent"]) == ["developer", "owner", "broker"]
    assert values(spark, T.resale_evidence, ["a resale unit", "presales"]) == ["keyword 'resale'", None]
    row = one(spark, h=T.highlights(F.lit("2 Bedrooms » 3 Bathrooms » 130 m2"))).h
    assert (row.bedrooms, row.bathrooms, row.area_m2) == (2, 3, 130.0)


def test_clean_text(spark):
    got = values(spark, T.clean_text, ["<b>Tom &amp; Ann</b>", "call 010 1234 5678 now", " N/A ", None, "a\x07b"])
    assert got == ["Tom & Ann", "call [contact withheld] now", None, None, "ab"]


def test_texts_of_whole_pages(spark, tmp_path):
    """A title cut inside an entity: browsers still read it, the SQL of clean_text does not. Nor are addresses mobile numbers there."""
    texts = ["a &amp b &amp", "Tom &amp; Ann &ampx; &quot;q&quot; &middot; &#65;&#x42; &notit;", "a &amp;quot; b", "from 15.176.73.203 on"]
    assert values(spark, T.clean_text, texts)[0] == "a & b &"
    assert values(spark, lambda c: T.clean_text(c, closed=True), texts) == ["a &amp b &amp", 'Tom & Ann &ampx; "q" · AB &notit;', "a &quot; b", "from [contact withheld] on"]
    spark.createDataFrame(list(enumerate(f"<title>{t}</title>" for t in (texts[0], *texts[2:]))), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in catalog.QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    sql = catalog.SQL["clean_text"].replace("FROM pages)", f"FROM '{tmp_path}/pages.parquet/*.parquet')")
    assert got == dict(duckdb.sql(sql).fetchall())


def test_urls(spark):
    assert values(spark, T.url_key, ["https://www.Example.com/A/b/?x=1", "nonsense", None]) == ["example.com/a/b", None, None]
    assert values(spark, T.safe_url, ["https://a.com/x", "ftp://a.com", "https://u:p@a.com", "javascript:1"]) == ["https://a.com/x", None, None, None]
    assert values(spark, T.photo_urls, ['["https://a.com/1", "http://a.com/2", "https://a.com/1"]', "bad", None]) == [["https://a.com/1"], [], []]


@pytest.mark.parametrize(("months", "factor"), [(84, 0.55210), (12, 0.89346), (0, 1.0)])
def test_present_value(spark, months, factor):
    assert one(spark, f=M.present_value_factor(F.lit(months))).f == pytest.approx(factor, abs=5e-5)


def test_present_value_is_the_sum(spark):
    n = 28
    want = sum(1 / 1.2 ** (0.25 * i) for i in range(1, n + 1)) / n
    assert one(spark, f=M.present_value_factor(F.lit(84))).f == pytest.approx(want, rel=1e-12)


def test_payment_terms(spark):
    def terms(*v):
        return one(spark, t=M.payment_terms(*(F.lit(x) if x is not None else F.lit(None).cast("double") for x in v))).t

    plan = terms(1_000_000.0, 100_000.0, 84, True, True)
    assert (plan.terms, plan.remaining, plan.remaining_share, plan.years) == ("plan", 900_000, 0.9, 7.0)
    assert terms(1e6, None, 84, True, True).terms == "partial"
    assert terms(1e6, None, None, False, True).cash_equivalent == 1e6
    assert terms(1e6, None, None, False, False).terms == "unknown"


def test_delivery(spark):
    today = F.lit(datetime.date(2026, 9, 21))
    for date, status, bucket in (("2026-09-21", None, "ready"), ("2027-09-01", None, "under_1y"), ("2029-01-01", None, "2_3y"), ("2031-01-01", None, "3y_plus"), ("bad", "Ready", "ready"), (None, None, "unknown")):
        assert one(spark, d=M.delivery(F.lit(date).cast("string"), F.lit(status).cast("string"), today)).d.bucket == bucket


def test_instalment_months(spark):
    def months(*v):
        return one(spark, m=M.instalment_months(*(F.lit(x).cast("double") for x in v))).m

    assert months(7, None, None, 3) == 84
    assert months(None, 900, 100, 3) == 27
    assert months(None, 90_000, 100, 3) is None
