"""Page readers and the stream of listings."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallystone.sources import cards, pages, readers
from tallystone.streaming import upserts


def test_embedded_units(spark):
    unit = {"id": 7, "property_type": "Twin House", "min_price": 5.0, "area": 100.0, "ready_by": "2027-05-01T00:00", "compound": "C", "plans": [{"price": 9.0, "years": 2.0, "down_payment": 1.0, "instalment": 3.0}, {"price": 8.0, "cash": True}]}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"units": [unit]}}})}</script>'
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string")
    rows = pages.units_of(df).select("page_id", *pages.listing_of()).collect()
    assert len(rows) == 1 and (rows[0].price, rows[0].property_type, rows[0].is_installment, rows[0].delivery_date) == (8.0, "twinhouse", False, "2027-05-01")


def test_sitemap(spark):
    xml = "".join(f"<url><loc>https://a.com/u/{i}</loc><lastmod>2026-01-0{i % 9 + 1}</lastmod></url>" for i in range(120))
    assert pages.sitemap(spark.createDataFrame([(xml,)], "xml string")).count() == 120
    with pytest.raises(ValueError):
        pages.sitemap(spark.createDataFrame([("<url><loc>https://a.com/1</loc></url>",)], "xml string"))


def test_flags_go_to_the_next_listing(spark):
    df = spark.createDataFrame([(1, 'id=5 flag=true id=6 id=7 flag=false id=6 flag=true id=8')], "page_id long, html string")
    got = {r.listing_id: r.flag for r in pages.flags_by_position(df, "flag=(true|false)", r"id=(\d+)").collect()}
    assert got == {"6": "true", "8": "true"}


def test_relative_times(spark):
    now = datetime.datetime(2026, 1, 10, 12, tzinfo=datetime.timezone.utc)
    df = spark.createDataFrame([("3 hours ago",), ("منذ 2 يوم",), ("nothing",)], "t string").select(pages.posted_at(F.col("t"), F.lit(now)).alias("at"))
    assert [r.at and r.at.hour for r in df.collect()] == [9, 12, None]


def test_page_parts(spark):
    html = '<html><head><title>T &amp; U</title><style>x</style></head><body><h1>H</h1><p>call 01012345678</p><a href="/x">l</a></body></html>'
    r = pages.page_listings(spark.createDataFrame([(1, "https://www.a.com/p/", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0].url_key, r[0].title, r[0].heading, r[0].n_links, r[0].phone) == ("a.com/p", "T & U", "H", 1, "01012345678")
    assert r[1].title is None


def test_registry():
    assert "pages" in readers.names()


SCHEMA = "source string, source_listing_id string, scope_key string, status string, price double, title string, first_seen_at timestamp, last_seen_at timestamp"
T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def seen(i, price, day, status="active"):
    return ("s", str(i), "a", status, price, "x", T0, T0, T0 + datetime.timedelta(days=day))


def test_stream_of_listings(spark, tmp_path):
    with_time = SCHEMA + ", observed_at timestamp"
    empty = spark.createDataFrame([], SCHEMA)
    for rows in ([seen(1, 1.0, 0), seen(2, 2.0, 0)], [seen(2, 3.0, 1), seen(3, 1.0, 1)]):
        spark.createDataFrame(rows, with_time).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(with_time).parquet(f"{tmp_path}/in")
        upserts.start(stream, f"{tmp_path}/out", empty, buckets=4).awaitTermination()
    assert {r.source_listing_id: r.price for r in upserts.state_of(spark, f"{tmp_path}/out", empty).collect()} == {"1": 1.0, "2": 3.0, "3": 1.0}
    kinds = sorted(r.change_type for r in spark.read.schema("change_type string").parquet(f"{tmp_path}/out/versions").collect())
    assert kinds == ["created", "created", "created", "updated"]


def test_batches_empty_repeated_and_partly_touched(spark, tmp_path):
    with_time = SCHEMA + ", observed_at timestamp"
    empty, path = spark.createDataFrame([], SCHEMA), f"{tmp_path}/out"
    batch = lambda *rows: spark.createDataFrame(list(rows), with_time)
    state = lambda: {r.source_listing_id: r.price for r in upserts.state_of(spark, path, empty).collect()}
    upserts.fold(batch(), 0, path, empty, 8)
    assert state() == {}
    upserts.fold(batch(*(seen(i, 1.0, 0) for i in range(20))), 1, path, empty, 8)
    upserts.fold(batch(), 2, path, empty, 8)
    upserts.fold(batch(seen(3, 9.0, 2)), 3, path, empty, 8)
    upserts.fold(batch(seen(3, 7.0, 2)), 3, path, empty, 8)  # came again: it was committed already
    assert state() == {str(i): 9.0 if i == 3 else 1.0 for i in range(20)}
    assert {n for n in upserts._listed(spark, f"{path}/state", "epoch")} == {1, 3}
    upserts.fold(batch(*(seen(i, 2.0, 4) for i in range(20))), 4, path, empty, 8)
    upserts.fold(batch(seen(1, 2.0, 5)), 5, path, empty, 8)
    assert upserts._listed(spark, f"{path}/state", "epoch") == [4, 5] and state() == {str(i): 2.0 for i in range(20)}


def test_end_of_a_scope_removes_what_it_did_not_see(spark, tmp_path):
    schema = SCHEMA + ", observed_at timestamp, end_of_scope boolean, scope_started timestamp"
    empty, path = spark.createDataFrame([], SCHEMA), f"{tmp_path}/out"
    row = lambda r, end=False, start=None: (*r, end, start)
    upserts.fold(spark.createDataFrame([row(seen(i, 1.0, 0)) for i in range(4)], schema), 0, path, empty, 4)
    mark = ("s", None, "a", None, None, None, None, None, T0 + datetime.timedelta(days=3), True, T0 + datetime.timedelta(days=2))
    upserts.fold(spark.createDataFrame([row(seen(1, 1.0, 2)), mark], schema), 1, path, empty, 4)
    assert {r.source_listing_id: r.status for r in upserts.state_of(spark, path, empty).collect()} == {"0": "removed", "1": "active", "2": "removed", "3": "removed"}
    kinds = sorted(r.change_type for r in spark.read.parquet(f"{path}/versions/epoch=1").collect())
    assert kinds == ["removed"] * 3


def test_stale_listings(spark, tmp_path):
    schema = "source string, source_listing_id string, observed_at timestamp"
    days = [("s", "1", 0), ("s", "2", 0), ("s", "2", 10), ("s", "3", 30)]
    for k, (a, b, d) in enumerate(days):
        spark.createDataFrame([(a, b, T0 + datetime.timedelta(days=d))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = upserts.stale(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("append").format("parquet")
        q.option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.source_listing_id, r.last_seen.day) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("1", 1), ("2", 11)]


def test_items_of_results(spark):
    items = [{"id": 5, "title": "Villa resale", "price_amount": "1,200,000", "cps": ["3 Bedrooms", "2 Baths", "1,050 m2", "Semi Furnished"], "highlights": "4 Bedrooms", "city_label": "Cairo", "posted_at": "2 days ago", "image_uri": "a/b"}, {"title": "no id"}]
    df = spark.createDataFrame([(1, json.dumps(items)), (2, "<html>")], "page_id long, body string")
    r = cards.item_listings(cards.items(df), F.lit(T0)).collect()
    assert len(r) == 1 and (r[0].price, r[0].bedrooms, r[0].bathrooms, r[0].area_m2, r[0].finishing, r[0].is_resale, r[0].city, r[0].posted_at.day) == (1_200_000.0, 4, 2, 1050.0, "semi_furnished", True, "cairo", 30)


def test_what_a_card_states(spark):
    text = "شقة للبيع، ٣ غرف، بالتقسيط متشطب سوبر لوكس . مقدم دفعة أولى 600,000 جنيه على 36 شهر قابل للتفاوض"
    r = spark.createDataFrame([(text,), (None,), ("25 غرف",)], "t string").select(F.struct(*(v.alias(k) for k, v in cards.stated(F.col("t")).items())).alias("s")).collect()
    assert r[0].s.asDict() == {"bedrooms": 3, "finishing": "super_lux", "down_payment": 600_000.0, "installment_months": 36, "is_installment": True, "price_negotiable": True}
    assert not r[1].s.is_installment and r[1].s.bedrooms is None and r[2].s.bedrooms is None


def test_details_merge_into_listings(spark):
    rows = spark.createDataFrame([("1", 5.0, None), ("2", 6.0, 70.0)], "source_listing_id string, price double, area_m2 double")
    pages = spark.createDataFrame([("1", '<li class="product-offer-item"><strong>Area</strong><small>80 m2</small></li><li class="product-offer-item"><strong>Down Payment</strong><small>1,000</small></li>')], "source_listing_id string, html string")
    got = {r.source_listing_id: (r.area_m2, r.down_payment, r.is_installment) for r in cards.merged(rows, cards.offers(pages)).collect()}
    assert got == {"1": (80.0, 1000.0, True), "2": (70.0, None, None)}
    facts = cards.detail_facts(spark.createDataFrame([("1", "Paid: 100\nOwed: 900\nHandover: 2027")], "source_listing_id string, text string"), {"cash_now": "Paid", "balance": "Owed", "delivery": "Handover"}).first()
    assert (facts.price, facts.down_payment, facts.delivery_date) == (1000.0, 100.0, "2027-06-30")
    broken = cards.broken_paging(spark.createDataFrame([("r", 1, "a,b"), ("r", 2, "c"), ("r", 3, "c"), ("q", 1, "a")], "run_id string, page int, ids string")).collect()
    assert [(b.run_id, b.page) for b in broken] == [("r", 3)]


def test_page_files_by_the_data_source_interface(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.jsonl").write_text("".join(json.dumps({"page_id": 10 * k + i, "html": "<h1>x</h1>"}) + "\n" for i in range(k + 1)))
    spark.dataSource.register(readers.ListingSource)
    assert sorted(r.page_id for r in spark.read.format("listing_pages").option("path", str(tmp_path)).load().collect()) == [0, 10, 11, 20, 21, 22]


def test_runs_of_sources(spark, tmp_path):
    items = json.dumps([{"id": i, "title": "x", "price_amount": "5"} for i in range(3)])
    spark.createDataFrame([(k, items) for k in range(4)], "page_id long, body string").write.parquet(f"{tmp_path}/r")
    run = readers.read(spark, "results", path=f"{tmp_path}/r", pages=4)
    m = readers.manifest(spark, run, "results").first()
    assert (m.seen, m.n_distinct, m.complete, m.errors) == (12, 3, False, ["page cap reached"])
    assert readers.read(spark, "results", path=f"{tmp_path}/r").complete
