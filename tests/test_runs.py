"""Whole runs of sources, reports, locks; payloads parsed again, facts extracted."""

import json

import pandas as pd
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import cdc, publish
from tallystone.sources import readers, runs
from tallystone.sources.readers import Run

SCHEMA = "source string, source_listing_id string, title string, price double, scope_key string"
STATE = SCHEMA + ", status string, first_seen_at timestamp, last_seen_at timestamp, content_hash string"
OLD, START, NOW = "2026-01-01", "2026-02-01 00:00:00", "2026-02-01 01:00:00"


def stored(spark, rows):
    df = spark.createDataFrame([("s", *r, "a", status, None, None, None) for *r, status in rows], STATE)
    return df.withColumns({"first_seen_at": F.lit(OLD).cast("timestamp"), "last_seen_at": F.lit(OLD).cast("timestamp"), "content_hash": cdc.content_hash(df)})


def test_a_whole_run(spark):
    state = stored(spark, [("1", "t", 1.0, "active"), ("2", "t", 2.0, "active"), ("3", "t", 3.0, "removed"), ("4", "t", 4.0, "active"), ("5", "t", 5.0, "active")])
    rows = spark.createDataFrame([("1", "t", 1.0, "a", 0), ("2", "t", 2.5, "a", 1), ("3", "t", 3.0, "a", 2), ("6", "t", 6.0, "a", 3), ("2", "t", 2.0, "a", 4)], "source_listing_id string, title string, price double, scope_key string, arrival int")
    present = spark.createDataFrame([("4",)], "source_listing_id string")
    run = Run(rows, complete=True, scopes_completed=("a",), present=present)
    out = runs.run_source("s", run, state, START, NOW, batch=2)
    assert {r.source_listing_id: (r.status, r.price) for r in out.state.collect()} == {"1": ("active", 1.0), "2": ("active", 2.0), "3": ("active", 3.0), "4": ("active", 4.0), "5": ("removed", 5.0), "6": ("active", 6.0)}
    assert sorted((r.source_listing_id, r.change_type) for r in out.versions.collect()) == [("2", "updated"), ("2", "updated"), ("3", "relisted"), ("5", "removed"), ("6", "created")]
    r = out.run.first()
    assert (r.status, r.seen, r.created, r.updated, r.relisted, r.unchanged, r.removed) == ("completed", 5, 1, 2, 1, 1, 1)


def test_a_budget_ends_a_run_early(spark):
    now = [0.0]

    def clock():
        now[0] += 40
        return now[0]

    state = stored(spark, [("1", "t", 1.0, "active"), ("9", "t", 9.0, "active")])
    rows = spark.createDataFrame([(str(k), "t", float(k), "a", k) for k in range(6)], "source_listing_id string, title string, price double, scope_key string, arrival int")
    out = runs.run_source("s", Run(rows, True, ("a",)), state, START, NOW, batch=2, minutes=1, clock=clock)
    r = out.run.first()
    assert (r.status, r.seen, r.removed, list(r.errors)) == ("partial", 4, 0, ["time budget of 1 min reached"])
    assert out.state.count() == 5 and out.state.where("status = 'removed'").count() == 0
    nothing = runs.run_source("s", Run(rows.limit(0), False, (), errors=("blocked",)), state, START, NOW)
    assert nothing.run.first().status == "failed" and nothing.state.count() == 2 and nothing.versions.count() == 0


def test_one_writer_and_a_report(spark, tmp_path):
    with runs.only_writer(spark, str(tmp_path), "s") as a, runs.only_writer(spark, str(tmp_path), "s") as b, runs.only_writer(spark, str(tmp_path), "t") as c:
        assert (a, b, c) == (True, False, True)
    with runs.only_writer(spark, str(tmp_path), "s") as again:
        assert again
    for n in (3, 1):
        runs.report({"health": spark.range(n).withColumn("name", F.lit("é"))}, f"{tmp_path}/r.json")
    with open(f"{tmp_path}/r.json", encoding="utf-8") as f:
        assert json.load(f) == {"health": [{"id": 0, "name": "é"}]}


def test_payloads_parsed_again(spark):
    state = stored(spark, [("1", "t", 1.0, "active"), ("2", "t", 2.0, "active"), ("3", "t", 3.0, "removed")]).withColumn("raw", F.when(F.col("source_listing_id") != "3", F.concat(F.lit("price="), F.col("source_listing_id"))))

    def parse(frame):
        out = pd.DataFrame({"source": frame["source"], "source_listing_id": frame["source_listing_id"], "title": "t", "price": frame["raw"].str.slice(6).astype(float)})
        return out.assign(price=out["price"] * out["source_listing_id"].map({"1": 1.0, "2": 10.0}))

    got = {r.source_listing_id: (r.price, r.changed, str(r.last_seen_at)[:10]) for r in cdc.renormalize(state, parse, "source string, source_listing_id string, title string, price double").collect()}
    assert got == {"1": (1.0, False, OLD), "2": (20.0, True, OLD), "3": (3.0, False, OLD)}


def test_facts_of_descriptions(spark):
    schema = SCHEMA + ", description string, down_payment double, is_installment boolean, bedrooms int"
    state = spark.createDataFrame([("s", "1", "t", 10.0, "a", "down 4 beds 3", None, False, None), ("s", "2", "t", 10.0, "a", "down 40", None, None, None), ("s", "3", "t", 10.0, "a", "beds 2", 1.0, None, 5), ("s", "4", "t", 10.0, "a", None, None, None, None)], schema)

    def extract(texts):
        number = lambda w: texts.str.extract(w + r" (\d+)")[0].astype(float)
        down = number("down")
        return pd.DataFrame({"down_payment": down, "is_installment": down.notna().map({True: True, False: None}), "bedrooms": number("beds").astype("Int32")})

    got = {r.source_listing_id: (r.down_payment, r.is_installment, r.bedrooms, r.changed) for r in cdc.backfill_extracted(state, extract, "down_payment double, is_installment boolean, bedrooms int").collect()}
    assert got == {"1": (4.0, True, 3, True), "2": (None, True, None, True), "3": (1.0, None, 5, False), "4": (None, None, None, False)}


def test_prices_resales_and_digests(spark):
    df = spark.createDataFrame([("1,200 EGP negotiable",), ("قابل للتفاوض ٣٠٠",), ("",), (None,), ("a resale, from owner",), ("0",)], "t string")
    got = [(r.p.price, r.p.negotiable, r.c.is_resale, r.c.evidence) for r in df.select(T.parse_price(F.col("t")).alias("p"), T.classify_resale(F.col("t")).alias("c")).collect()]
    assert got[:4] == [(1200.0, True, None, None), (300.0, True, None, None), (None, False, None, None), (None, False, None, None)]
    assert got[4][2:] == (True, "keyword 'resale'") and got[5][:2] == (0.0, False)
    assert [r.b for r in spark.createDataFrame([(1,), (0,), (7,), (None,)], "v int").select(T.boolean(F.col("v")).alias("b")).collect()] == [True, False, None, None]
    a = spark.range(50).withColumn("x", F.col("id") % 3)
    d = lambda df: publish.fingerprint(df).first()
    assert d(a) == d(a.repartition(3)) and d(a) != d(a.union(a.limit(1))) and d(a.union(a.limit(1)).union(a.limit(1))) != d(a) and d(a.limit(0)).n == 0


def test_readers_that_chain(spark, tmp_path):
    xml = "".join(f"<url><loc>https://a.example.com/unit/{n}</loc></url>" for n in range(1, 6))
    spark.createDataFrame([(xml,)], "xml string").write.parquet(f"{tmp_path}/map")
    page = '<li class="product-offer-item"><strong>Area</strong><small>{} m2</small></li>'
    spark.createDataFrame([(str(n), page.format(10 * n)) for n in range(1, 6)], "source_listing_id string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("4",), ("1",)], "source_listing_id string").write.parquet(f"{tmp_path}/hub")
    run = readers.read(spark, "hinted", path=f"{tmp_path}/map", details=f"{tmp_path}/pages", hub=f"{tmp_path}/hub", budget=3, least=1)
    assert sorted((r.source_listing_id, r.area_m2, r.is_resale) for r in run.rows.collect()) == [("3", 30.0, None), ("4", 40.0, True), ("5", 50.0, None)]
    assert run.present.count() == 5 and {"hinted", "microdata"} <= set(readers.names())
    card = '<article class="card"><a class="card-link" href="https://a.example.com/unit/7">x</a><meta itemprop="price" content="900"></article>'
    spark.createDataFrame([(1, card)], "page_id long, html string").write.parquet(f"{tmp_path}/cards")
    spark.createDataFrame([("7", '<script type="application/ld+json">{"offers": {"price": "950", "seller": {"telephone": "010"}}}</script>')], "source_listing_id string, html string").write.parquet(f"{tmp_path}/ld")
    r = readers.read(spark, "microdata", path=f"{tmp_path}/cards", details=f"{tmp_path}/ld").rows.first()
    assert (r.source_listing_id, r.price, r.phone) == ("7", 950.0, "010")


def test_a_run_without_a_budget_reads_the_state_once(spark, monkeypatch):
    """Whatever the size of its batches: the same state and versions as with a budget that is never spent."""
    state = stored(spark, [(str(k), "t", float(k), "removed" if k % 5 == 0 else "active") for k in range(20)])
    rows = spark.createDataFrame([(str(n * 7 % 25), "t", float(n % 4), "a" if n % 3 else None, n) for n in range(60)], "source_listing_id string, title string, price double, scope_key string, arrival int")
    calls, whole = [], runs.replay.apply
    monkeypatch.setattr(runs.replay, "apply", lambda *a, **k: (calls.append(1), whole(*a, **k))[1])
    out = []
    for minutes in (None, 1000):
        done = runs.run_source("s", Run(rows, True, ("a",)), state, START, NOW, batch=15, minutes=minutes)
        out.append((sorted(map(str, done.state.collect())), sorted(map(str, done.versions.select("source_listing_id", "change_type", "step", "changed_fields").collect())), str(done.run.collect())))
        calls.append("end")
    assert out[0] == out[1] and calls == [1, "end", 1, 1, 1, 1, "end"]
