"""Operators on small tables, against results worked out by hand or by plain Python."""

import datetime
import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tallystone.operators import cdc, clean, compare, entities, health, model, publish, rollup, search
from tallystone.plans.snapshot import Snapshot
from tallystone.plans.storage import saver

SEEN = datetime.datetime(2026, 9, 21, tzinfo=datetime.timezone.utc)
RAW = (
    "id long, source string, source_listing_id string, scope_key string, url string, title string, property_type string, price double, currency string, area_m2 double, status string, purpose string, "
    "is_installment boolean, down_payment double, installment_months int, bedrooms int, bathrooms int, finishing string, delivery_status string, delivery_date string, compound string, developer string, "
    "district string, is_resale boolean, images string, contract_year string, first_seen_at timestamp, last_seen_at timestamp"
)


def listing(i, **over):
    base = dict(
        id=i, source="portal", source_listing_id=str(i), scope_key="s", url=f"https://a.com/{i}", title=f"unit {i}", property_type="Apartment", price=6e6, currency="EGP", area_m2=120.0, status="active",
        purpose="sale", is_installment=False, down_payment=None, installment_months=None, bedrooms=2, bathrooms=2, finishing="lux", delivery_status=None, delivery_date="2025-01-01", compound="Garden",
        developer="Nile Developments", district="New Cairo", is_resale=True, images="[]", contract_year=None, first_seen_at=SEEN, last_seen_at=SEEN,
    )
    return base | over


def fixture_rows():
    rows = [listing(i, area_m2=100.0 + 10 * (i - 1), price=50_000 * (100 + 10 * (i - 1)) * (0.97 + 0.02 * (i % 4))) for i in range(1, 9)]
    rows += [listing(i, compound="Lake", developer="Delta", area_m2=100.0 + 10 * (i - 9), price=80_000 * (100 + 10 * (i - 9)) * (0.97 + 0.02 * (i % 4))) for i in range(9, 17)]
    rows.append(listing(17, price=35_000 * 120.0))
    rows.append(listing(18, price=9.5e6, is_installment=True, down_payment=1e6, installment_months=72))
    rows.append(listing(19, source="classified"))
    rows.append(listing(20, is_installment=True))
    rows.append(listing(21, property_type="office"))
    rows.append(listing(22, is_resale=None))
    rows.append(listing(23, price=150_000.0))
    rows += [listing(24, status="removed"), listing(25, purpose="rent"), listing(26, currency="USD"), listing(27, price=1.0), listing(28, area_m2=5.0), listing(29, compound=None, district=None)]
    rows += [listing(i, source="benchmark", compound="Garden - New Phase", is_resale=False, price=12e6, is_installment=True, down_payment=6e5, installment_months=96) for i in (31, 32)]
    return rows


@pytest.fixture(scope="module")
def snap(spark):
    raw = spark.createDataFrame([tuple(r[c.split()[0]] for c in RAW.split(", ")) for r in fixture_rows()], RAW)
    return Snapshot(raw, F.lit(SEEN.date()), save=saver(spark))


@pytest.fixture(scope="module")
def units(snap):
    return {r.id: r for r in snap.records.collect()}


def test_eligibility(snap, units):
    assert len(units) == 23 and 22 in units and not {24, 25, 26, 27, 28, 29} & set(units)
    assert snap.resale.count() == 22


def test_strong_deal(units):
    u = units[17]
    assert (u.level, u.peer_rank, u.launch_units, u.launch_plan_years) == ("strong", 2, 2, 8.0)  # only the typo is cheaper
    assert u.peer_gap == pytest.approx(-0.30, abs=0.01)


def test_levels(units):
    assert units[3].level == "in_line" and units[23].level == "check"
    assert [units[i].level for i in (19, 20, 21)] == ["unrated"] * 3
    assert units[12].peer_count == 8 and units[12].launch_gap is None
    assert units[3].launch_headline_ppm == 100_000


def test_peers_against_plain_python(units):
    pool = [u for u in units.values() if u.is_resale and u.cash_equivalent]
    for u in units.values():
        near = [p for p in pool if u.cash_equivalent and p.compound_key == u.compound_key and p.property_type == u.property_type and p.id != u.id and abs(math.log(p.area_m2 / u.area_m2)) <= math.log(1.5)]
        same = [p for p in near if p.finishing_class == u.finishing_class != "unknown"]
        near = same if len(same) >= 4 else near
        if len(near) < 4:
            assert u.peer_count is None
            continue
        own = u.cash_equivalent / u.area_m2
        ppm = [p.cash_equivalent / p.area_m2 for p in near]
        assert u.peer_count == len(near) + 1 and u.peer_rank == 1 + sum(v < own for v in ppm)
        assert u.peer_cash_gap == pytest.approx(own / statistics.median(ppm) - 1, abs=1e-4)


def test_level_rule(spark):
    """Gaps of the developer and of peers (cash, headline) → level."""
    cases = [
        ((-0.30, -0.26), (-0.20, -0.18), True, "strong"), ((-0.12, -0.11), (-0.06, -0.08), True, "good"), ((-0.15, -0.12), (0.20, 0.15), True, "mixed"),
        ((0.12, 0.15), (0.0, 0.02), True, "pricier"), ((0.02, -0.30), (0.01, 0.0), True, "in_line"), ((-0.30, -0.30), (0.0, 0.0), False, "in_line"), ((-0.75, -0.75), (0.0, 0.0), True, "check"),
    ]
    rows = [(i, max(d), d[0], d[1], same, max(p), p[0], p[1], 0.5) for i, (d, p, same, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, launch_gap double, launch_cash_gap double, launch_headline_gap double, launch_same_finishing boolean, peer_gap double, peer_cash_gap double, peer_headline_gap double, peer_cheapest_gap double")
    assert {r.id: r.level for r in compare.opportunity(df).collect()} == {i: c[3] for i, c in enumerate(cases)}


def test_freshness_and_hidden(spark):
    old = SEEN - datetime.timedelta(days=14)
    raw = spark.createDataFrame([tuple(r[c.split()[0]] for c in RAW.split(", ")) for r in (listing(1), listing(2, last_seen_at=old), listing(3), listing(4, source="other", last_seen_at=old))], RAW)
    flags = spark.createDataFrame([(3, ["price_is_down_payment"]), (4, ["x"])], "property_id long, flags array<string>")
    s = Snapshot(raw, F.lit(SEEN.date()), hidden=flags)
    assert sorted(r.id for r in s.projected.collect()) == [1, 4]


def test_comparables(snap):
    rows = compare.comparables(snap.resolved, snap.default).where("id = 21").collect()
    assert rows == []  # no other office
    near = compare.comparables(snap.resolved, snap.default).where("id = 3").orderBy("position").collect()
    area = {r.id: r.area_m2 for r in snap.resolved.collect()}
    gaps = [abs(math.log(area[r.other_id] / 120.0)) for r in near]
    assert gaps == sorted(gaps) and len(near) > 4


def test_evaluate(spark, snap):
    asks = [(0, "apartments", 120.0, 4.2e6, "garden", None, None, "", "finished"), (1, "villa", 120.0, 4.2e6, "Nowhere", None, None, "ready", ""), (2, "apartment", 120.0, 6e6, "GARDEN", 1e6, None, "2027", "finished")]
    df = spark.createDataFrame(asks, "request_id long, property_type string, area_m2 double, price double, compound string, down_payment double, installment_years double, delivery string, finishing string")
    c = snap.compounds.select(F.col("compound_key").alias("key"), F.col("compound").alias("name"), "developer_key", F.col("units").alias("position"))
    got = {r.request_id: r for r in compare.evaluate(df, c, snap.default, snap.matched, snap.today).collect()}
    assert got[0].status == "compared" and got[0].level == "strong"
    assert got[1].status == "compound_not_found" and got[1].level == "unrated"
    assert got[2].cash_equivalent == 6e6 and got[2].delivery_bucket == "under_1y"  # an incomplete plan is cash


def test_variants(spark):
    keys = [("the-brooks", 9, ["a"]), ("thebrooks", 1, ["a"]), ("the-brooks-phase-2", 1, ["a"]), ("brooks", 1, ["b"]), ("lake", 8, ["c"]), ("lake-view-two", 1, ["z"]), ("compound-lake", 1, [])]
    got = {r.key: r.target for r in entities.match_variants(spark.createDataFrame(keys, "key string, n int, developers array<string>")).collect()}
    assert got == {"thebrooks": "the-brooks", "the-brooks-phase-2": "the-brooks", "compound-lake": "lake"}


def test_vote_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "k", "b"), (2, "k", "a"), (3, "k", "a"), (4, "k", "b"), (5, "k", None)], "id long, k string, v string")
    assert entities.vote(df, "k", "v", [F.col("id")], "w").first().w == "b"


def test_aliases_share_a_name(spark):
    r = spark.createDataFrame([(1, "Garden", "Nile"), (2, "The Garden", "Nile"), (3, "somewhere nice", "Nile"), (4, "Other", None)], "id long, compound_name string, developer_name string")
    keys = [x.k for x in r.select(entities.T.alias_key(F.col("compound_name"), F.col("developer_name")).alias("k")).collect()]
    rows = [(keys[0], "done", "compound", "Garden", "Nile", "Garden", "high"), (keys[1], "done", "compound", "Garden City", "Nile", "Garden", "high"), (keys[2], "done", "not_compound", None, None, None, "high")]
    a = spark.createDataFrame(rows, "key string, status string, kind string, compound string, developer string, reference string, confidence string").withColumns({"compound_ar": F.lit(None).cast("string"), "developer_ar": F.lit(None).cast("string")})
    out, refs = entities.apply_aliases(r, a)
    assert {x.id: x.compound_name for x in out.collect()} == {1: "Garden", 2: "Garden", 3: None, 4: "Other"}
    assert [tuple(x) for x in refs.collect()] == [("garden", "garden")]


def state_of(spark, rows):
    return spark.createDataFrame(rows, "source string, source_listing_id string, scope_key string, status string, price double, title string, delivery_date string, first_seen_at timestamp, last_seen_at timestamp")


def test_upsert_lifecycle(spark):
    t0, t1 = SEEN, SEEN + datetime.timedelta(days=1)
    state = state_of(spark, [("s", "1", "a", "active", 10.0, "x", None, t0, t0), ("s", "2", "a", "active", 20.0, "y", None, t0, t0), ("s", "3", "a", "removed", 30.0, "z", None, t0, t0)])
    batch = state_of(spark, [("s", "1", "a", "active", 10.0, "x", None, t1, t1), ("s", "2", "a", "active", 21.0, "y", "2027-01-01", t1, t1), ("s", "3", "a", "active", 30.0, "z", None, t1, t1), ("s", "4", "a", "active", 1.0, None, None, t1, t1)])
    got = {r.source_listing_id: r for r in cdc.upsert(state, batch, F.lit(t1)).collect()}
    assert {k: r.action for k, r in got.items()} == {"1": "unchanged", "2": "updated", "3": "relisted", "4": "created"}
    assert {k: (v.old, v.new) for k, v in got["2"].changed_fields.items()} == {"price": ("20.0", "21.0"), "delivery_date": (None, "2027-01-01")}
    new, versions = cdc.apply_upsert(state, batch, F.lit(t1))
    assert {r.source_listing_id: (r.status, r.price) for r in new.collect()} == {"1": ("active", 10.0), "2": ("active", 21.0), "3": ("active", 30.0), "4": ("active", 1.0)}
    assert versions.count() == 3


def test_hash_ignores_empty_late_fields(spark):
    a = spark.createDataFrame([("x", 1.0)], "title string, price double")
    b = a.withColumn("delivery_date", F.lit(None).cast("string"))
    h = [df.select(cdc.content_hash(df).alias("h")).first().h for df in (a, b, b.withColumn("delivery_date", F.lit("2027")))]
    assert h[0] == h[1] != h[2]


def test_removals_stay_in_scope(spark):
    old = SEEN - datetime.timedelta(days=3)
    state = state_of(spark, [("s", "1", "a", "active", 1.0, "x", None, old, old), ("s", "2", "b", "active", 1.0, "x", None, old, old), ("s", "3", "a", "active", 1.0, "x", None, old, SEEN)])
    scopes = spark.createDataFrame([("s", "a", SEEN)], "source string, scope_key string, cutoff timestamp")
    assert {r.source_listing_id: r.status for r in cdc.mark_removals(state, scopes, F.lit(SEEN)).collect()} == {"1": "removed", "2": "active", "3": "active"}


def test_fills_survive_an_unchanged_text(spark):
    df = spark.createDataFrame([("s", "1", "t", "d", None), ("s", "2", "t", "changed", None), ("s", "3", "t", "d", "lux")], "source string, source_listing_id string, title string, description string, finishing string")
    import hashlib

    h = hashlib.sha256(b"t\nd").hexdigest()
    e = spark.createDataFrame([("s", str(i), h, "done", {"finishing": "super_lux"}) for i in (1, 2, 3)], "source string, source_listing_id string, description_hash string, status string, applied map<string,string>")
    assert {r.source_listing_id: r.finishing for r in cdc.with_fills(df, e).collect()} == {"1": "super_lux", "2": None, "3": "lux"}


def test_health(spark):
    now, h = SEEN, lambda n: SEEN - datetime.timedelta(hours=n)
    rows = [("ok", "completed", 5, 100), ("stale", "completed", 60, 100), ("failing", "failed", 3, 0), ("failing", "failed", 9, 0), ("failing", "completed", 20, 50), ("running", "running", 1, 0), ("dropped", "completed", 2, 10), ("dropped", "completed", 26, 100), ("none", "failed", 2, 0)]
    df = spark.createDataFrame([(i, s, h(t), h(t), st, n, "p") for i, (s, st, t, n) in enumerate(rows)], "id long, source string, started_at timestamp, finished_at timestamp, status string, seen long, scope string")
    names = spark.createDataFrame([(s,) for s in ("ok", "stale", "failing", "running", "dropped", "none", "missing")], "source string")
    got = {r.source: r.state for r in health.source_health(df, names, F.lit(now)).collect()}
    assert got == {"ok": "ok", "stale": "stale", "failing": "failing", "running": "running", "dropped": "dropped", "none": "failing", "missing": "never"}


def test_parts_round_trip(spark):
    docs = spark.createDataFrame([("k", "a", "x" * 17), ("k", "b", ""), ("k", "c", "abcde")], "kind string, key string, text string")
    p = publish.parts(docs, 5)
    assert p.count() == 6 and {(r.key, r.text) for r in publish.assembled(p).collect()} == {("a", "x" * 17), ("b", ""), ("c", "abcde")}


def test_tables_too_large_for_a_reader(spark):
    with pytest.raises(ValueError):
        publish.bounded(spark.range(11), 10)


def test_budget_limits(spark):
    rows = [(1, 5e6, 80.0, 2, 4e6, 1e6, "ready", None), (2, 5e6, 80.0, None, None, None, "unknown", "2027-05-01")]
    df = spark.createDataFrame(rows, "id long, price double, area_m2 double, bedrooms int, cash_equivalent double, remaining double, delivery_bucket string, delivery_date string")
    ids = lambda **k: [r.id for r in df.where(search.within(**k)).orderBy("id").collect()]
    assert ids(price_max=5e6) == [1, 2] and ids(cash_max=9e9) == [1] and ids(signing_max=4e6) == [1] and ids(bedrooms_min=1) == [1]
    assert ids(delivery="ready") == [1] and ids(delivery="2027") == [1, 2] and ids(delivery="2026") == [1] and ids(newer_than=1) == [2]


def test_pages_cover_everything_once(snap):
    all_ids = [r.id for r in search.unit_query(snap.records).collect()]
    paged = list(itertools.chain.from_iterable([r.id for r in search.page_of(search.unit_query(snap.records), p, 7).collect()] for p in range(1, 6)))
    assert paged == all_ids and len(set(all_ids)) == 22


def test_scope_and_overview(snap):
    assert {r.source: r.share for r in rollup.scope(snap.resale, []).collect()} == {"portal": round(21 / 22, 4), "classified": round(1 / 22, 4)}
    o = rollup.overview(snap.raw, snap.records, snap.resale, ("benchmark",)).first()
    assert (o.total_records, o.total_eligible, o.total_resale) == (29, 23, 22)


def test_model_recovers_levels(spark):
    import random

    rng, rows, i = random.Random(7), [], 0
    for compound, ppm in (("a", 40_000), ("b", 60_000), ("c", 90_000)):
        for _ in range(60):
            rows.append((i, "apartment", "apartment", "D", "dev" + compound, compound, "finished", "ready", "cash", math.log(rng.uniform(80, 200)), math.log(ppm) + rng.gauss(0, 0.1)))
            i += 1
    u = spark.createDataFrame(rows, "id long, cls string, type string, district string, developer string, compound string, finishing string, delivery string, plan string, log_area double, y double")
    m = model.fit(u, saver(spark), rounds=3)
    by = {r.compound: r.v for r in model.predict(m, m.units).groupBy("compound").agg(F.exp(F.avg("log_fair")).alias("v")).collect()}
    for compound, ppm in (("a", 40_000), ("b", 60_000), ("c", 90_000)):
        assert by[compound] == pytest.approx(ppm, rel=0.06)
    b = model.backtest(m).collect()
    assert [r.grade for r in b] == ["A"] and 0.55 <= b[0].within_10pct <= 0.85


def test_leave_one_out_median(spark):
    ys = [1.0, 2.0, 2.0, 5.0, 7.0, 8.0, 9.0]
    u = spark.createDataFrame([(i, "c", "d", y) for i, y in enumerate(ys)], "id long, cls string, district string, y double")
    got = {r.id: r.naive_error for r in model.naive(u).collect()}
    for i, y in enumerate(ys):
        assert got[i] == pytest.approx(abs(math.exp(y - statistics.median(ys[:i] + ys[i + 1 :])) - 1))
