"""Ends of runs, spells on the market, sketches over time: against plain versions."""

import bisect
import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallystone.operators import survival, trends
from tallystone.sources import paging

SCHEMA = "run_id long, page int, attempt int, outcome string, units int, total int, page_size int, error string"


def crawl(attempts, most=None):
    """One page after another, as a crawler goes."""
    of = defaultdict(list)
    for _, page, attempt, outcome, units, total, size, error in attempts:
        of[page].append((attempt, outcome, units, total, size, error))
    page, failures, errors, fetched, seen = 1, 0, [], 0, 0
    if 1 not in of:
        return 0, 0, False, [], "unread"
    while True:
        if page not in of:
            return fetched, seen, False, errors, "gap"
        tries = sorted(of[page])
        _, outcome, units, total, size, error = tries[-1]
        if outcome == "not_found" and sum(t[1] == "not_found" for t in tries) >= 3:
            return fetched, seen, True, errors, "natural"
        if outcome != "ok":
            errors.append(f"page {page}: {error or outcome}")
        if outcome == "unreadable":
            fetched += 1
        if outcome in ("not_found", "http_error", "blocked", "unreadable"):
            return fetched, seen, False, errors, "stopped"
        if outcome == "fetch_error":
            failures += 1
            if failures >= 5:
                return fetched, seen, False, errors, "stopped"
            page += 1
            continue
        failures, fetched, seen = 0, fetched + 1, seen + (units or 0)
        if not units or page * (size or 12) >= (total or 0):
            return fetched, seen, True, errors, "natural"
        if most and page >= most:
            return fetched, seen, False, errors, "cut"
        page += 1


@pytest.mark.parametrize("most", [None, 6])
def test_runs_end_as_a_crawler_does(spark, most):
    rng, rows = random.Random(5), []
    for run in range(400):
        bad = rng.choice([0.0, 0.1, 0.6, 0.9])
        for page in range(1, rng.randint(2, 16)):
            if rng.random() < 0.02:
                continue
            for attempt in range(rng.choice([1, 1, 2, 3])):
                outcome = rng.choices(["ok", "fetch_error", "not_found", "http_error", "blocked", "unreadable"], [1 - bad, bad * 0.8 + 0.01, 0.08, 0.02, 0.01, 0.01])[0]
                rows.append((run, page, attempt, outcome, rng.choice([12, 12, 12, 5, 0, None]) if rng.random() < 0.3 else 12, rng.choice([60, 100, 1000]), rng.choice([12, 12, None, 0]), rng.choice(["e", None])))
    got = {r.run_id: (r.pages_fetched, r.seen, r.complete, r.errors, r.kind) for r in paging.closed(spark.createDataFrame(rows, SCHEMA), most).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = {run: crawl(rs, most) for run, rs in by.items()}
    assert got == want
    assert {"natural", "stopped", "gap"} <= {w[-1] for w in want.values()} and any(len(w[3]) >= 5 and w[-1] == "stopped" for w in want.values())


def test_a_fifth_failure_in_a_row_stops(spark):
    row = lambda page, outcome, n=0: (1, page, n, outcome, 12, 1000, 12, None)
    rows = [row(1, "ok"), *(row(p, "fetch_error") for p in (2, 3, 4, 5)), row(6, "ok"), *(row(p, "fetch_error") for p in range(7, 13)), row(13, "ok")]
    r = paging.closed(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.end, r.kind, r.pages_fetched, len(r.errors), r.scopes_completed) == (11, "stopped", 2, 9, [])
    assert paging.closed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spells(spark):
    day = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)
    rows = [(1, 0, "created"), (1, 5, "updated"), (1, 9, "removed"), (1, 20, "relisted"), (2, 3, "created"), (2, 4, "relisted"), (3, 0, "created"), (3, 0, "removed"), (4, 7, "removed"), (5, 1, "created"), (5, 2, "removed"), (5, 3, "removed")]
    got = survival.spells(spark.createDataFrame([(i, day(d), k) for i, d, k in rows], "property_id int, captured_at timestamp, change_type string"), F.lit(day(30)))
    assert sorted((r.property_id, r.started.day - 1, r.days, r.left) for r in got.collect()) == [(1, 0, 9, True), (1, 20, 10, False), (2, 3, 27, False), (3, 0, 30, False), (5, 1, 1, True)]


def test_product_limit(spark):
    rng = random.Random(9)
    rows = [(g, rng.randrange(40), rng.random() < 0.6) for g in "ab" for _ in range(300)] + [("c", 5, True), ("c", 5, True), ("c", 2, False), ("d", 4, False)]
    curve = survival.survival(spark.createDataFrame(rows, "g string, days int, left boolean"), ["g"])
    got = {(r.g, r.days): (r.at_risk, r.ended, r.survival) for r in curve.collect()}
    want = {}
    for g in "abcd":
        s = 1.0
        for d in sorted({x[1] for x in rows if x[0] == g}):
            n, e = sum(x[0] == g and x[1] >= d for x in rows), sum(x[0] == g and x[1] == d and x[2] for x in rows)
            s *= 1 - e / n
            if e:
                want[g, d] = (n, e, s)
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in want)
    assert got["c", 5][2] == 0.0
    assert {r.g: r.median_days for r in survival.medians(curve, ["g"]).collect()}["c"] == 5


def test_sketches_merge_within_their_bound(spark):
    df = spark.range(60_000).select(F.pmod(F.hash("id"), F.lit(5)).alias("compound"), F.make_date(F.lit(2026), (F.pmod(F.hash("id", F.lit(1)), F.lit(12)) + 1).cast("int"), F.lit(3)).alias("day"), F.exp(3 * F.randn(2)).alias("ppm"))
    monthly = trends.sketched(df.unionByName(df.limit(3).withColumn("ppm", F.lit(None).cast("double"))), ["compound"], "ppm", F.col("day"))
    exact = sorted(r.ppm for r in df.select("ppm").collect())
    for keys, some in ((["compound"], 5), ([], 1), (["month"], 12)):
        rows = trends.quantiles(trends.merged(monthly, keys) if keys != ["compound", "month"] else monthly, {"median": 0.5, "p90": 0.9}).collect()
        assert len(rows) == some and sum(r.n for r in rows) == 60_000
        if not keys:
            for share, value in ((0.5, rows[0].median), (0.9, rows[0].p90)):
                assert abs(bisect.bisect_left(exact, value) / len(exact) - share) < 0.0165
            assert (rows[0].least, rows[0].most) == (exact[0], exact[-1])
    assert monthly.count() == 60 and monthly.select(F.max(F.length("sketch"))).first()[0] < 20_000
