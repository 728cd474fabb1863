"""Keyed state against a plain fold, with a restart in the middle."""

import datetime
import random

import pytest

from tallystone.streaming import lifecycle

T0 = datetime.datetime(2026, 1, 1)
SCHEMA = "source string, source_listing_id string, title string, price double, scope_key string, observed_at timestamp, end_of_scope boolean, scope_started timestamp"


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def plain(rows):
    """Rows in order; no timers."""
    state, out = {}, []
    for source, own, title, price, scope, seen, end, started in sorted(rows, key=lambda r: (r[5], r[6])):
        if end:
            for (s, k), e in state.items():
                if s == source and e["status"] == "active" and e["scope"] == scope and e["seen"] < started:
                    e["status"] = "removed"
                    out.append((s, k, seen, "removed", None))
            continue
        e = state.get((source, own))
        if e is None:
            state[source, own] = {"c": (title, price), "status": "active", "scope": scope, "seen": seen}
            out.append((source, own, seen, "created", None))
            continue
        changed = [n for n, a, b in zip(("title", "price"), e["c"], (title, price), strict=True) if a != b]
        kind = "relisted" if e["status"] == "removed" else "updated" if changed else None
        if kind:
            out.append((source, own, seen, kind, sorted(changed, key=str)))
            e["scope"] = scope or e["scope"]
        e.update(c=(title, price), status="active", seen=seen)
    return out


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = lifecycle.start(stream, f"{tmp_path}/out", **options)
    q.awaitTermination()
    assert q.exception() is None


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


@pytest.fixture(autouse=True)
def store(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_lifecycle_is_the_fold(spark, tmp_path):
    rng, rows, parts = random.Random(7), [], []
    for hour in range(0, 60, 10):
        part = []
        for k in range(40):
            # No two rows of a listing at one time.
            own = f"k{rng.randrange(12)}"
            row = (rng.choice("ab"), own, rng.choice(["t", "u"]), rng.choice([1.0, 2.0]), rng.choice(["x", "y"]), at(hour) + datetime.timedelta(minutes=k), False, None)
            part.append(row)
        part.append(("a", None, None, None, "x", at(hour + 1), True, at(hour)))
        parts.append(part)
        rows += part
    for part in parts[:3]:
        feed(spark, tmp_path, part)
    run(spark, tmp_path, buckets=3, delay="2 hours", days=10_000)
    for part in parts[3:]:
        feed(spark, tmp_path, part)
    run(spark, tmp_path, buckets=3, delay="2 hours", days=10_000)
    got = sorted((r.source, r.source_listing_id, r.captured_at, r.change_type, r.changed_fields) for r in spark.read.parquet(f"{tmp_path}/out/changes").collect())
    want = sorted(plain(rows), key=lambda r: r[:4])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == [w[4] for w in want]
    assert {"created", "updated", "removed", "relisted"} == {g[3] for g in got}


def test_stale_listings_are_told_once(spark, tmp_path):
    day = lambda d: at(24 * d)
    row = lambda own, d: ("s", own, "t", 1.0, "x", day(d), False, None)
    for part in ([row("1", 0), row("2", 0)], [row("2", 10)], [row("3", 20)], [row("3", 26)], [row("1", 30)], [row("3", 60)], [row("3", 61)]):
        feed(spark, tmp_path, part)
        run(spark, tmp_path, buckets=2, days=14)
    got = sorted((r.source_listing_id, (r.captured_at - T0).days) for r in spark.read.parquet(f"{tmp_path}/out/changes").where("change_type = 'stale'").collect())
    assert got == [("1", 14), ("1", 44), ("2", 24), ("3", 40)]
