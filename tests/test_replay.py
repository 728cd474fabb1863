"""Places in ranges, and batches in which a listing occurs more than once, against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import cdc, compare, publish, replay, resolution
from tallystone.plans import places
from tallystone.plans.storage import saver


def test_no_row_is_lost_at_size(spark):
    """300,000 rows of uneven width, more ranges than one, partitions that may be coalesced."""
    n = 300_000
    wide = F.repeat(F.lit("x"), (F.pmod(F.hash("id"), F.lit(7)) * F.when(F.col("id") < 3000, 60).otherwise(1)).cast("int"))
    pairs = spark.range(n).select(F.format_string("k%07d", (F.col("id") * 7919) % n).alias("key"), F.pmod(F.hash("id"), F.lit(50_000)).cast("long").alias("listings"), wide.alias("compound"))
    b = resolution.batches(pairs)
    got = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("m")).collect()
    assert len(got) == n // 120 and all(r.n == r.d == r.m + 1 == 120 for r in got) and b.select("key").distinct().count() == n
    assert b.where("batch = 0").agg(F.min("listings")).first()[0] >= b.where("batch = 1").agg(F.max("listings")).first()[0]
    s = publish.staging(pairs.withColumn("size", F.length("compound") + 1), "size", ["key"])
    g = s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("d"), F.max("place").alias("m")).first()
    assert (g.n, g.d, g.m) == (n, n, n - 1)
    assert s.groupBy("batch").count().agg(F.max("count")).first()[0] <= 40
    r = spark.range(n).select("id", F.element_at(F.array(*map(F.lit, compare.LEVELS)), (F.pmod(F.hash("id"), F.lit(7)) + 1).cast("int")).alias("level"), F.lit(1).alias("n_signals"), F.rand(3).alias("score"))
    g = compare.all_ranks(r).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.count_distinct("id").alias("i")).first()
    assert (g.n, g.d, g.m, g.i) == (n, n, n - 1, n)


def test_places_of_an_empty_table(spark):
    assert places.numbered(spark.range(0), ["id"], saver(spark)).collect() == []


SCHEMA = "source string, source_listing_id string, title string, price double, scope_key string, arrival int"


def plain(state, batch, now):
    """One listing after another."""
    versions, state = [], {k: dict(v) for k, v in state.items()}
    for key, title, price, scope, _ in sorted(batch, key=lambda r: r[4]):
        content = {"title": title, "price": price}
        old = state.get(key)
        if old is None:
            state[key] = {**content, "status": "active", "hash": (title, price), "scope": scope, "last": now, "first": now}
            versions.append((key, "created", None))
            continue
        was = old["status"]
        if old["hash"] == (title, price) and was != "removed":
            old["last"], old["scope"] = now, old["scope"] or scope
            continue
        diff = {c: (old[c], content[c]) for c in content if old[c] != content[c]}
        old |= content | {"hash": (title, price), "last": now, "scope": old["scope"] if scope is None else scope, "status": "active"}
        if diff or was == "removed":
            versions.append((key, "relisted" if was == "removed" else "updated", diff))
    return state, versions


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_listings_are_folded_in_order(spark, seed):
    rng = random.Random(seed)
    # One listing has a third of all rows, so that its steps fill more than one range.
    keys = ["hot"] * 10 + [f"k{i}" for i in range(20)]
    batch = [(rng.choice(keys), rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, None]), rng.choice([None, "s1", "s2"]), n) for n in range(900)]
    stored = {k: {"title": "a", "price": 1.0, "status": rng.choice(["active", "removed"]), "scope": "old"} for k in ("hot", "k1", "k2", "k3", "away")}
    frame = spark.createDataFrame([("src", k, t, p, s, n) for k, t, p, s, n in batch], SCHEMA).repartition(6)
    state = spark.createDataFrame([("src", k, v["title"], v["price"], v["scope"], v["status"]) for k, v in stored.items()], "source string, source_listing_id string, title string, price double, scope_key string, status string")
    state = state.withColumns({"first_seen_at": F.lit("2026-01-01").cast("timestamp"), "last_seen_at": F.lit("2026-01-01").cast("timestamp")})
    state = state.withColumn("content_hash", cdc.content_hash(state))
    now = F.lit("2026-02-01").cast("timestamp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        after, versions = replay.apply(state, frame, now)
        after, versions = after.collect(), versions.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, wanted = plain({k: v | {"hash": (v["title"], v["price"]), "last": "old", "first": "old"} for k, v in stored.items()}, batch, "now")
    old = "2026-01-01"
    assert {r.source_listing_id: (r.title, r.price, r.status, r.scope_key, str(r.last_seen_at)[:10] == old, str(r.first_seen_at)[:10] == old) for r in after if r.source_listing_id != "x"} == {
        k: (v["title"], v["price"], v["status"], v["scope"], v["last"] == "old", v["first"] == "old") for k, v in want.items()
    }
    by = lambda vs: {k: [v[1:] for v in vs if v[0] == k] for k in {v[0] for v in vs}}
    text = lambda x: None if x is None else str(x)
    got = [(r.source_listing_id, r.change_type, None if r.changed_fields is None else {c: (x.old, x.new) for c, x in r.changed_fields.items()}) for r in sorted(versions, key=lambda r: int(r.step))]
    assert by(got) == by([(k, a, None if d is None else {c: (text(o), text(n)) for c, (o, n) in d.items()}) for k, a, d in wanted])


def test_there_and_back_is_three_versions(spark):
    rows = [("s", "1", "t", p, None, n) for n, p in enumerate([1.0, 2.0, 1.0, 1.0])]
    state = spark.createDataFrame([], "source string, source_listing_id string, title string, price double, scope_key string, status string, first_seen_at timestamp, last_seen_at timestamp")
    after, versions = replay.apply(state, spark.createDataFrame(rows, SCHEMA), F.lit("2026-02-01").cast("timestamp"))
    assert [(r.step, r.change_type) for r in versions.orderBy("step").collect()] == [("0", "created"), ("1", "updated"), ("2", "updated")]
    assert [(r.price, r.status) for r in after.collect()] == [(1.0, "active")]


@pytest.mark.parametrize("hashed", [True, False])
def test_listings_with_many_rows_are_folded_like_others(spark, hashed):
    """Some listings along ranges, others brought together: the same steps, state and versions as with all of one kind."""
    rng = random.Random(7)
    keys = ["hot"] * 8 + ["warm"] * 4 + [f"k{i}" for i in range(12)]
    batch = [("src", rng.choice(keys), rng.choice(["a", "b", None]), rng.choice([1.0, 2.0]), rng.choice([None, "s1", "s2"]), n) for n in range(400)]
    frame = spark.createDataFrame(batch, SCHEMA).repartition(6)
    state = spark.createDataFrame([("src", k, "a", 1.0, "old", s) for k, s in (("hot", "removed"), ("k1", "active"), ("k2", "removed"), ("away", "active"))], "source string, source_listing_id string, title string, price double, scope_key string, status string")
    state = state.withColumns({"first_seen_at": F.lit("2026-01-01").cast("timestamp"), "last_seen_at": F.lit("2026-01-01").cast("timestamp")})
    state = state.withColumn("content_hash", cdc.content_hash(state)) if hashed else state
    plain_rows = lambda df: sorted(map(str, df.collect()))
    got = []
    for hot in (0, 50, 10_000):
        after, versions = replay.apply(state, frame, F.lit("2026-02-01").cast("timestamp"), hot=hot)
        got.append((plain_rows(after), plain_rows(versions), plain_rows(replay.steps(state, frame, hot=hot).drop("place"))))
    assert got[0] == got[1] == got[2] and len(got[0][2]) == 400


def test_steps_of_ordinary_listings_save_no_content(spark):
    state = spark.createDataFrame([], "source string, source_listing_id string, title string, price double, scope_key string, status string, first_seen_at timestamp, last_seen_at timestamp")
    batch = spark.createDataFrame([("s", str(n % 5), "t", float(n), None, n) for n in range(50)], SCHEMA)

    def save(df, name):
        assert name == "counts" and df.count() == 1
        return df

    assert replay.steps(state, batch, save=save).where("action = 'updated'").count() == 45
