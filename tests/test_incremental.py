"""Refreshes by changes against full builds; a value that is served while the next one is built."""

import threading

import pytest
from pyspark.sql import functions as F

from tallystone.operators import compare, publish, rollup
from tallystone.plans import adapter, incremental, snapshot
from tallystone.plans.serving import Served
from tallystone.plans.storage import saver

SF = "/root/testdata/sf0.001"


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(a) == rows(b)


def test_refreshes_equal_full_builds(spark, tmp_path):
    path, today = f"{tmp_path}/v", F.lit(adapter.LATEST).cast("date")
    snap = snapshot.of_driver_tables(spark, SF)
    resolved, matched, save = snap.resolved, snap.matched, saver(spark)
    incremental.build(resolved, matched, today, path, buckets=16)
    full = compare.compare(resolved, resolved.where("is_resale"), matched, today)
    same(incremental.read(spark, path, "records"), full)
    a_key = resolved.where("compound_key <> ''").agg(F.max("compound_key")).first()[0]
    rng = lambda n, k=0: F.pmod(F.hash("id", F.lit(k)), F.lit(n)) == 0
    for k in (1, 2):
        old = resolved
        dear = lambda c: F.when(rng(60, k), F.round(F.col(c) * 0.8)).otherwise(F.col(c))
        moved = F.when(rng(90, 10 + k), F.lit(a_key)).when(rng(90, 20 + k), F.lit("")).otherwise(F.col("compound_key"))
        born = old.where(rng(150, 30 + k)).withColumn("id", F.col("id") + 10_000_000 * k)
        now = old.where(~rng(120, 40 + k)).withColumns({"price": dear("price"), "price_per_m2": dear("price_per_m2"), "cash_equivalent": dear("cash_equivalent"), "compound_key": moved})
        resolved = save(now.unionByName(born), f"resolved{k}")
        before = old.select("id", F.col("compound_key").alias("old_key"), F.struct(*old.columns).alias("o"))
        j = resolved.select("id", F.struct(*resolved.columns).alias("n")).join(before, "id", "full_outer").where(~F.col("n").eqNullSafe(F.col("o")))
        value = {c: F.coalesce(F.col(f"n.{c}"), F.when(F.col("n").isNull(), F.col(f"o.{c}"))) if c == "id" else F.col(f"n.{c}") for c in resolved.columns}
        changes = j.select(*(v.alias(c) for c, v in value.items()), F.col("n").isNull().alias("gone"), "old_key")
        done = incremental.refresh(changes, matched, today, path)
        full = save(compare.compare(resolved, resolved.where("is_resale"), matched, today), f"full{k}")
        assert done.version == f"v{k}" == publish.active_version(spark, path)
        same(incremental.read(spark, path, "records"), full)
        same(incremental.read(spark, path, "compounds"), rollup.compounds(full.where("is_resale"), matched))
        assert incremental.sums(spark, path) == incremental.totals(full).first().asDict()
    # One listing of one compound: one bucket is read, and only the compound is compared.
    one = resolved.where(F.col("compound_key") == a_key).limit(1)
    done = incremental.refresh(one.withColumns({"price": F.col("price") + 1000, "gone": F.lit(False), "old_key": F.col("compound_key")}), matched, today, path)
    own = resolved.where(F.col("compound_key") == a_key).count()
    assert done.buckets == 1 and done.rows_compared == own and done.rows_read < resolved.count() / 4
    # The version before is still there for those who read it.
    same(incremental.read(spark, path, "records", "v2"), full)


def test_some_sources_only(spark):
    part = snapshot.of_driver_tables(spark, SF, sources=("portal", "benchmark"))
    assert {r.source for r in part.projected.select("source").distinct().collect()} == {"portal", "benchmark"}


def test_served_while_it_is_built():
    now, signature, gate, built = [0.0], ["a"], threading.Event(), []

    def build():
        if built:
            gate.wait(10)
        if signature[0] == "bad":
            raise RuntimeError("no")
        built.append(signature[0])
        return f"value {signature[0]}"

    s = Served(build, lambda: signature[0], 10, lambda: now[0] + 1)
    assert s.get() == "value a" and built == ["a"]
    signature[0] = "b"
    assert s.get() == "value a" and built == ["a"]  # inside the window nobody looks
    now[0] = 20
    assert [s.get() for _ in range(5)] == ["value a"] * 5
    gate.set()
    s.wait()
    assert s.get() == "value b" and built == ["a", "b"]  # built once for five callers
    signature[0], now[0] = "bad", 40
    assert s.get() == "value b"
    s.wait()
    assert s.get() == "value b" and isinstance(s.error, RuntimeError)
    signature[0], now[0] = "c", 60
    s.get()
    s.wait()
    assert s.get() == "value c" and s.error is None
    inline = Served(lambda: signature[0], lambda: signature[0], 0)
    assert inline.get() == "c"
    signature[0] = "d"
    assert inline.get() == "d"


def test_first_build_fails_in_the_caller():
    with pytest.raises(ZeroDivisionError):
        Served(lambda: 1 // 0, lambda: 1).get()
