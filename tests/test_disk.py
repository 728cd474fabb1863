"""What queries leave on disk, and what they do not compute."""

import time

import pytest
from pyspark.sql import functions as F

from tallystone import catalog, catalog_flow, catalog_views  # noqa: F401  (registers its queries)
from tallystone.operators import compare
from tallystone.plans import incremental, snapshot
from tallystone.plans.storage import saver

SF = "/root/testdata/sf0.001"


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def settled(spark, most, seconds=20):
    end = time.time() + seconds
    while shuffled(spark) > most and time.time() < end:
        time.sleep(0.2)
    return shuffled(spark)


def test_what_a_saved_table_shuffled_goes(spark):
    save = saver(spark)
    save(spark.range(1), "first")
    time.sleep(2)
    before = shuffled(spark)
    out = save(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    assert out.count() == 5000
    save(spark.range(1), "next")
    assert settled(spark, before) <= before


@pytest.mark.parametrize("name, not_built", [("observation_window", ("signals", "records", "compounds")), ("delivery_changes", ("signals", "records", "compounds")), ("full_ranking", ("records", "compounds")), ("opportunity_levels", ("records", "compounds")), ("evaluate_batch", ("signals", "records", "compounds")), ("unit_details", ("records", "compounds"))])
def test_only_what_is_asked_for_is_computed(spark, name, not_built):
    snapshot._served.clear()
    assert catalog.QUERIES[name](spark, SF).count() > 0
    built = snapshot.cached(spark, SF).__dict__
    assert "resolved" in built and not set(not_built) & set(built)


def test_names_of_compounds_without_comparisons(spark):
    z = snapshot.cached(spark, SF)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(z.named.select("key", "name", "position")) == rows(z.compounds.select("compound_key", "compound", "units"))


def test_a_refresh_drops_what_it_saved(spark, tmp_path, monkeypatch):
    saved, dropped = [], []

    def watched(spark):
        inner = saver(spark)

        def save(df, name):
            saved.append(name)
            return inner(df, name)

        save.drop = lambda *names: (dropped.extend(names), inner.drop(*names))
        return save

    monkeypatch.setattr(incremental, "saver", watched)
    snap, today = snapshot.cached(spark, SF), F.lit("2001-08-01").cast("date")
    incremental.build(snap.resolved, snap.matched, today, str(tmp_path))
    changes = snap.resolved.where("id % 41 = 3").withColumns({"gone": F.lit(False), "old_key": F.col("compound_key")})
    incremental.refresh(changes, snap.matched, today, str(tmp_path))
    assert sorted(saved) == sorted(dropped) and "again" in saved
    assert incremental.read(spark, str(tmp_path), "records").count() == snap.resolved.count()


def test_levels_are_those_of_whole_records(spark):
    z = snapshot.cached(spark, SF)
    a = compare.compare(z.resolved, z.default, z.matched, z.today).select("id", "level", "score", "n_signals", "launch_gap", "peer_gap")
    b = z.signals.select(*a.columns)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_lists_of_comparables_are_not_collected(spark):
    """Each unit's list comes whole from where it is made: no aggregation over the rows of lists but for units that are like no other."""
    z = snapshot.cached(spark, SF)
    lists = compare.comparable_lists(z.resolved, z.default)
    rows = {r.id: [tuple(c) for c in r.comparables] for r in lists.collect()}
    flat = compare.comparables(z.resolved, z.default).orderBy("id", "position").collect()
    assert sum(map(len, rows.values())) == len(flat) and all((r.position, r.other_id, r.cash_ppm) == rows[r.id][r.position - 1] for r in flat)
    detail = {r.id: (r.comparables, r.first_id) for r in catalog.QUERIES["unit_details"](spark, SF).collect()}
    assert detail == {r.id: (len(rows.get(r.id, [])), rows[r.id][0][1] if r.id in rows else None) for r in z.resolved.select("id").collect()}
