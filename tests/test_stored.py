"""Runs as a stream, and the sink of two phases."""

import json

import pytest
from pyspark.sql import functions as F

from tallystone.sources import stored
from tallystone.streaming import lifecycle


def write_run(path, name, pages, close=None):
    folder = path / name
    folder.mkdir(parents=True)
    for k in range(0, len(pages), 2):
        (folder / f"pages-{k}.jsonl").write_text("\n".join(json.dumps({"page_id": i, "html": h}) for i, h in pages[k : k + 2]) + "\n")
    if close is not None:
        (folder / stored.CLOSING).write_text(json.dumps(close))


def closing(day, **more):
    return {"source": "s", "started_at": f"2026-01-{day:02d}T00:00:00+00:00", "finished_at": f"2026-01-{day:02d}T05:00:00+00:00", "pages_fetched": 2, "complete": True, "scopes": ["a"], "errors": []} | more


def test_a_restart_reads_nothing_twice(spark, tmp_path):
    spark.dataSource.register(stored.RunSource)
    runs, out = tmp_path / "runs", f"{tmp_path}/out"

    def read():
        q = spark.readStream.format("listing_runs").option("maxRunsPerTrigger", 2).load(f"file://{runs}").writeStream.format("parquet")
        q.option("checkpointLocation", f"{tmp_path}/c").option("path", out).trigger(processingTime="0 seconds")
        q = q.start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.run, r.kind, r.page_id) for r in spark.read.parquet(out).collect())

    for k in range(3):
        write_run(runs, f"r{k}", [(10 * k + i, "x") for i in range(3)], closing(k + 1))
    write_run(runs, "r3", [(30, "x")])  # not closed yet
    of = lambda *ks: sorted(x for k in ks for x in [(f"r{k}", "close", None), *((f"r{k}", "page", 10 * k + i) for i in range(3 if k < 3 else 1))])
    key = lambda r: (r[0], r[1], r[2] or -1)
    assert sorted(read(), key=key) == sorted(of(0, 1, 2), key=key)
    assert sorted(read(), key=key) == sorted(of(0, 1, 2), key=key)
    (runs / "r3" / stored.CLOSING).write_text(json.dumps(closing(4)))
    assert sorted(read(), key=key) == sorted(of(0, 1, 2, 3), key=key)


def test_an_incomplete_run_completes_no_scope(spark, tmp_path):
    spark.dataSource.register(stored.RunSource)
    runs = tmp_path / "runs"
    write_run(runs, "r0", [(1, "x"), (2, "x")], closing(1))
    write_run(runs, "r1", [(1, "x")], closing(2, complete=False))
    write_run(runs, "r2", [(1, "x")], closing(3, errors=["page 2: blocked"]))

    def changes():
        stream = spark.readStream.format("listing_runs").load(str(runs))
        day = F.make_timestamp(F.lit(2026), F.lit(1), F.substring("run", 2, 1).cast("int") + 1, F.lit(1), F.lit(0), F.lit(0))
        listing = [F.lit("s").alias("source"), F.col("page_id").cast("string").alias("source_listing_id"), F.lit("a").alias("scope_key"), F.col("html").alias("title")]
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle._PROVIDER)
        q = lifecycle.lifecycle(stored.seen_and_ended(stream, listing, day), buckets=2, days=1000).writeStream.format("parquet")
        q = q.option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        return sorted((r.source_listing_id, r.change_type) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert changes() == [("1", "created"), ("2", "created")]
    write_run(runs, "r3", [(1, "x")], closing(4))
    assert changes() == [("1", "created"), ("2", "created"), ("2", "removed")]


def test_lines_of_any_length(tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"page_id": i, "html": "y" * (700_000 * (i % 3))}) for i in range(7)))
    assert [(x["page_id"], len(x["html"])) for x in stored._lines(str(tmp_path / "a.jsonl"))] == [(i, 700_000 * (i % 3)) for i in range(7)]


def test_readers_stay_on_the_old_version(spark, tmp_path):
    spark.dataSource.register(stored.VersionedSink)
    path = f"file://{tmp_path}/v"

    def write(df, version, **options):
        df.write.format("versioned_listings").options(version=version, **options).mode("append").save(path)

    read = lambda: sorted(r.id for r in spark.read.format("versioned_listings").load(path).collect())
    assert stored.active_version(path) is None
    write(spark.range(100).repartition(3), "v1", expect=100)
    assert read() == list(range(100)) and stored.active_version(path) == "v1"
    with pytest.raises(Exception, match="99 are expected"):
        write(spark.range(100).repartition(3), "v2", expect=99)
    broken = spark.range(100).repartition(3).select(F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        write(broken, "v3")
    assert read() == list(range(100)) and stored.active_version(path) == "v1"
    assert not list((tmp_path / "v" / "v2").glob("*.parquet"))
    write(spark.range(7).repartition(2), "v4")
    assert read() == list(range(7)) and stored.active_version(path) == "v4"
    first, second = (json.loads(p.read_text()) for p in sorted((tmp_path / "v" / "pointers").glob("*.json")))
    write(spark.range(100).orderBy(F.desc("id")).repartition(5), "v5")
    third = json.loads(sorted((tmp_path / "v" / "pointers").glob("*.json"))[-1].read_text())
    assert first["digest"] == third["digest"] != second["digest"]  # the rows count, not their order or files
