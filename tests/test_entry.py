"""The driver's contract, also where the text part is not installed; publication and pointers."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallystone.functions import money as M
from tallystone.operators import cdc, model, publish, resolution

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["tallystone/llm", "tests/llm", "corpus_pipeline.py"], ["tallystone/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_text_part(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", *(g for g in gone if "/" not in g)))
    for g in gone:
        if "/" in g and (tmp_path / "r" / g).exists():
            shutil.rmtree(tmp_path / "r" / g)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, sum(n.startswith('op') and n[2].isdigit() for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for path in ({}, {"PYTHONPATH": ROOT}) if gone == ["corpus_pipeline.py"] else ({},):
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env | path, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 100 and out[1:] == ["False", "13" if gone == ["corpus_pipeline.py"] and os.path.isdir(f"{ROOT}/tallystone/llm") else "0"]


def test_pointer_moves_only_to_what_is_whole(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError):
        publish.read_active(spark, path, "t")
    for k in (1, 2):
        publish.publish({"t": spark.range(k)}, path, f"v{k}")
    assert publish.active_version(spark, path) == "v2" and publish.read_active(spark, path, "t").count() == 2
    publish.activate(spark, path, "v1")
    assert publish.read_active(spark, path, "t").count() == 1


def test_staging_closes_a_batch_where_the_next_row_does_not_fit(spark):
    df = spark.range(250).select("id", F.when(F.col("id") % 50 == 7, 299_000).otherwise(10).cast("int").alias("size")).coalesce(1)
    got = publish.staging(df, "size", ["id"]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    assert sum(r.n for r in got) == 250 and all(r.n <= 40 and r.b <= 300_000 for r in got)
    with pytest.raises(Exception, match="larger than a batch"):
        publish.staging(spark.range(1).select("id", F.lit(400_000).alias("size")), "size", ["id"]).collect()


def test_a_batch_that_fails_stops_no_other(spark):
    pairs = spark.createDataFrame([(f"k{i:03d}", f"C{i}", "D", "A", 500 - i) for i in range(250)], "key string, compound string, developer string, district string, listings long")
    b = resolution.batches(pairs)

    def invoke(text):
        if '"C0"' in text:
            raise RuntimeError("no answer")
        return [{"id": 1, "kind": "compound", "compound": "X", "confidence": "high"}, {"id": 1, "kind": "compound", "compound": "Y"}, {"id": 999}]

    ref = spark.createDataFrame([], "compound string, developer string, area string")
    stored = spark.createDataFrame([("k000", 1)], "key string, attempts int")
    got = {r.key: r for r in resolution.resolved(b, resolution.answers(resolution.prompts(b), invoke), stored, ref).collect()}
    assert len(got) == 250 and sorted(k for k, r in got.items() if r.status == "done") == ["k121", "k241"]
    assert (got["k000"].error, got["k000"].attempts) == ("no answer", 2) and got["k122"].error == "missing from the answer"


def test_repeating_runs_complete_no_scope(spark):
    state = spark.createDataFrame([("s", str(i), "a", "active", None) for i in range(3)], "source string, source_listing_id string, scope_key string, status string, last_seen_at timestamp").withColumn("last_seen_at", F.lit("2026-01-01").cast("timestamp"))
    schema = "source string, seen int, n_distinct int, complete boolean, errors array<string>, crashed boolean, scopes_completed array<string>"
    for distinct, status, removed in ((300, "completed", 3), (100, "partial", 0)):
        run = spark.createDataFrame([("s", 300, distinct, True, [], False, ["a"])], schema)
        after, versions, done = cdc.finish_run(state, run, None, F.lit("2026-01-02").cast("timestamp"), F.lit("2026-01-03").cast("timestamp"))
        assert (done.first().status, versions.count(), after.where("status = 'removed'").count()) == (status, removed, removed)


def test_dates_and_runs(spark):
    df = spark.createDataFrame([("2026-07-01T00:30:00Z",), ("2026-01-01T00:30:00Z",), ("2026-07-01T02:30:00+03:00",), ("x",), (None,), ("2026-01-01 10:00",)], "t string")
    r = df.select(M.iso_date(F.col("t")).alias("i"), M.scheduled_run(F.to_timestamp(F.when(F.col("t").rlike("Z$"), F.col("t")))).alias("s")).collect()
    assert [x.i for x in r] == ["2026-07-01T00:30:00Z", "2026-01-01T00:30:00Z", "2026-06-30T23:30:00Z", None, None, "2026-01-01T10:00:00Z"]
    assert [x.s for x in r] == [None, "nightly-2026-01-01", None, None, None, None]


def test_effects_as_premiums():
    m = model.Model(effects={"type": {"villa": 0.1}, "finishing": {}, "delivery": {"ready": 0.0}, "plan": {}}, slope={"house": -0.2})
    assert model.summarize_effects(m) == [("type", "villa", 0.1052), ("delivery", "ready", 0.0), ("area_doubling", "house", -0.1294)]
