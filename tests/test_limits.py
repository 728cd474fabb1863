"""A resolver with limits, all levels in one scan, terms by an index."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import resolution, rollup, search, term_index
from tallystone.plans import snapshot

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def requests(spark):
    pairs = spark.createDataFrame([(f"k{i:03d}", f"C{i}", "D", "A", 900 - i) for i in range(80)], "key string, compound string, developer string, district string, listings long")
    b = resolution.batches(pairs, 10)
    return b, resolution.prompts(b, "r", "k", "Devs")


def items(text):
    return json.loads(text[text.index("items:\n") + 7 :])


@pytest.mark.parametrize("workers", [1, 3])
def test_two_failures_stop_a_resolver(spark, tmp_path, requests, workers):
    log = f"{tmp_path}/asked"

    def invoke(text):
        items = lambda text: json.loads(text[text.index("items:\n") + 7 :])  # noqa: E731  (a worker cannot import this module)
        first = items(text)[0]["compound"]
        with open(log, "a") as f:
            f.write(first + "\n")
        time.sleep(0.05 if workers > 1 and first == "C0" else 0)
        if first in ("C20", "C30") or (workers > 1 and int(first[1:]) >= 20):
            raise RuntimeError("down")
        return [{"id": i["id"], "kind": "compound", "compound": i["compound"], "confidence": "high"} for i in items(text)]

    b, r = requests
    got = resolution.within_limits(r, invoke, workers, 2)
    asked = [r.batch for r in got.where("position IS NULL").collect()]
    assert asked == sorted(asked) and {2, 3} <= set(asked) and len(asked) <= 3 + workers
    if workers == 1:
        assert asked == [0, 1, 2, 3]
    ref, stored = spark.createDataFrame([], "compound string, developer string, area string"), spark.createDataFrame([("k000", 1), ("k079", 2)], "key string, attempts int")
    out = {x.key: x for x in resolution.resolved(b, got, stored, ref).collect()}
    assert len(out) == 10 * len(asked) and "k079" not in out and out["k000"].attempts == 2
    assert {out[f"k{k:03d}"].error for k in range(20, 10 * len(asked))} == {"down"} and out["k005"].compound == "C5"
    with open(log) as f:
        before = f.read()
    got.count(), resolution.resolved(b, got, stored, ref).count()
    with open(log) as f:
        assert f.read() == before  # nobody is asked twice


def test_a_deadline(spark, requests):
    def invoke(text):
        time.sleep(0.3)
        return [{"id": 0, "kind": "compound", "compound": "X"}, {"id": 0, "kind": "compound", "compound": "Y"}]

    got = resolution.within_limits(requests[1], invoke, 2, 2, minutes=0.35 / 60)
    assert sorted(r.batch for r in got.where("position IS NULL").collect()) == [0, 1, 2, 3]
    ref, stored = spark.createDataFrame([], "compound string, developer string, area string"), spark.createDataFrame([], "key string, attempts int")
    assert {r.compound for r in resolution.resolved(requests[0], got, stored, ref).where("status = 'done'").collect()} == {"X"}  # the first of an id
    assert resolution.within_limits(requests[1], invoke, 2, 2, minutes=0.0).count() == 0
    with pytest.raises(ValueError):
        resolution.within_limits(requests[1], invoke, 0)


def test_prompts_list_developers(spark, requests):
    text = requests[1].where("batch = 0").first().text
    assert "developers:\nDevs\n" in text and len(items(text)) == 10
    ref = spark.createDataFrame([("B", "D2", "X"), ("A", None, None), ("C", "D1", "Y"), ("E", "D1", "Y")], "compound string, developer string, area string")
    assert resolution.reference_lines(ref) == ("A |  | \nB | D2 | X\nC | D1 | Y\nE | D1 | Y", "D1\nD2")
    with pytest.raises(ValueError):
        resolution.reference_lines(ref, 3)
    assert threading.active_count() < 50


def test_levels_in_one_scan(spark):
    snap = snapshot.cached(spark, SF)
    rows = rollup.all_levels(snap.resale)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
    columns = [c for c in rows.columns if c not in ("level", "key")]
    text = lambda df, key: sorted(str((r[key] if key else None, *(r[c] for c in columns))) for r in df.collect())
    items = snap.resale.withColumn("district_key", T.slug(F.col("district")))
    for level, key in (("compound", "compound_key"), ("developer", "developer_key"), ("district", "district_key")):
        own = items.where(F.col(key) != "") if level != "district" else items
        assert text(rows.where(F.col("level") == level), "key") == text(rollup.profile(own, [key]), key)
    assert text(rows.where("level = 'all'"), None) == text(rollup.profile(items, []), None)


def test_terms_by_the_index(spark, tmp_path):
    units = snapshot.cached(spark, SF).records.select("id", "title", "district", "compound", "developer")
    path, values = f"{tmp_path}/x", ["title", "district", "compound", "developer"]
    term_index.build(units, "id", values, path, 16)
    a = units.where("title IS NOT NULL").orderBy("id").first()
    queries = [a.title, a.compound, "ASIA phase", "zzzz", "as", "", f"{a.district} {a.developer}", "phase 2", "x%y_", "éé é"]
    got = {}
    read = term_index.Read()
    for r in term_index.search(spark, path, queries, 16, read=read).collect():
        got.setdefault(r.query, set()).add(r.id)
    for k, q in enumerate(queries):
        want = {r.id for r in units.where(T.matches(q, *(F.col(v) for v in values))).select("id").collect()}
        assert got.get(k, set()) == want, q
    one = term_index.Read()
    rare = term_index.search(spark, path, [a.title], 16, read=one)
    assert rare.count() == len(got[0]) and one.texts < units.count() and one.postings < spark.read.parquet(f"{path}/postings").count() / 20
    assert search.page_of(units.orderBy("id"), 1, 5).count() == 5
