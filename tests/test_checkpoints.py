"""Checkpoints: what is written, what is given back, what is found damaged."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import publish
from tallystone.plans import checkpoints


def rows(df):
    return sorted(map(str, df.collect()))


def test_one_changed_row_rewrites_one_range(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.array("id").alias("list"))
    first = checkpoints.save(df, path, ["id"], 32)
    assert len(first.written) == 32 and rows(checkpoints.restore(spark, path)) == rows(df)
    # The same rows in another order and other partitions: nothing is written.
    again = checkpoints.save(df.orderBy(F.rand(1)).repartition(7), path, ["id"], 32)
    assert (again.root, again.written, again.compared) == (first.root, (), 1)
    changed = df.withColumn("text", F.when(F.col("id") == 77, "new").otherwise(F.col("text")))
    third = checkpoints.save(changed, path, ["id"], 32)
    assert len(third.written) == 1 and third.compared <= 11 and rows(checkpoints.restore(spark, path)) == rows(changed)
    assert rows(checkpoints.restore(spark, path, "v1")) == rows(df)
    # A row that is there twice, and twice more: sums of hashes see each.
    twice = checkpoints.save(changed.unionByName(changed.where("id = 5")), path, ["id"], 32)
    four = checkpoints.save(changed.unionByName(changed.where("id = 5")).unionByName(changed.where("id = 5")).unionByName(changed.where("id = 5")), path, ["id"], 32)
    assert len(twice.written) == len(four.written) == 1 and len({third.root, twice.root, four.root}) == 3
    # A null is not an empty text; a row moves from one range to another.
    assert len(checkpoints.save(changed.withColumn("text", F.when(F.col("id") == 3, "").otherwise(F.col("text"))), path, ["id"], 32).written) >= 1
    moved = checkpoints.save(df.withColumn("id", F.when(F.col("id") == 9, 10**6).otherwise(F.col("id"))), path, ["id"], 32)
    assert moved.written and rows(checkpoints.restore(spark, path)) == rows(df.withColumn("id", F.when(F.col("id") == 9, 10**6).otherwise(F.col("id"))))
    assert publish.active_version(spark, path) == moved.version
    before = rows(checkpoints.restore(spark, path))
    assert checkpoints.compact(spark, path, 1) != [] and rows(checkpoints.restore(spark, path)) == before
    # Other columns: all is written.
    assert len(checkpoints.save(df.drop("list"), path, ["id"], 32).written) == 32
    gone = checkpoints.save(df.drop("list").where("id < 3"), path, ["id"], 32)
    assert len(gone.written) <= 3 and checkpoints.restore(spark, path).count() == 3
    empty = checkpoints.save(df.drop("list").limit(0), path, ["id"], 32)
    assert empty.written == () and checkpoints.restore(spark, path).columns == ["id", "text"] and checkpoints.restore(spark, path).count() == 0


@pytest.mark.parametrize("damage", ["cut", "other", "away"])
def test_damage_is_named(spark, tmp_path, damage):
    path = f"{tmp_path}/t"
    df = spark.range(400).select("id", F.lit("x").alias("text"))
    checkpoints.save(df, path, ["id"], 8)
    part = glob.glob(f"{path}/data/epoch=0/range=3/*.parquet")[0]
    if damage == "cut":
        with open(part, "r+b") as f:
            f.truncate(os.path.getsize(part) // 2)
    elif damage == "other":
        other = glob.glob(f"{path}/data/epoch=0/range=4/*.parquet")[0]
        with open(other, "rb") as f, open(part, "wb") as g:
            g.write(f.read())
    else:
        os.remove(part)
        os.rmdir(os.path.dirname(part)) if not os.listdir(os.path.dirname(part)) else [os.remove(p) for p in glob.glob(f"{os.path.dirname(part)}/.*")]
    for crc in glob.glob(f"{path}/data/epoch=0/range=3/.*.crc"):
        os.remove(crc)
    with pytest.raises(checkpoints.Damaged, match="range=3"):
        checkpoints.restore(spark, path)


def test_trees_lead_to_what_differs():
    rng = random.Random(3)
    for ranges in (1, 2, 3, 7, 64, 100):
        a = {k: (1, f"d{rng.randrange(9)}") for k in range(ranges) if rng.random() < 0.9}
        b = {k: v if rng.random() < 0.9 else (1, "other") for k, v in a.items() if rng.random() < 0.95}
        found, _ = checkpoints.differing(checkpoints.tree(a, ranges), checkpoints.tree(b, ranges))
        assert found == [k for k in range(ranges) if a.get(k) != b.get(k)]
    with pytest.raises(ValueError):
        checkpoints.differing(checkpoints.tree({}, 4), checkpoints.tree({}, 64))
