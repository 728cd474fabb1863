"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, only, place, placed, saved, shared_dir

#: Runs merged at once: three binomial rounds in one exchange.
FAN_IN = 8
#: What makes two digests the same: SHA-256, and as proof the length and a second, unrelated hash.
KEY = ["digest", "length", "proof"]


def normalised(text: Column) -> Column:
    """The text without the six blank characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digest_runs(docs: DataFrame) -> DataFrame:
    """One narrow row per document, a sorted run for each partition of docs.

    id, size and at (the row's place) decide which row stays. The table must be saved
    before it is used twice: run and at are places in this computation.
    """
    d = docs.select(id_key().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("id", F.length("t").alias("size"), normalised(F.col("t")).alias("n"))
    d = d.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("at"),
        "id",
        "size",
        F.unhex(F.sha2("n", 256)).alias("digest"),
        F.length("n").alias("length"),
        F.xxhash64("n").alias("proof"),
    )
    return d.sortWithinPartitions(*KEY)


def merge_tree(leaves: DataFrame, runs: int, fan_in: int, work: str) -> list[DataFrame]:
    """The levels of the tree: run, digest, best and n; the last level has one run.

    In a round, each group of fan_in neighbouring runs goes to its first one, where
    equal digests, their proofs checked, meet in sorted order and the best row (longest
    original, smallest id, first place) is retained. An exchange is dealt by run and
    digest and moves at most one row per digest and run: no task holds a whole run, and
    a digest of a third of all rows costs fan_in rows a merge.
    """
    best = F.min(F.struct((-F.col("size")).alias("neg_size"), "id", "at"))
    level = saved(leaves.groupBy("run", *KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("n")), f"{work}/level0")
    levels = [level]
    while runs > 1:
        runs = -(-runs // fan_in)
        up = F.floor(F.col("run") / fan_in).cast("int")
        level = level.withColumn("run", up).groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        level = saved(level, f"{work}/level{len(levels)}")
        levels.append(level)
    return levels


def _judged(docs: DataFrame, fan_in: int) -> DataFrame:
    """id, size, digest, n, and the best row's id and whether it is this one, for every row of docs."""
    if fan_in < 2:
        raise ValueError("a fan-in of 2 or more")
    work = shared_dir(docs.sparkSession)
    leaves = saved(digest_runs(only(docs, "doc_id", "text")), f"{work}/leaves")
    runs = (leaves.agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    levels = merge_tree(leaves, runs, fan_in, work)
    # Winners go back as they came, level by level, to the runs that hold their digest.
    won = levels.pop()
    while levels:
        held = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan_in).cast("int").alias("up"))
        won = held.hint("merge").join(won.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    rows = leaves.hint("merge").join(won, ["run", *KEY])
    return rows.select("id", "size", "digest", "n", F.col("best.id").alias("keep"), (F.col("at") == F.col("best.at")).alias("kept"))


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Texts are equal when the same after deleting blanks. Of equal texts the row with most
    code points, then the smallest doc_id, stays; of rows that agree in both, one. A null
    text is an empty text. A null doc_id sorts before all others. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    return _judged(docs, fan_in).select(
        id_back(F.col("id")).alias("doc_id"),
        id_back(F.col("keep")).alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each different text, with their columns as they are.

    Of rows that repeat the winner's doc_id, size and text but for the kind of blanks, any one stays.
    """
    text = F.col(place(docs, "text")).cast("string")
    own = {"k_id": id_key(place(docs, "doc_id")), "k_size": F.length(F.coalesce(text, F.lit(""))), "k_digest": F.unhex(F.sha2(normalised(text), 256))}
    kept = _judged(docs, FAN_IN).where("kept").select(F.col("id").alias("k_id"), F.col("size").alias("k_size"), F.col("digest").alias("k_digest"))
    rows = placed(docs).withColumns(own).join(kept, list(own), "left_semi").dropDuplicates(list(own))
    return rows.drop(*own).toDF(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) = 1 AS kept,
       text_sha256
FROM n"""
}
