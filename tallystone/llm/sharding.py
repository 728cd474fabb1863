"""Shards by jump consistent hashing: a key and the number of shards decide, without a table of the ring.

A key's shard is where a sequence of ever longer jumps, drawn from the key alone, last
lands below the number of shards. One more shard takes each key with a chance of one in
the new number, and moves no key between old shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.places import numbered
from .common import only, place, placed, saved, shared_dir

SHARDS = 24
#: A row's size beside its text: that of its identifier.
OVERHEAD = 8
#: Of the generator of jumps: the multiplier, as published with the method.
_FACTOR = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys in step."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    shard, live, state, at = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(live):
        shard[live] = at
        state = state * _FACTOR + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = at < shards
        live, state, at = live[on], state[on], at[on]
    return shard


def _halves(key: Column) -> list[Column]:
    """Two halves of the first 64 bits of the MD5 of a key's text (null: the text "null"), so that ids in sequence are spread."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return [F.conv(F.substring(digest, k, 8), 16, 10).cast("long").alias(n) for k, n in ((1, "high"), (9, "low"))]


def assigned(rows: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """rows (plain columns only) with a column for each number of shards in counts (name → number). No shuffle."""
    kept = [f"{c} {t}" for c, t in rows.dtypes]

    def run(batches):
        for b in batches:
            keys = b["high"].to_numpy().astype(np.uint64) << np.uint64(32) | b["low"].to_numpy().astype(np.uint64)
            new = [pa.array(jump(keys, n), pa.int32()) for n in counts.values()]
            yield pa.RecordBatch.from_arrays(b.columns[:-2] + new, [*b.schema.names[:-2], *counts])

    return rows.select("*", *_halves(F.col(key))).mapInArrow(run, ", ".join([*kept, *(f"{c} int" for c in counts)]))


def shard_slots(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs (doc_id, text).

    size is the text's bytes and 8 more; slot counts a shard's rows from 0 in order of
    doc_id, CRC and size; grown_shard is where a row lies with one shard more: where it
    was, or in the new one. Rows of one doc_id lie in one shard, be their texts equal or
    not; rows with equal texts and different ids are spread as any others. A null text
    counts as empty for size and CRC; null ids share a shard and come first in it. Repeated rows have a
    slot each. An empty table gives an empty result; other columns are ignored.
    """
    work = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = saved(assigned(rows, "doc_id", {"shard": shards, "grown_shard": shards + 1}), f"{work}/assigned")
    first = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    out = numbered(rows, ["shard", F.asc_nulls_first("doc_id"), "text_crc32", "size"], lambda df, name: saved(df, f"{work}/{name}"))
    # A row for each shard: where it begins among all.
    start = first.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("start"))
    out = out.join(F.broadcast(start), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") - F.col("start")).cast("long").alias("slot"), "grown_shard")


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row as one more column, whatever the other columns are called. The key may be of any type that casts to text."""
    rows = placed(docs)
    keys = rows.select("*", *_halves(F.col(place(docs, key))))
    shard = F.pandas_udf(lambda h, w: _series(h, w, shards), "int")
    return keys.select(*rows.columns, shard("high", "low")).toDF(*docs.columns, name)


def _series(high, low, shards: int):
    import pandas as pd

    return pd.Series(jump(high.to_numpy().astype(np.uint64) << np.uint64(32) | low.to_numpy().astype(np.uint64), shards), dtype="int32")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """docs as Parquet in a folder for each shard. Tasks write what they hold: a hot key makes a shard's folder large, but no task."""
    sharded(docs, shards, key).write.mode("overwrite").partitionBy("shard").parquet(path)


def grow(spark: SparkSession, path: str, into: str, shards: int, key: str = "doc_id") -> DataFrame:
    """The rows that a shard more takes from folders that write_shards wrote: written to `into` as that shard; what stays is returned, to be kept or rewritten."""
    old = spark.read.parquet(path)
    now = sharded(old.drop("shard"), shards + 1, key)
    now.where(F.col("shard") == shards).write.mode("overwrite").partitionBy("shard").parquet(into)
    return now.where(F.col("shard") != shards)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST(('0x' || x) AS UBIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS BIGINT) + 1]))"
_NEXT = "(k * 2862933555777941757 + 1) % 18446744073709551616"
SQL = {
    "op13_sharding": f"""WITH RECURSIVE bit0 AS (SELECT i, CAST(i AS UBIGINT) AS c, 0 AS n FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, n + 1 FROM bit0 WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bit0 WHERE n = 8),
base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS m FROM documents),
keyed AS (SELECT r, doc_id, strlen(t) + 8 AS size, xor({_CRC}, 4294967295::UBIGINT) AS crc, CAST(('0x' || m[1:8])::UBIGINT AS HUGEINT) * 4294967296 + CAST(('0x' || m[9:16])::UBIGINT AS HUGEINT) AS k FROM base, tab),
jumps(r, j, k) AS (SELECT r, 0::BIGINT, k FROM keyed
  UNION ALL SELECT r, CAST(floor(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / (CAST(({_NEXT}) // 8589934592 AS DOUBLE) + 1.0::DOUBLE))) AS BIGINT), {_NEXT} FROM jumps WHERE j < {SHARDS + 1}),
s AS (SELECT r, max(j) FILTER (WHERE j < {SHARDS}) AS shard, max(j) FILTER (WHERE j < {SHARDS + 1}) AS grown FROM jumps GROUP BY r)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM keyed JOIN s USING (r)"""
}
