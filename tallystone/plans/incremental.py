"""Compared records and figures of compounds, kept up to date by the changes alone.

A unit is compared within its compound only, so a change concerns the compounds where the
unit was and is. Tables lie in buckets of compounds; a refresh reads the buckets of those
compounds, compares them anew, and writes them under a new version. All other buckets are
pointed to where they are. Totals are sums: what touched compounds had is taken off, what
they have now is added. Readers see the version before until the new one is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, publish, rollup
from .storage import saver, write

BUCKETS = 64
#: Ids of changes that are broadcast; beyond that they are joined by key.
CHANGES = 1_000_000


def _bucket(buckets: int, key: str = "compound_key", own: str | None = "id") -> Column:
    """Of a compound; units outside any compound are spread by their id."""
    k = F.col(key)
    k = k if own is None else F.when(F.coalesce(k, F.lit("")) != "", k).otherwise(F.col(own).cast("string"))
    return F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")


def totals(records: DataFrame) -> DataFrame:
    """One row of sums over records: they add up over any parts."""
    resale = F.col("is_resale")
    one = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    levels = [one(resale & (F.col("level") == v)).alias(v) for v in compare.LEVELS]
    return records.agg(F.count(F.lit(1)).alias("eligible"), one(resale).alias("resale"), one(resale & (F.col("terms") == "plan")).alias("plans"), one(resale & F.col("peer_gap").isNotNull()).alias("ranked"), *levels)


@dataclass(frozen=True)
class Refresh:
    """What a refresh did."""

    version: str
    buckets: int
    rows_read: int
    rows_compared: int


def _next(spark: SparkSession, path: str) -> int:
    active = publish.active_version(spark, path)
    return 0 if active is None else int(active[1:]) + 1


def _written(df: DataFrame, path: str, buckets: int, own: str | None) -> set[int]:
    write(df.withColumn("bucket", _bucket(buckets, own=own)).repartition("bucket"), path, "bucket")
    return {r.bucket for r in df.sparkSession.read.parquet(path).select("bucket").distinct().collect()} if _has_parts(df.sparkSession, path) else set()


def _has_parts(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(s.isDirectory() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))


def _commit(spark: SparkSession, path: str, n: int, parts: dict[tuple[str, int], int], sums: dict, buckets: int) -> str:
    """The list of parts and the totals of a version, then the pointer."""
    version = f"v{n}"
    rows = [(t, b, e) for (t, b), e in sorted(parts.items())]
    spark.createDataFrame(rows, "table string, bucket int, epoch int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}/parts")
    spark.createDataFrame([(buckets, {k: int(v) for k, v in sums.items()})], "buckets int, sums map<string,long>").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}/sums")
    publish.activate(spark, path, version)
    return version


def _parts(spark: SparkSession, path: str, version: str) -> dict[tuple[str, int], int]:
    return {(r.table, r.bucket): r.epoch for r in spark.read.parquet(f"{path}/version={version}/parts").collect()}  # two rows a bucket at most


def read(spark: SparkSession, path: str, table: str, version: str | None = None, buckets: list[int] | None = None) -> DataFrame:
    """records or compounds of a version (the active one), or just some buckets of it."""
    version = version or publish.active_version(spark, path)
    if version is None:
        raise ValueError("nothing was built yet")
    parts = _parts(spark, path, version)
    found = [f"{path}/{table}/epoch={e}/bucket={b}" for (t, b), e in sorted(parts.items()) if t == table and (buckets is None or b in buckets)]
    if found:
        return spark.read.parquet(*found)
    b, e = next((b, e) for (t, b), e in sorted(parts.items()) if t == table)
    return spark.read.parquet(f"{path}/{table}/epoch={e}/bucket={b}").limit(0)


def sums(spark: SparkSession, path: str, version: str | None = None) -> dict[str, int]:
    """The totals of a version."""
    return spark.read.parquet(f"{path}/version={version or publish.active_version(spark, path)}/sums").first()["sums"]


def _compared(rows: DataFrame, matched: DataFrame, today: Column, save) -> DataFrame:
    """rows with comparisons and level, saved: comparisons first, then whole rows by id, so that only one step's shuffle is on disk at a time."""
    signals = compare.signals(rows, rows.where("is_resale"), matched, today, save)
    out = save(rows.join(signals, "id", "left"), "compared")
    save.drop("signals")
    return out


def build(resolved: DataFrame, matched: DataFrame, today: Column, path: str, buckets: int = BUCKETS) -> str:
    """The first version, or a new one made of everything."""
    spark = resolved.sparkSession
    save, n = saver(spark), _next(spark, path)
    records = _compared(resolved, matched, today, save)
    parts = {("records", b): n for b in _written(records, f"{path}/records/epoch={n}", buckets, "id")}
    save.drop("compared")
    records = spark.read.parquet(f"{path}/records/epoch={n}").drop("bucket")
    compounds = rollup.compounds(records.where("is_resale"), matched)
    parts |= {("compounds", b): n for b in _written(compounds, f"{path}/compounds/epoch={n}", buckets, None)}
    return _commit(spark, path, n, parts, totals(records).first().asDict(), buckets)


def refresh(changes: DataFrame, matched: DataFrame, today: Column, path: str) -> Refresh:
    """A new version after changes: rows of resolved columns with gone (the unit left) and old_key (its compound before, "" if none, null if new).

    An id changes once in a refresh. A unit that left needs its id and old_key only.
    """
    spark = changes.sparkSession
    save = saver(spark)
    active = publish.active_version(spark, path)
    if active is None:
        raise ValueError("nothing was built yet")
    buckets = spark.read.parquet(f"{path}/version={active}/sums").first()["buckets"]
    parts, n = _parts(spark, path, active), _next(spark, path)
    resolved = [c for c in changes.columns if c not in ("gone", "old_key")]
    ch = save(changes.withColumn("gone", F.coalesce("gone", F.lit(False))), "changes")
    stays = ch.where("NOT gone")
    keys = ch.select(F.col("old_key").alias("compound_key")).union(stays.select("compound_key")).where("coalesce(compound_key, '') <> ''").distinct()
    keys = save(keys, "keys")
    # Where touched rows are or will be: buckets of the compounds, and of units outside any.
    places = keys.select(_bucket(buckets, own=None).alias("b")).union(stays.select(_bucket(buckets).alias("b"))).union(ch.where("old_key = ''").select(_bucket(buckets, "old_key").alias("b")))
    touched = sorted(r.b for r in places.distinct().collect())  # `buckets` numbers at most
    old, ids = read(spark, path, "records", active, touched), ch.select("id")
    # Whole rows stay where they are.
    ids = F.broadcast(ids) if ids.limit(CHANGES + 1).count() <= CHANGES else ids
    kept = old.join(ids, "id", "left_anti")
    moving = kept.join(keys, "compound_key", "left_semi")
    again = save(moving.select(*resolved).unionByName(stays.select(*resolved)), "again")
    units = matched.join(keys, "compound_key", "left_semi")
    now = _compared(again, units, today, save)
    save.drop("again")
    carried = kept.join(keys, "compound_key", "left_anti")
    new_parts = {("records", b): n for b in _written(carried.unionByName(now), f"{path}/records/epoch={n}", buckets, "id")}
    figures = read(spark, path, "compounds", active, touched).join(keys, "compound_key", "left_anti")
    figures = figures.unionByName(rollup.compounds(now.where("is_resale"), units))
    new_parts |= {("compounds", b): n for b in _written(figures, f"{path}/compounds/epoch={n}", buckets, None)}
    gone = totals(old.join(keys, "compound_key", "left_semi").unionByName(old.where("coalesce(compound_key, '') = ''").join(ids, "id", "left_semi"))).first().asDict()
    came, before = totals(now).first().asDict(), sums(spark, path, active)
    after = {k: before[k] - gone[k] + came[k] for k in before}
    parts = {k: e for k, e in parts.items() if k[1] not in touched} | new_parts
    done = Refresh(_commit(spark, path, n, parts, after, buckets), len(touched), old.count(), now.count())
    save.drop("changes", "keys", "compared")
    return done
