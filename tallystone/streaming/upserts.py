"""Listings as a stream: micro-batches are folded into bucketed state; scopes that end remove what they did not see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cdc
from ..operators.publish import bounded

#: Buckets of the state: a micro-batch rewrites only those that it touches.
BUCKETS = 64
STALE_DAYS = 14


def _listed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the committed folders prefix=n below path."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith(f"{prefix}=") and fs.exists(jvm.Path(p, "_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*cdc.KEY), F.lit(buckets)).cast("int")


def state_of(spark: SparkSession, path: str, initial: DataFrame, before: int | None = None) -> DataFrame:
    """The state after the last committed epoch (or the last one before an epoch): each bucket as its latest epoch left it."""
    done = [n for n in _listed(spark, f"{path}/commits", "epoch") if before is None or n < before]
    if not done:
        return initial
    latest = spark.read.parquet(f"{path}/commits/epoch={done[-1]}")
    schema = ", ".join(f"{c} {t}" for c, t in initial.dtypes)
    parts = [f"{path}/state/epoch={r.epoch}/bucket={r.bucket}" for r in latest.collect()]  # BUCKETS rows at most
    return spark.read.schema(schema).parquet(*parts).select(*initial.columns) if parts else initial.limit(0)


def _parts(spark: SparkSession, path: str) -> list[int]:
    """Buckets that have files below path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory()]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))


def _touched(state: DataFrame, rows: DataFrame, ended: DataFrame | None, known: dict[int, int], buckets: int) -> list[int]:
    """Buckets that a batch changes: those of its listings, and those where a scope that ended has something to remove.

    To find the latter, four narrow columns of the state are read; the rest stays where it is.
    """
    if not known:
        return list(range(buckets))
    found = rows.select(_bucket(buckets).alias("b"))
    if ended is not None:
        unseen = state.where("status = 'active'").join(F.broadcast(bounded(ended)), ["source", "scope_key"]).where("last_seen_at < cutoff")
        found = found.union(unseen.select(_bucket(buckets).alias("b")))
    return sorted(r.b for r in found.distinct().collect())  # `buckets` numbers at most


def fold(batch: DataFrame, epoch: int, path: str, initial: DataFrame, buckets: int = BUCKETS) -> None:
    """One micro-batch becomes new contents of the buckets that it touches, and versions.

    Rows with end_of_scope mark that a scope (source, scope_key) was read to its end at
    observed_at: active listings there that were last seen before `scope_started` are
    removed. A batch that comes again writes the same; an empty one commits the state as
    it is. Buckets and versions are written first; the commit names the epoch of each
    bucket, and what no later epoch can need is dropped.
    """
    spark = batch.sparkSession
    done = _listed(spark, f"{path}/commits", "epoch")
    if epoch in done:
        return
    known = {}
    if before := [n for n in done if n < epoch]:
        known = {r.bucket: r.epoch for r in spark.read.parquet(f"{path}/commits/epoch={before[-1]}").collect()}
    batch = batch.persist()  # read several times below
    try:
        marks = batch.where("end_of_scope") if "end_of_scope" in batch.columns else None
        rows = batch.where("NOT coalesce(end_of_scope, false)").drop("end_of_scope", "scope_started") if marks is not None else batch
        now = batch.agg(F.max("observed_at")).first()[0]
        if now is not None or not known:
            state = state_of(spark, path, initial, epoch)
            ended = None
            if marks is not None and not marks.isEmpty():
                ended = marks.groupBy("source", "scope_key").agg(F.max("scope_started").alias("cutoff"))
            touched = _touched(state, rows, ended, known, buckets)
            state = state.where(_bucket(buckets).isin(*touched))
            if now is not None:
                at = F.lit(now).cast("timestamp")
                state, versions = cdc.apply_upsert(state, cdc.last_in_batch(rows, "observed_at"), at)
                if ended is not None:
                    marked = cdc.mark_removals(state, ended, at)
                    versions, state = versions.unionByName(cdc.removal_versions(marked)), marked.drop("removed_now", "removed_at")
                versions.write.mode("overwrite").parquet(f"{path}/versions/epoch={epoch}")
            state.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/epoch={epoch}")
            written = _parts(spark, f"{path}/state/epoch={epoch}")
            known = {b: e for b, e in known.items() if b not in touched} | {b: epoch for b in written}
    finally:
        batch.unpersist()
    commit = spark.createDataFrame(sorted(known.items()), "bucket int, epoch long")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/epoch={epoch}")  # last: its _SUCCESS commits the batch
    # The commit before this one may still be read, or be the one to go back to.
    kept = set(known.values()) | ({r.epoch for r in spark.read.parquet(f"{path}/commits/epoch={before[-1]}").collect()} if before else set())
    for n in _listed(spark, f"{path}/state", "epoch"):
        if n < epoch and n not in kept:
            _drop(spark, f"{path}/state/epoch={n}")


def start(stream: DataFrame, path: str, initial: DataFrame, trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Runs fold for every micro-batch of a stream of listings with observed_at."""
    q = stream.writeStream.foreachBatch(lambda b, e: fold(b, e, path, initial, buckets))
    return q.option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def stale(stream: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """source, source_listing_id, last_seen of listings not seen for some days of event time, once each time that happens.

    A session window by listing closes when the watermark passes its last observation by
    `days`: Spark keeps one row of state for each listing that is still seen.
    """
    w = stream.withWatermark("observed_at", "0 seconds")
    g = w.groupBy(F.session_window("observed_at", f"{days} days"), *cdc.KEY).agg(F.max("observed_at").alias("last_seen"))
    return g.select(*cdc.KEY, "last_seen")


def still_seen(stream: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """Windows of days in which each source's listings were seen; an extension for watching feeds."""
    w = stream.withWatermark("observed_at", f"{days} days")
    return w.groupBy(F.window("observed_at", "1 day"), "source").agg(F.approx_count_distinct("source_listing_id").alias("listings"))
