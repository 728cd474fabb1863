"""Health of sources from the log of their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS, STALE_HOURS, ABANDONED_HOURS, DROP = 60, 36, 6, 0.5


def close_abandoned(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that have been running for too long failed."""
    late = (F.col("status") == "running") & (now.cast("long") - F.col("started_at").cast("long") > ABANDONED_HOURS * 3600)
    out = runs.withColumns({"closed": F.coalesce(late, F.lit(False))})
    if "errors" in runs.columns:
        note = F.array(F.lit("abandoned: the process ended before the run finished"))
        out = out.withColumn("errors", F.when(F.col("closed"), F.concat(F.coalesce("errors", F.array().cast("array<string>")), note)).otherwise(F.col("errors")))
    return out.withColumns({"status": F.when(F.col("closed"), "failed").otherwise(F.col("status")), "finished_at": F.when(F.col("closed"), now).otherwise(F.col("finished_at"))})


def scope_key(params: Column) -> Column:
    """A run's parameters without its budgets, in order."""
    kept = F.map_filter(params, lambda k, _: ~k.isin("max_pages", "max_details", "details"))
    return F.to_json(F.sort_array(F.map_entries(kept)))


def source_health(runs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """A state for each source: never, running, failing, stale, dropped or ok, tested in this order.

    runs: id, source, scope, started_at, finished_at, status, seen. Only the latest RUNS
    of a source count; the usual yield is the median of up to five runs of the same scope
    before the last good one.
    """
    latest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    r = runs.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= RUNS)
    good = r.where("status IN ('completed', 'partial') AND coalesce(seen, 0) > 0")
    first = good.groupBy("source").agg(F.min_by(F.struct("n", F.coalesce("finished_at", "started_at").alias("at"), "scope", "seen"), "n").alias("g"))
    same = good.join(first, "source").where(F.col("scope").eqNullSafe(F.col("g.scope"))).withColumn("k", F.row_number().over(latest))
    typical = same.where("k BETWEEN 2 AND 6").groupBy("source").agg(F.median("seen").alias("typical_seen"))
    ended = r.where("status <> 'running'").withColumn("k", F.row_number().over(latest)).where("k <= 2").groupBy("source").agg(F.count(F.lit(1)).alias("ended"), F.expr("count_if(status = 'failed')").alias("failed"))
    last = r.where("n = 1").select("source", F.col("started_at").alias("last_run"), F.col("status").alias("last_status"))
    out = sources.select("source").distinct()
    for part in (last, first.select("source", F.col("g.at").alias("last_success"), F.col("g.seen").alias("last_seen")), typical, ended):
        out = out.join(part, "source", "left")
    hours = lambda c: (now.cast("long") - F.col(c).cast("long")) / 3600
    state = (
        F.when(F.col("last_run").isNull(), "never").when((F.col("last_status") == "running") & (hours("last_run") <= ABANDONED_HOURS), "running").when(F.col("last_success").isNull(), "failing")
        .when((F.col("ended") == 2) & (F.col("failed") == 2), "failing").when(hours("last_success") > STALE_HOURS, "stale").when((F.col("typical_seen") > 0) & (F.col("last_seen") < DROP * F.col("typical_seen")), "dropped").otherwise("ok")
    )
    return out.select("source", state.alias("state"), "last_run", "last_status", "last_success", F.coalesce("last_seen", F.lit(0)).cast("long").alias("last_seen"), "typical_seen")


def totals(runs: DataFrame) -> DataFrame:
    """Runs of each source by how they ended."""
    kinds = ("completed", "partial", "failed", "running")
    return runs.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum("seen").cast("long").alias("seen"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))


def active_plan(plan: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """The scopes (source, params, budget_minutes) of the sources in use, with a label each; all of them where sources is None."""
    p = plan if sources is None else plan.where(F.col("source").isin(*sources))
    pairs = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return p.withColumn("label", F.trim(F.concat_ws(" ", "source", F.array_join(pairs, " "))))


def windows(runs: DataFrame, length: str = "1 day") -> DataFrame:
    """Runs and what they saw, by source and window of their start; the same on a stream with a watermark."""
    g = runs.groupBy(F.window("started_at", length), "source").agg(F.count(F.lit(1)).alias("runs"), F.sum("seen").alias("seen"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.select(F.col("window.start").alias("start"), "source", "runs", "seen", "failed")
