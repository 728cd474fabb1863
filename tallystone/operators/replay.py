"""Batches in which a listing occurs several times: every step in order of arrival, with a version for each change.

A step is judged against what the steps before it left: the hash of the step before, and
the content that was last written. Both run along a listing's rows, which cross the network
once, without their hashes where these can be formed afterwards. A listing with very many
rows, be they a third of a batch, is not brought together: its rows lie in sorted ranges,
each range works on its own, and hands the last hash and the last written content on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.places import range_of, ranges
from ..plans.storage import saver
from . import cdc

KEY = cdc.KEY
#: Rows of one listing in a batch beyond which it is folded along ranges; listings of a batch up to which only their stored rows are read on; rows that a task should sort.
HOT, FEW, ROWS = 100_000, 100_000, 150_000


def _handed_on(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the last non-null value of earlier rows of the key: in the range, else in the ranges before.

    Only keys that cross a border of ranges are handed on: at most one row for each border.
    """
    own = Window.partitionBy("_range", *KEY).orderBy("_at")
    rows = rows.withColumn(name, F.last(value, True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy("_range").agg(F.min(F.struct("_at", *KEY)).alias("first"), F.max(F.struct("_at", *KEY)).alias("last"))
    edge = lambda c: ends.select("_range", *(F.col(f"{c}.{k}").alias(k) for k in KEY))
    # Keys at either end of a range; those inside it lie in no other.
    crossing = edge("first").unionByName(edge("last")).distinct()
    left = rows.join(F.broadcast(crossing), ["_range", *KEY]).groupBy("_range", *KEY).agg(F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias("_left"))
    before = Window.partitionBy(*KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("_range", *KEY, F.last("_left", True).over(before).alias("_from"))
    return rows.join(F.broadcast(left), ["_range", *KEY], "left").withColumn(name, F.coalesce(name, "_from")).drop("_from")


def _changed(rows: DataFrame) -> Column:
    """Whether a row differs from what was there: from nothing, another hash, or a removed listing."""
    return F.col("_was").isNull() | (F.col("_was._hash") != F.col("_hash")) | (F.col("_was.status") == "removed")


def _along_ranges(rows: DataFrame, save: Callable) -> DataFrame:
    """Rows of listings that have very many: _was, _written, _before, _at, and of the listing _final, _moved and _met."""
    rows = ranges(rows, [*KEY, F.col("_status").isNull(), F.asc_nulls_first("_order"), "_hash"], save, "steps").withColumn("_range", range_of())
    rows = _handed_on(rows, _state(), "_was")
    rows = save(rows.withColumn("_written", F.when(F.col("_status").isNotNull() | _changed(rows), F.col("_content"))), "written")
    rows = _handed_on(rows, F.col("_written"), "_before")
    met = F.col("scope").isNotNull()
    own = rows.where("_status IS NULL").groupBy(*KEY).agg(F.max("_at").alias("_end"), F.max_by("scope", F.when(F.col("_written").isNotNull() & met, F.col("_at"))).alias("_moved"), F.min_by("scope", F.when(met, F.col("_at"))).alias("_met"))
    return rows.drop("_range").join(F.broadcast(own), KEY).withColumn("_final", F.col("_at") == F.col("_end")).drop("_end")  # few listings have so many rows


def _state() -> Column:
    return F.struct("_hash", F.coalesce("_status", F.lit("active")).alias("status"))


def _along_windows(rows: DataFrame) -> DataFrame:
    """The same of other listings; rows come together by their key."""
    w = Window.partitionBy(*KEY).orderBy(F.col("_status").isNull(), F.asc_nulls_first("_order"), "_hash")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_was", F.lag(_state()).over(w))
    rows = rows.withColumn("_written", F.when(F.col("_status").isNotNull() | _changed(rows), F.col("_content")))
    return rows.withColumns({
        "_before": F.last("_written", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_at": F.row_number().over(w).cast("long"), "_final": F.lead("_hash").over(w).isNull(),
        "_moved": F.last(F.when(F.col("_written").isNotNull(), F.col("scope")), True).over(upto), "_met": F.first("scope", True).over(upto),
    })


def _folded(state: DataFrame, batch: DataFrame, order: str, enrichments: DataFrame | None, save: Callable, others: list[str], hot: int) -> DataFrame:
    """steps, and of each row whether it is its listing's last (final), the scopes that came up to it (moved, met), and its other columns (rest)."""
    fields = [c for c in cdc.CONTENT if c in batch.columns and c in state.columns]
    kinds = [{c: k for c, k in df.dtypes if c in cdc.CONTENT} for df in (state, batch)]
    # Hashes are long and alike in nothing: they are formed where rows have come together, if the content has all that they need.
    afterwards = enrichments is None and "content_hash" not in state.columns and kinds[0] == kinds[1]
    null = F.lit(None).cast("string")
    counts = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    most, total, listings = save(counts.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("listings")), "counts").first()
    # A task sorts its rows in memory: what is spilled lies on disk twice.
    tasks = max(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(((total or 0) + listings) / ROWS))
    stored = state
    if listings <= FEW:
        stored = state.join(F.broadcast(batch.select(*KEY).distinct()), KEY, "left_semi")

    def rows(hashed: bool) -> DataFrame:
        b = batch.withColumn("_hash", cdc.content_hash(batch) if hashed else null)
        b = cdc.with_fills(b, enrichments) if enrichments is not None else b
        scope = F.col("scope_key") if "scope_key" in batch.columns else null
        b = b.select(*KEY, scope.alias("scope"), F.col(order).alias("_order"), "_hash", F.struct(*fields).alias("_content"), null.alias("_status"), F.struct(*(others or [F.lit(1)])).alias("_rest"))
        known = F.coalesce("content_hash", cdc.content_hash(state)) if "content_hash" in state.columns else cdc.content_hash(state)
        kind = dict(b.dtypes)
        # What is stored is the step before the first.
        s = stored.select(*KEY, null.alias("scope"), F.lit(None).cast(kind["_order"]).alias("_order"), (known if hashed else null).alias("_hash"), F.struct(*fields).alias("_content"), F.col("status").alias("_status"), F.lit(None).cast(kind["_rest"]).alias("_rest"))
        return s.unionByName(b)

    cold, out = rows(not afterwards), None
    if (most or 0) > hot:
        often = F.broadcast(save(counts.where(F.col("n") > hot).select(*KEY), "often"))  # a batch has few such
        cold, out = cold.join(often, KEY, "left_anti"), _along_ranges(rows(True).join(often, KEY, "left_semi"), save)
    cold = cold.repartition(tasks, *KEY)
    if afterwards:
        cold = cold.select("*", *(F.col(f"_content.{c}").alias(c) for c in fields))
        cold = cold.withColumn("_hash", cdc.content_hash(cold)).drop(*fields)
    cold = _along_windows(cold)
    out = cold if out is None else cold.unionByName(out.select(*cold.columns))
    out = out.where("_status IS NULL").withColumns({"old": F.col("_before"), "new": F.coalesce("_written", "_before")})
    # What was not written has no difference.
    out = out.withColumn("changed_fields", F.when(F.col("_written").isNotNull(), cdc.diff(fields)).otherwise(F.create_map().cast("map<string,struct<old:string,new:string>>")))
    gone = F.col("_was.status") == "removed"
    action = F.when(F.col("_was").isNull(), "created").when(gone, "relisted").when(F.col("_written").isNull() | (F.size("changed_fields") == 0), "unchanged").otherwise("updated")
    out = out.withColumn("action", action)
    return out.select(
        *KEY, F.col("_order").cast("string").alias("step"), F.col("_at").alias("place"), F.col("_hash").alias("hash"), F.col("_written").isNotNull().alias("written"), "scope", "action", F.when(F.col("action") != "created", F.col("changed_fields")).alias("changed_fields"),
        "old", "new", F.col("_final").alias("final"), F.col("_moved").alias("moved"), F.col("_met").alias("met"), F.col("_rest").alias("rest"),
    )


def steps(state: DataFrame, batch: DataFrame, order: str = "arrival", enrichments: DataFrame | None = None, save: Callable | None = None, hot: int = HOT) -> DataFrame:
    """Every row of the batch, in order, with its action, changed_fields and the content before and after; place grows along a listing's rows.

    created, relisted, updated or unchanged, as if each row were a batch of its own. Rows
    of a key that tie in `order` come in the order of their hashes.
    """
    save = save or saver(batch.sparkSession)
    return _folded(state, batch, order, enrichments, save, [], hot).drop("final", "moved", "met", "rest")


def versions(done: DataFrame, now: Column) -> DataFrame:
    """A version for each step that changed something."""
    return done.where("action <> 'unchanged'").select(*KEY, "step", now.alias("captured_at"), F.col("action").alias("change_type"), F.to_json("new").alias("payload"), "changed_fields")


def apply(state: DataFrame, batch: DataFrame, now: Column, order: str = "arrival", enrichments: DataFrame | None = None, save: Callable | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The next state and all versions of a batch in which listings may occur more than once.

    Content is what the last step left; what is no content comes with the last row. The
    scope is the last one that came with a written step, else what is stored, else the
    first that came.
    """
    save = save or saver(batch.sparkSession)
    fields = [c for c in cdc.CONTENT if c in batch.columns and c in state.columns]
    others = [c for c in state.columns if c in batch.columns and c not in (*fields, *KEY, "status", "first_seen_at", "last_seen_at", "content_hash")]
    done = _folded(state, batch, order, enrichments, save, others, hot)
    # What was written, and what was there at the end: other steps left nothing.
    done = save(done.drop("old", "place", "written", "scope").where("final OR action <> 'unchanged'"), "done")
    last = done.where("final").select(*KEY, F.struct("new", "hash").alias("last"), "moved", "met", "rest")
    j = state.withColumn("_stored", F.lit(True)).join(last, KEY, "full_outer")
    seen = F.col("last").isNotNull()
    new = {c: F.when(seen, F.col(f"last.new.{c}")).otherwise(F.col(c)) for c in fields}
    for c in others:
        came = F.coalesce("moved", c, "met") if c == "scope_key" else F.col(f"rest.{c}")
        new[c] = F.when(seen, came).otherwise(F.col(c))
    new |= {"status": F.when(seen, "active").otherwise(F.col("status")), "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")), "first_seen_at": F.when(F.col("_stored").isNull(), now).otherwise(F.col("first_seen_at"))}
    if "content_hash" in state.columns:
        new["content_hash"] = F.when(seen, F.col("last.hash")).otherwise(F.col("content_hash"))
    return j.withColumns(new).select(*state.columns), versions(done, now)
