"""A whole run of a source: read, written in batches under a time budget, closed with removals, reported."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc, replay
from ..operators.publish import bounded
from ..plans.places import numbered
from ..plans.storage import saver
from .readers import Run

#: Rows that are written at once.
BATCH = 100_000


@dataclass(frozen=True)
class Outcome:
    """What a run left: the next state, all versions, and the closing row with its counts."""

    state: DataFrame
    versions: DataFrame
    run: DataFrame


@contextmanager
def only_writer(spark: SparkSession, path: str, source: str) -> Iterator[bool]:
    """Whether this caller holds a source's lock: a file that nobody else could create. It goes at the end."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(f"{path}/locks/{source}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(at, False).close()
        held = True
    except Exception:  # noqa: BLE001  somebody else has it
        held = False
    try:
        yield held
    finally:
        if held:
            fs.delete(at, False)


def run_source(
    source: str, run: Run, state: DataFrame, started: str, now: str, *, order: str = "arrival", batch: int = BATCH, minutes: float | None = None,
    clock: Callable[[], float] = time.monotonic, save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> Outcome:
    """Writes what a source read into the state, in order of arrival.

    Without a budget of minutes all rows are folded at once, which leaves what batch after
    batch would, and reads the state once. With one, a batch is applied whole. When the budget is spent, the rest is left out and said so as
    an error: a run that stopped early is partial and removes nothing. What the source
    calls present is confirmed before anything is removed, and only scopes that were read
    to their end, without errors, lose what was not seen.
    """
    spark = state.sparkSession
    save = save or saver(spark)
    rows, at = run.rows.withColumn("source", F.lit(source)), F.lit(now).cast("timestamp")
    # Places are needed only where batches are cut.
    rows = save(rows, "arrivals").withColumn("place", F.lit(0)) if minutes is None else numbered(rows, [order, "source_listing_id"], save, "arrivals")
    total = rows.count()
    batch = total if minutes is None else batch
    end = clock() + 60 * minutes if minutes is not None else None
    errors, versions, taken = list(run.errors), None, 0
    while taken < total:
        part = rows.where((F.col("place") >= taken) & (F.col("place") < taken + batch)).drop("place")
        taken = min(total, taken + batch)
        step = saver(spark)
        state, new = replay.apply(state, part, at, order, save=step)
        state, new = save(state, f"state{taken}"), save(new, f"versions{taken}")
        step.drop("done")
        versions = new if versions is None else versions.unionByName(new)
        if end is not None and clock() > end and taken < total:
            errors.append(f"time budget of {minutes:g} min reached")
            break
    seen = rows.where(F.col("place") < taken)
    text = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    closing = seen.agg(F.count(F.lit(1)).alias("seen"), F.count_distinct("source_listing_id").alias("n_distinct")).select(
        F.lit(source).alias("source"), "seen", "n_distinct", F.lit(run.complete).alias("complete"), text(errors).alias("errors"), F.lit(False).alias("crashed"),
        text(run.scopes_completed if run.complete and not errors else ()).alias("scopes_completed"),
    )
    present = run.present.withColumn("source", F.lit(source)) if run.present is not None else None
    after, removed, done = cdc.finish_run(state, save(closing, "closing"), present, F.lit(started).cast("timestamp"), at)
    after, removed = save(after, "after"), save(removed.withColumn("step", F.lit(None).cast("string")), "removed")
    versions = removed if versions is None else versions.unionByName(removed, allowMissingColumns=True)
    counts = versions.agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in ("created", "updated", "relisted", "removed")))
    done = done.crossJoin(F.broadcast(counts)).withColumn("unchanged", F.col("seen") - F.col("created") - F.col("updated") - F.col("relisted"))  # one row each
    return Outcome(after, versions, done)


def report(frames: dict[str, DataFrame], path: str, most: int = 10_000) -> str:
    """Small tables as one JSON document at a path, written aside and renamed. A table that no reader of a report could take is an error."""
    spark = next(iter(frames.values())).sparkSession
    body = {name: [json.loads(r) for r in bounded(df, most).toJSON().collect()] for name, df in frames.items()}
    text = json.dumps(body, ensure_ascii=False, indent=1, sort_keys=True)
    jvm = spark._jvm.org.apache.hadoop.fs
    at, aside = jvm.Path(path), jvm.Path(f"{path}.new")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise RuntimeError(f"the report is not at {path}")
    return text
