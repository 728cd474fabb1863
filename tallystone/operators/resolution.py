"""Names sent to a resolver in batches, and what comes back. The resolver itself is a function that callers bring."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.places import numbered
from ..plans.storage import saver
from .entities import validated
from .publish import bounded

BATCH = 120


def batches(pairs: DataFrame, size: int = BATCH) -> DataFrame:
    """pairs with batch and position: the most listed first. Saved, so that nobody who uses it twice sees two numberings."""
    at = numbered(pairs, [F.desc("listings"), F.asc("key")], saver(pairs.sparkSession), "batches")
    return at.withColumns({"batch": F.floor(F.col("place") / size).cast("long"), "position": (F.col("place") % size).cast("int")}).drop("place")


def prompts(batched: DataFrame, reference: str = "", known: str = "", developers: str = "") -> DataFrame:
    """batch and text of each request: the listed compounds, developers and names known already, and the batch's items as JSON."""
    item = F.struct(F.col("position").alias("id"), "compound", "developer", F.col("district").alias("area"), "listings")
    items = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("i"))
    text = F.to_json(F.transform("i", lambda x: x["item"]), {"ignoreNullFields": "false"})
    head = f"Give one entry for each of the items below, with its id.\n\nreference:\n{reference}\n\ndevelopers:\n{developers}\n\nknown:\n{known}\n\nitems:\n"
    return items.select("batch", F.concat(F.lit(head), text).alias("text"))


def reference_lines(reference: DataFrame, most: int = 20_000) -> tuple[str, str]:
    """The listed compounds and developers as lines of a prompt; more than a prompt could hold is an error."""
    rows = bounded(reference, most).select("compound", "developer", "area").orderBy("compound").collect()
    lines = [f"{r.compound} | {r.developer or ''} | {r.area or ''}" for r in rows]
    return "\n".join(lines), "\n".join(sorted({r.developer for r in rows if r.developer}))


_FIELDS = ("kind", "compound", "developer", "reference", "confidence")
_ANSWERS = "batch long, position int, nth int, " + ", ".join(f"{c} string" for c in _FIELDS) + ", error string"


def _rows(batch: int, got: list[dict] | None, error: str | None) -> list[tuple]:
    """The answers to one batch, and one row without a position that says that it was asked."""
    answers = [a for a in got or [] if isinstance(a, dict) and isinstance(a.get("id"), int)]
    return [(batch, None, None, *(None for _ in _FIELDS), error)] + [(batch, a["id"], k, *(a.get(c) for c in _FIELDS), None) for k, a in enumerate(answers)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _ANSWERS.split(", ")]).astype({"position": "Int32", "nth": "Int32"})


def _asked(invoke: Callable[[str], list[dict]], batch: int, text: str) -> list[tuple]:
    try:
        return _rows(batch, invoke(text), None)
    except RuntimeError as e:
        return _rows(batch, None, str(e))


def answers(requests: DataFrame, invoke: Callable[[str], list[dict]]) -> DataFrame:
    """batch, position, nth (of the batch's answers), kind, compound, developer, reference, confidence and error; a row without a position for each batch that was asked.

    invoke is called once for a batch, in a task; a batch whose call fails does not stop
    the others. Answers are saved at once: whoever reads them later asks nobody again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield _frame([r for batch, text in zip(f["batch"], f["text"], strict=True) for r in _asked(invoke, batch, text)])

    return saver(requests.sparkSession)(requests.mapInPandas(run, _ANSWERS), "answers")


def within_limits(requests: DataFrame, invoke: Callable[[str], list[dict]], workers: int = 4, breaker: int = 2, minutes: float | None = None) -> DataFrame:
    """answers, but as a resolver with limits is asked: at most `workers` at once, the most listed batches first.

    After `breaker` batches in a row without a single answer nothing more is asked, nor
    after the deadline; what is under way is waited for. Batches that were not asked have
    no row, so that no attempt is counted. One task holds the connection: the limits are
    the resolver's, not the data's, and a request is a few kilobytes.
    """
    if workers < 1 or breaker < 1:
        raise ValueError("workers and breaker must be positive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        todo = (pair for f in frames for pair in zip(f["batch"], f["text"], strict=True))
        end = time.monotonic() + 60 * minutes if minutes is not None else None
        failures, tripped, running, out = 0, False, {}, []
        with ThreadPoolExecutor(workers) as pool:
            while True:
                while len(running) < workers and not tripped and (end is None or time.monotonic() < end):
                    pair = next(todo, None)
                    if pair is None:
                        break
                    running[pool.submit(_asked, invoke, *pair)] = pair[0]
                if not running:
                    break
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for d in sorted(done, key=running.get):
                    running.pop(d)
                    rows = d.result()
                    failures = 0 if len(rows) > 1 else failures + 1
                    tripped |= failures >= breaker  # and stays so, whatever is still under way
                    out += rows
        # In order of batches, whichever was ready first.
        yield _frame(sorted(out, key=lambda r: (r[0], r[2] is not None, r[2] or 0)))

    ordered = requests.coalesce(1).sortWithinPartitions("batch")
    return saver(requests.sparkSession)(ordered.mapInPandas(run, _ANSWERS), "answers")


def resolved(batched: DataFrame, got: DataFrame, stored: DataFrame, reference: DataFrame) -> DataFrame:
    """The rows to store, one for each pair: validated answers (the first of an id), or failed ones, with one attempt more.

    stored: key, attempts. An id beyond its batch is no answer. Batches that were not asked
    leave no row.
    """
    first = got.where("position IS NOT NULL").groupBy("batch", "position").agg(F.min_by(F.struct(*_FIELDS), "nth").alias("a")).select("batch", "position", "a.*")
    batched = batched.join(got.select("batch").distinct(), "batch", "left_semi")
    wrong = got.where("error IS NOT NULL").groupBy("batch").agg(F.min("error").alias("error"))
    a = batched.select("key", "batch", "position").join(first, ["batch", "position"])
    done = validated(a.select("key", "kind", "compound", "developer", "reference", "confidence"), batched, reference)
    out = batched.select("key", "batch", F.col("listings")).join(done, "key", "left").join(wrong, "batch", "left")
    out = out.join(stored.select("key", "attempts"), "key", "left").join(a.select("key", F.lit(True).alias("answered")), "key", "left")
    ok = F.coalesce("answered", F.lit(False))
    return out.select(
        "key", "listings", F.when(ok, "done").otherwise("failed").alias("status"), (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempts"), "kind", "compound", "developer", "reference", "confidence",
        F.when(F.size("notes") > 0, F.col("notes")).alias("notes"), F.when(~ok, F.coalesce("error", F.lit("missing from the answer"))).alias("error"),
    )
