"""How far a paged run was read, and whether it is complete, from its attempts at pages.

Nothing runs over the pages of a run one after another: a fifth failure in a row is a page
that five failed pages point to, and the end is the least page at which anything ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts after which a missing page is the end; failed pages in a row that stop a run.
VERIFIED, FAILURES = 3, 5

# What an attempt may come to.
OUTCOMES = ("ok", "not_found", "http_error", "blocked", "fetch_error", "unreadable")


def pages(attempts: DataFrame, verified: int = VERIFIED) -> DataFrame:
    """What each page of each run came to: its last attempt, and for a missing page whether it was asked for often enough.

    attempts: run_id, page, attempt, outcome, units, total, page_size, error. An outcome
    that is not known counts as an HTTP error.
    """
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("http_error")
    last = F.max_by(F.struct(known.alias("outcome"), "units", "total", "page_size", "error"), "attempt").alias("last")
    g = attempts.groupBy("run_id", "page").agg(last, F.expr("count_if(outcome = 'not_found')").alias("missing"))
    return g.select("run_id", "page", "last.*", ((F.col("last.outcome") == "not_found") & (F.col("missing") >= verified)).alias("verified"))


def ends(page_rows: DataFrame, most: int | None = None, failures: int = FAILURES) -> DataFrame:
    """run_id, page and kind of where each run ends: the least page of any that ends it.

    natural: a verified missing page, an empty one, or the one that reaches the total.
    stopped: an error that ends a run, or the last of `failures` failed pages in a row.
    cut: the caller's limit. gap: the page after it was not asked for.
    """
    natural = F.col("verified") | ((F.col("outcome") == "ok") & ((F.coalesce("units", F.lit(0)) == 0) | (F.col("page") * F.coalesce(F.nullif("page_size", F.lit(0)), F.lit(12)) >= F.coalesce("total", F.lit(0)))))
    stopped = ~F.col("verified") & F.col("outcome").isin("not_found", "http_error", "blocked", "unreadable")
    kind = F.when(natural, "natural").when(stopped, "stopped")
    if most is not None:
        kind = F.coalesce(kind, F.when((F.col("outcome") == "ok") & (F.col("page") >= most), "cut"))
    own = page_rows.select("run_id", "page", kind.alias("kind")).where("kind IS NOT NULL")
    failed = page_rows.where("outcome = 'fetch_error'").select("run_id", F.explode(F.sequence(F.col("page"), F.col("page") + failures - 1)).alias("page"), F.col("page").alias("by"))
    row = failed.groupBy("run_id", "page").agg(F.count(F.lit(1)).alias("n"), F.max("by").alias("last")).where((F.col("n") == failures) & (F.col("last") == F.col("page")))
    after = page_rows.select("run_id", (F.col("page") - 1).alias("page"))
    gap = page_rows.select("run_id", "page").join(after, ["run_id", "page"], "left_anti")
    every = own.unionByName(row.select("run_id", "page", F.lit("stopped").alias("kind"))).unionByName(gap.withColumn("kind", F.lit("gap")))
    # Of a page that ends a run and has no successor, the reason counts.
    order = F.struct("page", (F.col("kind") == "gap").alias("late"), "kind")
    return every.groupBy("run_id").agg(F.min(order).alias("m")).select("run_id", F.col("m.page").alias("page"), F.col("m.kind").alias("kind"))


def read_pages(attempts: DataFrame, most: int | None = None, failures: int = FAILURES, verified: int = VERIFIED) -> DataFrame:
    """The pages that count as read: up to their run's end; pages after it are not looked at, whatever they hold. With the end's kind.

    A run is read from page 1: where that was not asked for, nothing was read.
    """
    rows = pages(attempts, verified)
    first = rows.where("page = 1").select("run_id")
    stop = ends(rows, most, failures).join(first, "run_id", "left_semi")
    return rows.join(stop.select("run_id", F.col("page").alias("end"), "kind"), "run_id").where("page <= end")


def closed(attempts: DataFrame, most: int | None = None, failures: int = FAILURES, verified: int = VERIFIED) -> DataFrame:
    """A row for each run: pages_fetched, seen, complete, errors (in order of pages) and scopes_completed.

    A page that failed is an error and is skipped, so that a run may reach its natural end
    and still remove nothing; a verified end is no error.
    """
    rows = read_pages(attempts, most, failures, verified)
    got = F.col("outcome").isin("ok", "unreadable")
    error = F.when((F.col("outcome") != "ok") & ~F.col("verified"), F.struct("page", F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), F.coalesce("error", "outcome")).alias("text")))
    g = rows.groupBy("run_id").agg(
        F.count_if(got).alias("pages_fetched"), F.coalesce(F.sum(F.when(F.col("outcome") == "ok", F.col("units"))), F.lit(0)).cast("long").alias("seen"), F.max("end").alias("end"),
        F.first("kind").alias("kind"), F.transform(F.array_sort(F.collect_list(error)), lambda e: e["text"]).alias("errors"),
    )
    done = F.col("kind") == "natural"
    scopes = F.when(done, F.array(F.lit("all"))).otherwise(F.array().cast("array<string>"))
    every = attempts.select("run_id").distinct()
    out = every.join(g.withColumns({"complete": done, "scopes_completed": scopes}), "run_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "run_id", F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "end", F.coalesce("kind", F.lit("unread")).alias("kind"),
        F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("errors", none).alias("errors"), F.coalesce("scopes_completed", none).alias("scopes_completed"),
    )
