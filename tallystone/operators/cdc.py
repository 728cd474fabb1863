"""Change capture: a batch of listings against the stored state; versions, removals, repairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The fields that make a listing's content.
CONTENT = (
    "url", "title", "description", "purpose", "property_type", "is_resale", "resale_evidence", "price", "currency", "price_negotiable", "is_installment",
    "down_payment", "installment_months", "area_m2", "bedrooms", "bathrooms", "finishing", "delivery_status", "delivery_date", "compound", "developer",
    "governorate", "city", "district", "lat", "lng", "seller_type", "phone", "posted_at", "images",
)
# Fields that came later; they stay out of the hash while they are null.
LATE = ("delivery_date",)
KEY = ["source", "source_listing_id"]


def _plain(number: Column) -> Column:
    """A double as JSON writers print it: shortest digits, no exponent."""
    text = F.regexp_replace(number.cast("string").cast("decimal(38,12)").cast("string"), r"0+$", "")
    return F.when(F.endswith(text, F.lit(".")), F.concat(text, F.lit("0"))).otherwise(text)


def _json(name: str, kind: str) -> Column:
    c = F.col(name)
    # Most texts have nothing that JSON escapes, and are quoted as they are.
    escaped = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    quoted = lambda x: F.when(x.isNotNull(), F.when(x.rlike(r'["\\\\\x00-\x1f]'), escaped(x)).otherwise(F.concat(F.lit('"'), x, F.lit('"'))))
    if name == "images":
        items = F.from_json(c, "array<string>") if kind == "string" else c
        text = F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
    elif kind in ("double", "float"):
        text = _plain(c.cast("double"))
    elif kind in ("int", "bigint", "smallint", "tinyint", "boolean"):
        text = c.cast("string")
    elif kind.startswith("timestamp"):
        text = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit('"'))
    else:
        text = quoted(c.cast("string"))
    return F.coalesce(text, F.lit("null"))


def content_text(df: DataFrame) -> Column:
    """The content fields as one JSON object in order of their names; nulls are kept, but for LATE fields."""
    kinds, parts = dict(df.dtypes), []
    for c in sorted(CONTENT):
        part = F.concat(F.lit(f'"{c}": '), _json(c, kinds[c])) if c in kinds else F.lit(f'"{c}": null')
        parts.append((F.when(F.col(c).isNotNull(), part) if c in kinds else F.lit(None).cast("string")) if c in LATE else part)
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of content_text."""
    return F.sha2(content_text(df), 256)


def last_in_batch(batch: DataFrame, order: str = "arrival") -> DataFrame:
    """Of listings that occur more than once in a batch, the last."""
    if order not in batch.columns:
        return batch.dropDuplicates(KEY)
    values = [c for c in batch.columns if c not in KEY]
    return batch.groupBy(*KEY).agg(F.max_by(F.struct(*values), order).alias("r")).select(*KEY, "r.*")


def diff(fields: list[str], old: str = "old", new: str = "new") -> Column:
    """field → old and new value, of fields that differ (null is a value)."""
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.struct(text(old, c).alias("old"), text(new, c).alias("new")).alias("value")) for c in fields))
    return F.map_from_entries(F.filter(pairs, lambda p: ~p["value"]["old"].eqNullSafe(p["value"]["new"])))


def with_fills(listings: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Listings whose missing fields take stored fills, as long as the text is the one that was read.

    enrichments: the key, description_hash, status and applied (field → text).
    """
    e = enrichments.where("status = 'done'").select(*KEY, "description_hash", "applied")
    text = T.text_hash(T.listing_text(F.col("title"), F.col("description")))
    old = T.text_hash(F.coalesce(F.col("description"), F.lit("")))
    j = listings.join(e, KEY, "left")
    j = j.withColumn("applied", F.when((F.col("description_hash") == text) | (F.col("description_hash") == old), F.col("applied")))
    fill = lambda c: F.try_element_at("applied", F.lit(c))
    kinds = dict(listings.dtypes)
    evidence = F.col("is_resale").isNull() & fill("is_resale").isNotNull() & fill("resale_evidence").isNotNull()
    new = {c: F.when(T.is_missing(F.col(c)) & fill(c).isNotNull(), fill(c).try_cast(kinds[c])).otherwise(F.col(c)) for c in CONTENT if c in listings.columns and kinds[c] != "array<string>"}
    if "resale_evidence" in new:
        new["resale_evidence"] = F.when(evidence, fill("resale_evidence")).otherwise(new["resale_evidence"])
    return j.withColumns(new).drop("description_hash", "applied")


def upsert(state: DataFrame, batch: DataFrame, now: Column, enrichments: DataFrame | None = None) -> DataFrame:
    """Each key of the batch with what happens to it: action, changed_fields, old and new content.

    created, relisted, updated, or unchanged (the same hash, or no field that differs). A
    key that the state has twice is matched twice: it is a key.
    """
    fields = [c for c in CONTENT if c in batch.columns and c in state.columns]
    b = batch.withColumn("new_hash", content_hash(batch))
    b = with_fills(b, enrichments) if enrichments is not None else b
    s = state.withColumn("stored_hash", F.col("content_hash") if "content_hash" in state.columns else content_hash(state))
    s = s.select(*KEY, F.col("status").alias("was"), "stored_hash", F.struct(*fields).alias("old"))
    j = b.select(*KEY, "new_hash", F.struct(*fields).alias("new")).join(s, KEY, "left").withColumn("changed_fields", diff(fields))
    gone = F.col("was") == "removed"
    action = (
        F.when(F.col("was").isNull(), "created").when(gone, "relisted").when(F.col("stored_hash") == F.col("new_hash"), "unchanged")
        .when(F.size("changed_fields") == 0, "unchanged").otherwise("updated")
    )
    return j.withColumns({"action": action, "captured_at": now})


def apply_upsert(state: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The next state and the new versions; both are new tables, nothing is changed in place."""
    actions = upsert(state, batch, now)
    fields = [c for c in CONTENT if c in batch.columns and c in state.columns]
    # What is no content (the scope, the raw payload) comes with the listing as well.
    others = [c for c in state.columns if c in batch.columns and c not in (*fields, *KEY, "status", "first_seen_at", "last_seen_at", "content_hash")]
    a = actions.select(*KEY, "action", "new", "new_hash")
    if others:
        a = a.join(batch.select(*KEY, F.struct(*others).alias("other")), KEY)
    j = state.join(a, KEY, "full_outer")
    new = {c: F.when(F.col("action").isin("created", "updated", "relisted"), F.col(f"new.{c}")).otherwise(F.col(c)) for c in fields}
    seen = F.col("action").isNotNull()
    new |= {c: F.when(seen, F.col(f"other.{c}")).otherwise(F.col(c)) for c in others}
    new |= {"status": F.when(seen, "active").otherwise(F.col("status")), "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")), "first_seen_at": F.when(F.col("action") == "created", now).otherwise(F.col("first_seen_at"))}
    if "content_hash" in state.columns:
        new["content_hash"] = F.when(seen & (F.col("action") != "unchanged"), F.col("new_hash")).otherwise(F.col("content_hash"))
    versions = actions.where("action <> 'unchanged'").select(*KEY, "captured_at", F.col("action").alias("change_type"), F.to_json("new").alias("payload"), F.when(F.col("action") != "created", F.col("changed_fields")).alias("changed_fields"))
    return j.withColumns(new).select(*state.columns), versions


def mark_removals(state: DataFrame, scopes: DataFrame, now: Column) -> DataFrame:
    """The state after completed scopes (source, scope_key, cutoff): active listings there, not seen since the cutoff, are removed."""
    j = state.join(scopes.select("source", "scope_key", "cutoff"), ["source", "scope_key"], "left")
    gone = (F.col("status") == "active") & (F.col("last_seen_at") < F.col("cutoff"))
    gone = F.coalesce(gone, F.lit(False))
    out = j.withColumn("removed_now", gone).withColumn("status", F.when(gone, "removed").otherwise(F.col("status")))
    return out.withColumn("removed_at", F.when(gone, now)).select(*state.columns, "removed_now", "removed_at")


def removal_versions(marked: DataFrame) -> DataFrame:
    """A version for each listing that mark_removals has just removed."""
    fields = [c for c in CONTENT if c in marked.columns]
    gone = marked.where("removed_now")
    return gone.select(*KEY, F.col("removed_at").alias("captured_at"), F.lit("removed").alias("change_type"), F.to_json(F.struct(*fields)).alias("payload"), F.lit(None).cast("map<string,struct<old:string,new:string>>").alias("changed_fields"))


def finish_run(state: DataFrame, run: DataFrame, present: DataFrame | None, started: Column, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state, the removal versions and the run's row after the last batch of a run was written.

    run: one row of source, seen, n_distinct, complete, errors (array), crashed and
    scopes_completed (array). A run that saw the same listings over and over completes no
    scope; what a source calls present is confirmed before anything is removed.
    """
    repeats = (F.col("seen") >= 200) & (2 * F.col("n_distinct") < F.col("seen"))
    note = F.array(F.concat(F.lit("only "), F.col("n_distinct"), F.lit(" distinct listings in "), F.col("seen"), F.lit(" seen: paging repeats")))
    run = run.withColumn("repeats", repeats).withColumn("errors", F.when(F.col("repeats"), F.concat("errors", note)).otherwise(F.col("errors")))
    run = run.withColumn("scopes_completed", F.when(F.col("repeats") | F.col("crashed"), F.array().cast("array<string>")).otherwise(F.col("scopes_completed")))
    if present is not None:
        state = touch_present(state, present, now)
    scopes = run.select("source", F.explode("scopes_completed").alias("scope_key"), started.alias("cutoff"))
    marked = mark_removals(state, scopes, now)
    done = run_status(run.withColumn("n_errors", F.size("errors")))
    return marked.drop("removed_now", "removed_at"), removal_versions(marked), done


def touch_present(state: DataFrame, present: DataFrame, now: Column) -> DataFrame:
    """The state after some keys were confirmed without being read."""
    p = present.select(*KEY).distinct().withColumn("present", F.lit(True))
    j = state.join(p, KEY, "left")
    hit = F.col("present") & (F.col("status") == "active") & (F.col("last_seen_at") < now)
    return j.withColumn("last_seen_at", F.when(F.coalesce(hit, F.lit(False)), now).otherwise(F.col("last_seen_at"))).select(*state.columns)


def inventory_diff(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """Of each id: new, changed, same or gone, by the version that a site's inventory and the store have."""
    j = inventory.select("id", F.col("lastmod").alias("now"), F.lit(1).alias("i")).join(known.select("id", F.col("lastmod").alias("was"), F.lit(1).alias("k")), "id", "full_outer")
    kind = F.when(F.col("k").isNull(), "new").when(F.col("i").isNull(), "gone").when(~F.col("now").eqNullSafe(F.col("was")), "changed").otherwise("same")
    return j.select("id", kind.alias("kind"))


def renormalize(state: DataFrame, parse: Callable, schema: str) -> DataFrame:
    """Stored payloads parsed again, in place: no versions, and times stay. With changed, whether a row's content did.

    parse maps a pandas frame of (source, source_listing_id, raw) to rows of schema, of which
    those with another id than their payload's are left out.
    """
    parsed = state.where("raw IS NOT NULL").select("source", "source_listing_id", "raw").mapInPandas(lambda it: (parse(p) for p in it), schema)
    fields = [c for c in parsed.columns if c in CONTENT]
    j = state.join(parsed.select(*KEY, F.struct(*fields).alias("p")), KEY, "left")
    changed = F.col("p").isNotNull() & ~F.struct(*fields).eqNullSafe(F.col("p"))
    return j.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumns({c: F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)) for c in fields}).drop("p")


def canonical_types(state: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Type texts that are not canonical become the type that their words name."""
    found = T.property_type(F.col("property_type"))
    return state.withColumn("property_type", F.when(~F.col("property_type").isin(*known), F.coalesce(found, "property_type")).otherwise(F.col("property_type")))


def backfill(state: DataFrame, facts: DataFrame) -> DataFrame:
    """Empty fields take facts (the key and some fields); false may become true, known values stay."""
    fields = [c for c in facts.columns if c in CONTENT and c in state.columns]
    j = state.join(facts.select(*KEY, F.struct(*fields).alias("f")), KEY, "left")
    kinds = dict(state.dtypes)

    def new(c):
        fact = F.col(f"f.{c}").cast(kinds[c])
        free = T.is_missing(F.col(c))
        if kinds[c] == "boolean":
            free = free | (~F.col(c) & fact)
        if c == "down_payment":
            free = free & ~F.coalesce(fact >= F.col("price"), F.lit(False))
        return F.when(F.coalesce(free & fact.isNotNull(), F.lit(False)), fact).otherwise(F.col(c))

    return j.withColumns({c: new(c) for c in fields}).drop("f")


def backfill_extracted(state: DataFrame, extract: Callable[[pd.Series], pd.DataFrame], schema: str, column: str = "description") -> DataFrame:
    """backfill with the facts that extract reads from a column: it maps a series of texts to a frame of schema, a row for each. With changed, whether a row took any."""
    names = [f.split()[0] for f in schema.split(", ")]

    def facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = extract(f["text"].reset_index(drop=True))[names]
            yield pd.concat([f[KEY].reset_index(drop=True), found.reset_index(drop=True)], axis=1)

    texts = state.where(F.col(column).isNotNull()).select(*KEY, F.col(column).alias("text"))
    found = texts.mapInPandas(facts, f"source string, source_listing_id string, {schema}")
    own = [n for n in names if n in CONTENT and n in state.columns]
    after = backfill(state, found).select(*state.columns)
    was = state.select(*KEY, F.struct(*own).alias("_was"))
    return after.join(was, KEY).withColumn("changed", ~F.struct(*own).eqNullSafe(F.col("_was"))).drop("_was")


def run_status(runs: DataFrame) -> DataFrame:
    """completed, partial or failed: of seen, complete, n_errors and crashed."""
    ok = F.col("complete") & (F.col("n_errors") == 0)
    return runs.withColumn("status", F.when(F.col("crashed"), "failed").when(ok, "completed").when(F.col("seen") > 0, "partial").otherwise("failed"))


def repeats_itself(pages: DataFrame) -> DataFrame:
    """Of each run: whether its pages bring the same listings again (from 200 on, less than half distinct)."""
    g = pages.groupBy("run_id").agg(F.count(F.lit(1)).alias("seen"), F.count_distinct("listing_id").alias("n_distinct"))
    return g.withColumn("repeats", (F.col("seen") >= 200) & (2 * F.col("n_distinct") < F.col("seen")))


def price_history(versions: DataFrame) -> DataFrame:
    """Each version's price and the change from the one before (an extension of the change log)."""
    w = Window.partitionBy("property_id").orderBy("captured_at")
    v = versions.withColumn("before", F.lag("price").over(w))
    return v.withColumn("change", F.bround(F.try_divide(F.col("price"), F.col("before")) - 1, 4)).drop("before")
