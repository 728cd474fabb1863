"""Queries over batches, runs, versions and refreshes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _PROFILE, _PROFILE_COLUMNS, _SLUG, COMPARED, ELIGIBLE, _aliases, _query, _snap
from .functions import text as T
from .operators import cdc, clean, compare, entities, publish, replay, resolution, rollup, survival, term_index, trends
from .plans import adapter, checkpoints, incremental
from .plans.adapter import LATEST, LISTING_SQL, table
from .plans.storage import folder, saver
from .sources import paging, runs
from .sources.readers import Run

_NOW = "2001-08-02"


def _at(text: str):
    return F.lit(text).cast("timestamp")


# ---- places and batches, every row ---------------------------------------------------------------


def _batched_orders(s, d):
    o = table(s, d, "orders")
    pairs = o.select(F.col("o_orderkey").cast("string").alias("key"), (F.col("o_custkey") % 500).alias("listings"))
    return resolution.batches(pairs).select("key", "batch", F.col("position").cast("long").alias("position"))


_query("batched_orders", None, """WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, row_number() OVER (ORDER BY o_custkey % 500 DESC, CAST(o_orderkey AS VARCHAR)) - 1 AS place FROM orders)
SELECT key, place // 120 AS batch, place % 120 AS position FROM p""")(_batched_orders)


def _staged_lines(s, d):
    """Lines of uneven size, of which 40 always fit; from the stretch's start, batches close by number."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(1000) + F.col("l_partkey") % 6000).alias("size"))
    out = publish.staging(rows, "size", ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "place", F.col("batch.stretch").alias("stretch"), F.col("batch.n").cast("long").alias("batch"))


_query("staged_lines", None, """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS place FROM lineitem)
SELECT l_orderkey, l_linenumber, place, place // 1000 AS stretch, (place % 1000) // 40 AS batch FROM p""")(_staged_lines)


def _staged_by_bytes(s, d):
    """Orders of 12,000 bytes: 24 of them and their separators fit."""
    out = publish.staging(table(s, d, "orders").select("o_orderkey", F.lit(12_000).alias("size")), "size", ["o_orderkey"])
    return out.select("o_orderkey", F.col("batch.stretch").alias("stretch"), F.col("batch.n").cast("long").alias("batch"))


_query("staged_by_bytes", None, """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT o_orderkey, place // 1000 AS stretch, (place % 1000) // 24 AS batch FROM p""")(_staged_by_bytes)

# ---- batches in which listings occur several times -------------------------------------------------


def _again_and_again(s, d):
    """Each listing four times: cheaper, cheaper still for some, back, and as it was."""
    x = saver(s)(adapter.listings(s, d), "listings")  # read as state and as batch
    cheaper = F.bround(F.col("price") * 0.95)
    price = F.when(F.col("arrival") == 1, cheaper).when((F.col("arrival") == 2) & (F.col("id") % 2 == 0), F.bround(F.col("price") * 0.9)).when(F.col("arrival") == 2, cheaper).otherwise(F.col("price"))
    return x.where("id % 17 <> 0"), x.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("arrival")).withColumn("price", price)


def _steps(s, d):
    state, batch = _again_and_again(s, d)
    out = replay.steps(state, batch)
    old = F.col("changed_fields")["price"]["old"].cast("double")
    return out.select(F.col("source_listing_id").cast("long").alias("id"), F.col("step").cast("long").alias("step"), "action", F.when(F.col("action") == "updated", old).alias("old_price"), F.col("new.price").alias("price"))


_STEPS = """, b AS (SELECT id, status, s.step, CASE WHEN s.step = 1 OR (s.step = 2 AND id % 2 = 1) THEN round_even(price * 0.95, 0) WHEN s.step = 2 THEN round_even(price * 0.9, 0) ELSE price END AS price, price AS stored
  FROM listing, (SELECT unnest(range(4)) AS step) s),
w AS (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY step) AS was FROM b),
a AS (SELECT id, step, price, was, CASE WHEN step = 0 AND id % 17 = 0 THEN 'created' WHEN step = 0 AND status = 'removed' THEN 'relisted' WHEN step = 0 OR price = was THEN 'unchanged' ELSE 'updated' END AS action FROM w)
SELECT id, step, action, CASE WHEN action = 'updated' THEN was END AS old_price, price FROM a"""
_query("repeated_listings", LISTING_SQL, _STEPS)(_steps)


def _after_steps(s, d):
    state, batch = _again_and_again(s, d)
    after, versions = replay.apply(state, batch, _at(_NOW))
    n = versions.groupBy("source", "source_listing_id").agg(F.count(F.lit(1)).alias("versions"))
    return after.join(n, ["source", "source_listing_id"], "left").select(F.col("source_listing_id").cast("long").alias("id"), "price", "status", F.coalesce("versions", F.lit(0)).alias("versions"))


_query("repeated_state", LISTING_SQL, _STEPS[: _STEPS.rindex("SELECT")] + "SELECT id, arg_max(price, step) AS price, 'active' AS status, count(*) FILTER (WHERE action <> 'unchanged') AS versions FROM a GROUP BY id")(_after_steps)

# ---- ends of paged runs ----------------------------------------------------------------------------


def _attempts(s, d):
    """A run for sixteen orders and a page for each: some fail in rows of five, some end at a missing page, some have no units."""
    o = table(s, d, "orders").select((F.col("o_orderkey") / 16).cast("long").alias("run_id"), (F.col("o_orderkey") % 16 + 1).cast("int").alias("page"), F.col("o_custkey").alias("k"))
    r, k = F.col("run_id") % 4, F.col("k")
    outcome = (
        F.when((r == 1) & (k % 9 > 1), "fetch_error").when((r == 2) & (k % 13 == 0), "not_found").when((r == 2) & (k % 29 == 0), "blocked")
        .when((r == 3) & (k % 17 == 0), "unreadable").otherwise("ok")
    )
    tries = F.when(F.col("outcome") == "not_found", F.when(k % 2 == 0, 3).otherwise(2)).otherwise(1)
    o = o.where("k % 61 <> 5").withColumn("outcome", outcome).select("*", F.explode(F.sequence(F.lit(1), tries)).alias("attempt"))
    units = F.when((r == 0) & (k % 23 == 0), 0).otherwise(12)
    return o.select("run_id", "page", "attempt", "outcome", units.alias("units"), F.lit(180).alias("total"), F.lit(12).alias("page_size"), F.lit(None).cast("string").alias("error"))


_RUNS = """WITH o AS (SELECT o_orderkey // 16 AS run_id, o_orderkey % 16 + 1 AS page, o_custkey AS k, (o_orderkey // 16) % 4 AS r FROM orders WHERE o_custkey % 61 <> 5),
p AS (SELECT run_id, page, k % 2 = 0 AS thrice, CASE WHEN r = 0 AND k % 23 = 0 THEN 0 ELSE 12 END AS units,
  CASE WHEN r = 1 AND k % 9 > 1 THEN 'fetch_error' WHEN r = 2 AND k % 13 = 0 THEN 'not_found' WHEN r = 2 AND k % 29 = 0 THEN 'blocked' WHEN r = 3 AND k % 17 = 0 THEN 'unreadable' ELSE 'ok' END AS outcome FROM o),
isl AS (SELECT *, page - row_number() OVER (PARTITION BY run_id, outcome = 'fetch_error' ORDER BY page) AS island FROM p),
inrow AS (SELECT *, row_number() OVER (PARTITION BY run_id, outcome = 'fetch_error', island ORDER BY page) AS nth, lead(page) OVER (PARTITION BY run_id ORDER BY page) AS next FROM isl),
k AS (SELECT *, CASE WHEN outcome = 'not_found' AND thrice THEN 'natural' WHEN outcome = 'ok' AND (units = 0 OR page * 12 >= 180) THEN 'natural' WHEN outcome IN ('not_found', 'blocked', 'unreadable') THEN 'stopped'
    WHEN outcome = 'fetch_error' AND nth = 5 THEN 'stopped' WHEN next IS NULL OR next <> page + 1 THEN 'gap' END AS kind FROM inrow),
e AS (SELECT run_id, min(page) AS "end", arg_min(kind, page) AS kind FROM k WHERE kind IS NOT NULL GROUP BY run_id),
r AS (SELECT k.*, e."end", e.kind AS how FROM k JOIN e ON e.run_id = k.run_id AND k.page <= e."end" WHERE EXISTS (SELECT 1 FROM p f WHERE f.run_id = k.run_id AND f.page = 1)),
g AS (SELECT run_id, count(*) FILTER (WHERE outcome IN ('ok', 'unreadable')) AS pages_fetched, sum(units) FILTER (WHERE outcome = 'ok') AS seen, max("end") AS "end", max(how) AS kind,
  string_agg('page ' || page || ': ' || outcome, ', ' ORDER BY page) FILTER (WHERE outcome <> 'ok' AND NOT (outcome = 'not_found' AND thrice)) AS errors FROM r GROUP BY run_id)
SELECT a.run_id, coalesce(pages_fetched, 0) AS pages_fetched, CAST(coalesce(seen, 0) AS BIGINT) AS seen, "end", coalesce(kind, 'unread') AS kind, coalesce(kind = 'natural', false) AS complete, coalesce(errors, '') AS errors
FROM (SELECT DISTINCT run_id FROM p) a LEFT JOIN g ON g.run_id = a.run_id"""
_query("paged_runs", None, _RUNS)(
    lambda s, d: paging.closed(_attempts(s, d)).select("run_id", "pages_fetched", "seen", F.col("end").cast("long").alias("end"), "kind", "complete", F.array_join("errors", ", ").alias("errors"))
)

# ---- whole runs, payloads parsed again ---------------------------------------------------------------


def _whole_run(s, d):
    """A later crawl of one source: batches in order, what is present confirmed, scopes of one region ended."""
    x = saver(s)(adapter.listings(s, d).where("source = 'portal'"), "listings")  # read as state, as batch, for scopes and for what is present
    price = F.when(F.col("id") % 11 == 0, F.bround(F.col("price") * 0.95)).otherwise(F.col("price"))
    rows = x.where("id % 13 <> 0").withColumn("price", price).withColumn("arrival", F.col("id")).drop("source", "status", "first_seen_at", "last_seen_at", "id")
    scopes = tuple(r.scope_key for r in x.where("scope_key LIKE 'ASIA/%'").select("scope_key").distinct().collect())  # one for each kind of unit
    present = x.where("id % 13 = 0 AND id % 2 = 0").select("source_listing_id")
    run = Run(rows, True, scopes, present)
    out = runs.run_source("portal", run, x.where("id % 17 <> 0").drop("id"), f"{_NOW} 00:00:00", f"{_NOW} 06:00:00", batch=50_000)
    kinds = out.versions.groupBy("source_listing_id").agg(F.array_join(F.array_sort(F.collect_list("change_type")), ",").alias("versions"))
    return out.state.join(kinds, "source_listing_id", "left").select(F.col("source_listing_id").cast("long").alias("id"), "status", "price", F.coalesce("versions", F.lit("")).alias("versions"))


_query("whole_run", LISTING_SQL, """, w AS (SELECT *, id % 17 <> 0 AS known, id % 13 <> 0 AS crawled, CASE WHEN id % 13 <> 0 AND id % 11 = 0 THEN round_even(price * 0.95, 0) ELSE price END AS now_price,
    status = 'active' AND scope_key LIKE 'ASIA/%' AND id % 13 = 0 AND id % 2 = 1 AS gone FROM listing WHERE source = 'portal')
SELECT id, CASE WHEN crawled THEN 'active' WHEN gone THEN 'removed' ELSE status END AS status, now_price AS price,
  CASE WHEN crawled AND NOT known THEN 'created' WHEN crawled AND status = 'removed' THEN 'relisted' WHEN crawled AND now_price <> price THEN 'updated' WHEN gone AND NOT crawled THEN 'removed' ELSE '' END AS versions FROM w WHERE known OR crawled""")(_whole_run)


def _parsed_again(s, d):
    def parse(frame):
        return frame[["source", "source_listing_id"]].assign(title="parsed " + frame["raw"])

    x = adapter.listings(s, d).withColumn("raw", F.when(F.col("id") % 2 == 0, F.col("source_listing_id")))
    return cdc.renormalize(x, parse, "source string, source_listing_id string, title string").select("id", "title", "changed")


_query("parsed_again", LISTING_SQL, "SELECT id, CASE WHEN id % 2 = 0 THEN 'parsed ' || id ELSE title END AS title, id % 2 = 0 AS changed FROM listing")(_parsed_again)

# ---- names in Arabic -------------------------------------------------------------------------------


def _asked_in_arabic(s, d):
    """Units described by a compound's Arabic name, which aliases brought and records voted for."""
    aliases = _aliases(s, d).withColumns({"compound_ar": F.concat(F.lit("آسيا "), F.regexp_extract("compound", r"(\d+)", 1)), "developer_ar": F.lit("أراضي آسيا")})
    applied, _ = entities.apply_aliases(_snap(s, d).projected.where("source <> 'benchmark'"), aliases)
    rows = entities.resolve(applied, saver(s))
    c = rows.where("compound_key <> ''").groupBy(F.col("compound_key").alias("key")).agg(F.max("compound").alias("name"), F.max("developer_key").alias("developer_key"), F.max("compound_ar").alias("name_ar"), F.max("developer_ar").alias("developer_ar"), F.count(F.lit(1)).alias("position"))
    ask = c.where("name_ar IS NOT NULL").select(F.abs(F.hash("key")).cast("long").alias("request_id"), F.lit("villa").alias("property_type"), F.lit(100.0).alias("area_m2"), F.lit(1e6).alias("price"), F.concat(F.lit(" "), "name_ar").alias("compound"),
        F.lit(None).cast("double").alias("down_payment"), F.lit(None).cast("double").alias("installment_years"), F.lit("ready").alias("delivery"), F.lit("finished").alias("finishing"))
    snap = _snap(s, d)
    got = compare.evaluate(ask, c, snap.default, snap.matched, snap.today)
    return got.join(c, F.col("compound_key") == F.col("key")).select("compound_key", "status", "name_ar", "developer_ar")


_query("arabic_lookup", ELIGIBLE, r"""SELECT DISTINCT 'asia-' || regexp_extract(compound, '^Brand#(\d+)', 1) AS compound_key, 'compared' AS status, 'آسيا ' || regexp_extract(compound, '^Brand#(\d+)', 1) AS name_ar, 'أراضي آسيا' AS developer_ar
  FROM proj WHERE source <> 'benchmark' AND compound LIKE '% ASIA%'""")(_asked_in_arabic)

# ---- time on the market ----------------------------------------------------------------------------


def _versions(s, d):
    """Created when first seen; some removed, and of these some listed again."""
    x = adapter.listings(s, d).select("id", "first_seen_at", F.col("scope_key").alias("kind"))
    day = lambda n: F.col("first_seen_at") + F.make_dt_interval(days=(F.col("id") % n + 1).cast("int"))
    change = lambda at, kind: F.struct(at.alias("captured_at"), F.lit(kind).alias("change_type"))
    end, again = change(day(300), "removed"), change(day(300) + F.expr("INTERVAL 30 DAYS"), "relisted")
    all_ = F.array_compact(F.array(change(F.col("first_seen_at"), "created"), F.when(F.col("id") % 3 > 0, end), F.when(F.col("id") % 6 == 1, again)))
    return x.select(F.col("id").alias("property_id"), "kind", F.explode(all_).alias("c")).select("property_id", "kind", "c.*")


def _staying(s, d):
    v = _versions(s, d)
    spells = survival.spells(v, _at(LATEST)).join(v.select("property_id", "kind").distinct(), "property_id")
    return survival.survival(spells, ["kind"])


_SPELLS = """, sp AS (SELECT id, scope_key AS kind, CASE WHEN id % 3 > 0 THEN id % 300 + 1 ELSE greatest(date_diff('day', CAST(first_seen_at AS DATE), DATE '{at}'), 0) END AS days, id % 3 > 0 AS gone FROM listing
  UNION ALL SELECT id, scope_key, greatest(date_diff('day', CAST(first_seen_at AS DATE) + CAST(id % 300 + 31 AS INTEGER), DATE '{at}'), 0), false FROM listing WHERE id % 6 = 1),
bd AS (SELECT kind, days, count(*) AS n, count(*) FILTER (WHERE gone) AS ended FROM sp GROUP BY 1, 2),
ar AS (SELECT *, CAST(sum(n) OVER (PARTITION BY kind ORDER BY days DESC) AS BIGINT) AS at_risk FROM bd),
sv AS (SELECT kind, days, at_risk, ended, round(CASE WHEN bool_or(ended = at_risk) OVER w THEN 0 ELSE exp(sum(CASE WHEN ended < at_risk THEN ln(1 - ended / at_risk) ELSE 0 END) OVER w) END, 6) AS survival FROM ar WINDOW w AS (PARTITION BY kind ORDER BY days))
""".replace("{at}", LATEST)
_query("time_to_delist", LISTING_SQL, _SPELLS + "SELECT * FROM sv WHERE ended > 0")(_staying)
_query("median_stay", LISTING_SQL, _SPELLS + "SELECT kind, min(days) FILTER (WHERE survival <= 0.5) AS median_days, max(at_risk) AS spells, CAST(sum(ended) AS BIGINT) AS ended FROM sv WHERE ended > 0 GROUP BY kind")(
    lambda s, d: survival.medians(_staying(s, d), ["kind"]).withColumn("median_days", F.col("median_days").cast("long"))
)

# ---- asking prices over time -----------------------------------------------------------------------


def _monthly(s, d):
    x = adapter.listings(s, d).where("status = 'active' AND area_m2 > 0")
    return trends.sketched(x.withColumn("ppm", F.bround(F.col("price") / F.col("area_m2"))), ["district"], "ppm", F.col("first_seen_at"))


def _price_trend(s, d):
    """By district and month, and over all from the same sketches; a quantile that is off by more than the bound fails."""
    m = _monthly(s, d)
    year = trends.merged(m.withColumn("year", F.year("month")), ["year"])
    own = adapter.listings(s, d).where("status = 'active' AND area_m2 > 0").select(F.year("first_seen_at").alias("year"), F.bround(F.col("price") / F.col("area_m2")).alias("ppm"))
    q = trends.quantiles(year, {"median": 0.5})
    share = own.join(F.broadcast(q.select("year", "median")), "year").groupBy("year").agg(F.avg((F.col("ppm") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("ppm") <= F.col("median")).cast("double")).alias("upto"))
    # The rank of the sketch's median among the values themselves.
    near = (F.col("below") <= 0.5 + 0.0165) & (F.col("upto") >= 0.5 - 0.0165)
    return q.join(share, "year").select(F.col("year").cast("long").alias("year"), "n", F.col("least").alias("least"), F.col("most").alias("most"), near.alias("within_bound"))


_query("price_trend", LISTING_SQL, "SELECT year(first_seen_at) AS year, count(*) AS n, min(round_even(price / area_m2, 0)) AS least, max(round_even(price / area_m2, 0)) AS most, true AS within_bound FROM listing WHERE status = 'active' AND area_m2 > 0 GROUP BY 1")(_price_trend)

# ---- all levels, terms, refreshes, checkpoints -------------------------------------------------------

_LEVEL_ROWS = " UNION ALL ".join(
    f"SELECT '{level}' AS level, {key} AS key, {_PROFILE} FROM resale {where}" + (f" GROUP BY {key}" if key != "NULL" else "")
    for level, key, where in (("compound", "compound_key", "WHERE compound_key <> ''"), ("developer", "developer_key", "WHERE developer_key <> ''"), ("district", _SLUG.format("district"), ""), ("all", "NULL", ""))
)
_query("level_figures", COMPARED, _LEVEL_ROWS)(lambda s, d: rollup.all_levels(_snap(s, d).resale).select("level", "key", *_PROFILE_COLUMNS))

_WORDS = ("asia", "brand#1 africa", "phase 2", "eu", "brand#12 europe phase", "nosuchword")


def _found(s, d):
    path = f"{folder(s)}/terms"
    term_index.build(adapter.listings(s, d), "id", ["title", "district", "compound", "developer"], path)
    hits = term_index.search(s, path, list(_WORDS))
    return hits.select(F.element_at(F.array(*map(F.lit, _WORDS)), F.col("query") + 1).alias("words"), "id")


_SAID = "lower(concat_ws(' ', coalesce(title, ''), coalesce(district, ''), coalesce(compound, ''), coalesce(developer, '')))"
_query("terms_by_index", LISTING_SQL, " UNION ALL ".join(f"SELECT '{w}' AS words, id FROM listing WHERE " + " AND ".join(f"contains({_SAID}, '{t}')" for t in w.split()) for w in _WORDS))(_found)

_FINISHING = "CASE rf WHEN 'A' THEN 'lux' WHEN 'N' THEN 'semi_finished' ELSE '-' END AS finishing"
_REFINISHED = COMPARED.replace(_FINISHING, "CASE WHEN id % 41 = 3 THEN 'semi_finished' WHEN rf = 'A' THEN 'lux' WHEN rf = 'N' THEN 'semi_finished' ELSE '-' END AS finishing")


def _refreshed(s, d, name):
    """Built once, then brought up to date: some listings were finished otherwise. Only their compounds are compared again."""
    snap, path, today = _snap(s, d), f"{folder(s)}/served", F.lit(LATEST).cast("date")
    incremental.build(snap.resolved, snap.matched, today, path)
    new = snap.resolved.where("id % 41 = 3").withColumn("finishing", F.lit("semi_finished")).withColumn("finishing_class", T.finishing_class(F.col("finishing")))
    changes = new.withColumn("unknowns", clean.unknowns()).withColumns({"gone": F.lit(False), "old_key": F.coalesce("compound_key", F.lit(""))})
    incremental.refresh(changes, snap.matched, today, path)
    return incremental.read(s, path, name)


_query("refreshed_levels", _REFINISHED, "SELECT id, finishing_class, launch_gap, peer_gap, level, score FROM units")(
    lambda s, d: _refreshed(s, d, "records").select("id", "finishing_class", "launch_gap", "peer_gap", "level", "score")
)
_query("refreshed_compounds", _REFINISHED, f"SELECT compound_key, {_PROFILE} FROM resale GROUP BY compound_key")(lambda s, d: _refreshed(s, d, "compounds").select("compound_key", *_PROFILE_COLUMNS))


def _checkpointed(s, d):
    """A table saved twice with some rows changed between: what is restored, and how few ranges were written again."""
    path, o = f"{folder(s)}/checkpoint", table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    checkpoints.save(o, path, ["o_orderkey"])
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, 1.0).otherwise(F.col("o_totalprice")))
    again = checkpoints.save(changed, path, ["o_orderkey"])
    return checkpoints.restore(s, path).withColumn("ranges_written", F.lit(len(again.written)).cast("long"))


_query("checkpointed_orders", None, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 7 THEN 1.0 ELSE o_totalprice END AS o_totalprice, (SELECT count(*) FROM orders WHERE o_orderkey = 7) AS ranges_written FROM orders")(_checkpointed)
