"""More queries over the driver's tables: details, listings as they are stored, runs, name resolution, publication, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _DEV, _LEVELS, _NEAR, _PAIRS, _SLUG, COMPARED, RANK, RESOLVED, _crawl, _query, _snap
from .functions import money as M
from .functions import text as T
from .operators import cdc, compare, entities, health, publish, resolution, rollup, search, views
from .plans import adapter
from .plans.adapter import LATEST, LISTING_SQL, RUNS_SQL, table
from .sources import cards

_NOW = "2001-08-02"


def _at(text: str):
    return F.lit(text).cast("timestamp")


# ---- details and entities ------------------------------------------------------------------------

_PUBLIC = ["id", "source", "source_url", "property_type", "class", "price", "compound", "developer", "delivery_bucket", "terms", "cash_equivalent", "launch_gap", "peer_gap", "level", "score", "photo"]
_query("public_units", COMPARED, """SELECT id, source, url AS source_url, kind AS property_type, class, price, compound_display AS compound, developer_display AS developer, delivery_bucket, terms, cash_equivalent, launch_gap, peer_gap, level, score,
    CAST(NULL AS VARCHAR) AS photo FROM units""")(lambda s, d: views.public_unit(_snap(s, d).records).select(*_PUBLIC))
_NEAREST = f"""ca AS (SELECT a.id, b.id AS other_id, b.cash_equivalent / b.area_m2 AS ppm, abs(ln(b.area_m2 / a.area_m2)) AS dist, a.finishing_class = b.finishing_class AND a.finishing_class <> 'unknown' AS same
  FROM units a JOIN units b ON a.compound_key = b.compound_key AND a.kind = b.kind AND a.id <> b.id AND {_NEAR} AND b.is_resale AND coalesce(b.cash_equivalent, 0) <> 0),
cb AS (SELECT *, count(*) FILTER (WHERE same) OVER (PARTITION BY id) AS ns FROM ca),
cl AS (SELECT a.id, b.id AS other_id, b.cash_equivalent / b.area_m2 AS ppm, abs(ln(b.area_m2 / a.area_m2)) AS dist FROM units a JOIN units b ON a.compound_key = b.compound_key AND a.class IS NOT DISTINCT FROM b.class AND a.id <> b.id
  AND b.is_resale AND coalesce(b.cash_equivalent, 0) <> 0 WHERE a.id NOT IN (SELECT id FROM ca)),
cc AS (SELECT id, other_id, ppm, dist FROM cb WHERE ns < 4 OR same UNION ALL SELECT id, other_id, ppm, dist FROM cl),
near AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, other_id) AS position, other_id, round_even(ppm, 0) AS cash_ppm FROM cc QUALIFY position <= 60)"""


def _details(s, d):
    z = _snap(s, d)
    return views.details(z.records, adapter.listings(s, d), compare.comparable_lists(z.resolved, z.default))


def _counted(s, d):
    """Details with the number of comparables and the first: lists of all are made, and counted where they are made, so that no list crosses the network."""
    z = _snap(s, d)
    lists = compare.comparable_lists(z.resolved, z.default).select("id", F.size("comparables").alias("comparables"), F.get("comparables", F.lit(0))["id"].alias("first_id"))
    return views.details(z.resolved.join(z.signals, "id", "left"), adapter.listings(s, d), lists)


_query("unit_details", f"{COMPARED}, {_NEAREST}", """SELECT u.id, u.level, l.p_text AS description, coalesce(n.c, 0) AS comparables, n.first_id FROM units u
    JOIN (SELECT o_orderkey AS id, p_name || ' call [contact withheld]' AS p_text FROM raw0) l ON l.id = u.id LEFT JOIN (SELECT id, count(*) AS c, min(other_id) FILTER (WHERE position = 1) AS first_id FROM near GROUP BY id) n ON n.id = u.id""")(
    lambda s, d: _counted(s, d).select("id", "level", "description", F.coalesce("comparables", F.lit(0)).cast("long").alias("comparables"), "first_id")
)
_query("rehydrated_comparables", f"{COMPARED}, {_NEAREST}", "SELECT n.id AS of, n.position - 1 AS position, n.other_id AS id, n.cash_ppm, u.price, u.level FROM near n JOIN units u ON u.id = n.other_id")(
    lambda s, d: views.rehydrated(_details(s, d), _snap(s, d).records).select("of", F.col("position").cast("long").alias("position"), "id", "cash_ppm", "price", "level")
)
_query("late_materialisation", COMPARED, f"SELECT id, title, price, row_number() OVER (ORDER BY {RANK}) AS place FROM resale ORDER BY place LIMIT 30")(
    lambda s, d: (lambda z: views.late(search.page_of(search.unit_query(z.records).select("id"), 1, 30), z.records.select("id", "title", "price")))(_snap(s, d)).withColumn("place", F.col("place").cast("long"))
)
_query("entity_links", COMPARED, """SELECT u.id, u.compound_key, u.developer_key, c.n AS compound_units, d.n AS developer_units FROM units u LEFT JOIN (SELECT compound_key, count(*) AS n FROM resale GROUP BY 1) c ON c.compound_key = u.compound_key
    LEFT JOIN (SELECT developer_key, count(*) AS n FROM resale GROUP BY 1) d ON d.developer_key = u.developer_key""")(lambda s, d: (lambda z: views.entity_links(z.records, z.compounds, z.developers))(_snap(s, d)))
_query("entity_detail", COMPARED, f"SELECT compound_key, count(*) AS units, {_LEVELS} FROM resale WHERE compound_key LIKE 'brand-1%' GROUP BY 1 ORDER BY units DESC, compound_key LIMIT 1")(
    lambda s, d: (lambda c: views.one(c, "compound_key", c.where(F.startswith("compound_key", F.lit("brand-1"))).orderBy(F.desc("units"), "compound_key").first()["compound_key"]).select("compound_key", "units", *compare.LEVELS))(_snap(s, d).compounds)
)
_query("link_lookup", RESOLVED, "SELECT min(id) AS id, 'example.com/unit/102' AS url_key FROM res WHERE id = 102 HAVING count(*) = 1")(lambda s, d: search.lookup_url(rollup.unique_urls(_snap(s, d).resolved), "HTTPS://www.EXAMPLE.com/unit/102/?q=1"))
_query("developer_compounds", COMPARED, f"""SELECT g.*, row_number() OVER (PARTITION BY developer_key ORDER BY units DESC, compound_key) AS place FROM (SELECT compound_key, arg_min(developer_key, ({RANK.replace("n_signals DESC", "-n_signals")})) AS developer_key, count(*) AS units,
    count(*) FILTER (WHERE level IN ('strong', 'good')) AS good_count FROM resale GROUP BY 1) g""")(lambda s, d: rollup.developer_compounds(_snap(s, d).compounds).select("developer_key", F.col("place").cast("long").alias("place"), "compound_key", "units", "good_count"))
_query("developer_districts", COMPARED, "SELECT developer_key, district, count(*) AS units, row_number() OVER (PARTITION BY developer_key ORDER BY count(*) DESC, min(id)) AS place FROM resale GROUP BY 1, 2")(
    lambda s, d: rollup.developer_districts(_snap(s, d).resale).withColumn("place", F.col("place").cast("long"))
)
_query("district_classes", COMPARED, f"""SELECT o.*, v.developer_ppm FROM (SELECT {_SLUG.format('district')} AS district_key, class, count(*) AS units, round_even(median(price_per_m2), -2) AS median_asking_ppm FROM resale WHERE class IS NOT NULL GROUP BY 1, 2) o
    LEFT JOIN (SELECT c.district_key, m.class, round_even(median(m.price_per_m2), -2) AS developer_ppm FROM matched m JOIN (SELECT DISTINCT compound_key, {_SLUG.format('district')} AS district_key FROM resale) c ON c.compound_key = m.compound_key WHERE m.class IS NOT NULL GROUP BY 1, 2) v
    ON v.district_key = o.district_key AND v.class = o.class""")(lambda s, d: (lambda z: rollup.district_classes(z.resale, z.matched, z.compounds))(_snap(s, d)).select("district_key", "class", "units", "median_asking_ppm", "developer_ppm"))
_query("finishing_counts", COMPARED, "SELECT compound_key, finishing_class, count(*) AS units FROM resale GROUP BY 1, 2")(lambda s, d: rollup.finishing_counts(_snap(s, d).resale, ["compound_key"]))
_query("coverage", COMPARED, f"""SELECT count(*) AS launch_units, count(compound_key) AS launch_matched, count(DISTINCT compound_key) AS launch_compounds, count(*) - count(compound_key) AS launch_unmatched,
    (SELECT count(*) FROM (SELECT compound_key FROM resale GROUP BY 1 HAVING count(*) >= 5)) AS compound_count, (SELECT count(*) FROM (SELECT developer_key FROM resale GROUP BY 1 HAVING count(*) >= 5)) AS developer_count,
    (SELECT count(*) FROM (SELECT {_SLUG.format('district')} AS k FROM resale GROUP BY 1 HAVING count(*) >= 5)) AS district_count FROM matched""")(lambda s, d: (lambda z: rollup.coverage(z.matched, z.compounds, z.developers, z.districts))(_snap(s, d)))
_query("level_thresholds", None, "SELECT * FROM (VALUES ('strong_all', -0.15), ('strong_one', -0.25), ('good_all', -0.05), ('good_one', -0.1), ('pricier', 0.1), ('check_developer', -0.7), ('check_peers', -0.6), ('check_cheapest', -0.25)) t(rule, value)")(
    lambda s, d: s.createDataFrame(list(rollup.thresholds().items()), "rule string, value double")
)
_query("catalog_compounds", COMPARED, "SELECT compound_key, any_value(compound_display) AS compound, any_value(district) AS district, count(*) AS units FROM resale GROUP BY 1")(lambda s, d: _snap(s, d).compounds.select("compound_key", "compound", "district", "units"))
_query("observation_window", COMPARED, """SELECT max(last_seen_at) AS last_updated, min(first_seen_at) AS first_observed, date_diff('day', CAST(min(first_seen_at) AS DATE), CAST(max(last_seen_at) AS DATE)) + 1 AS observation_days,
    (SELECT round_even(median(round(discount * 10000)) FILTER (WHERE terms = 'plan'), 0) / 10000 FROM resale) AS plan_median_discount FROM allrows""")(
    lambda s, d: (lambda z: rollup.observed(z.raw, z.roles.primary).join(F.broadcast(z.default.agg(rollup.plan_discount()))))(_snap(s, d)).select("last_updated", "first_observed", F.col("observation_days").cast("long").alias("observation_days"), "plan_median_discount")
)
_query("freshness_ids", RESOLVED, "SELECT id FROM proj")(lambda s, d: _snap(s, d).projected.select("id"))
_query("source_subset", RESOLVED, "SELECT id, source FROM proj WHERE source IN ('portal', 'contract')")(lambda s, d: _snap(s, d).projected.where(F.col("source").isin("portal", "contract")).select("id", "source"))


def _arabic(s, d):
    """Every third listing of a compound has an Arabic name, which depends on its id."""
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("اسم "), (F.col("id") % 2).cast("string")))
    return entities.arabic_names(_snap(s, d).resolved.withColumn("ar", name), "compound_key", "ar")


_query("arabic_names", RESOLVED, """SELECT compound_key, name_ar FROM (SELECT compound_key, 'اسم ' || CAST(id % 2 AS VARCHAR) AS name_ar, row_number() OVER (PARTITION BY compound_key ORDER BY count(*) DESC, min(id)) AS k FROM res WHERE id % 3 = 0 GROUP BY 1, 2) WHERE k = 1""")(_arabic)
_query("full_ranking", COMPARED, f"SELECT id, row_number() OVER (ORDER BY {RANK}) - 1 AS rank FROM units")(lambda s, d: compare.all_ranks(_snap(s, d).signals))
_query("purchase_costs", RESOLVED, """SELECT id, price - coalesce(remaining, 0) + price * 0.05 + price * 0.025 + price * 0.0 AS at_signing, coalesce(remaining, 0) + CASE WHEN delivery_bucket = 'ready' THEN 0.0 ELSE price * 0.08 END AS later,
    coalesce(cash_equivalent, price) + (price * 0.05 + price * 0.025 + price * 0.0) + CASE WHEN delivery_bucket = 'ready' THEN 0.0 ELSE price * 0.08 END AS all_in FROM res""")(
    lambda s, d: _snap(s, d).resolved.select("id", M.costs(F.col("price"), F.col("remaining"), F.col("cash_equivalent"), F.col("delivery_bucket") == "ready").alias("c")).select("id", "c.at_signing", "c.later", "c.all_in")
)
_query("lowest_figures", COMPARED, """, g AS (SELECT compound_key, developer_key, min(price_per_m2) AS v FROM resale GROUP BY 1, 2)
SELECT compound_key, developer_key, v, coalesce(count(v) OVER w > 1 AND min(v) OVER w < max(v) OVER w AND v = min(v) OVER w, false) AS is_lowest FROM g WINDOW w AS (PARTITION BY compound_key)""")(
    lambda s, d: views.lowest(_snap(s, d).resale.groupBy("compound_key", "developer_key").agg(F.min("price_per_m2").alias("v")), ["compound_key"], "v")
)

# ---- stored listings and runs --------------------------------------------------------------------

_query("listing_page", LISTING_SQL, "SELECT id, source, price, city, status FROM listing WHERE source = 'portal' AND status = 'active' AND city ILIKE '%asia%' AND price BETWEEN 2000000 AND 12000000 AND last_seen_at >= TIMESTAMP '2001-07-20' AND is_resale ORDER BY last_seen_at DESC, id LIMIT 50")(
    lambda s, d: views.listing_page(adapter.listings(s, d), source="portal", city="asia", min_price=2e6, max_price=1.2e7, since=_at("2001-07-20"), resale=True).select("id", "source", "price", "city", "status")
)
_query("removed_listings", LISTING_SQL, "SELECT id, title FROM listing WHERE status = 'removed' AND source = 'classified' AND last_seen_at >= TIMESTAMP '2001-07-20' ORDER BY last_seen_at DESC, id LIMIT 200")(
    lambda s, d: views.removed_listings(adapter.listings(s, d), _at("2001-07-20"), "classified").select("id", "title")
)
_query("status_table", f"{LISTING_SQL}, {RUNS_SQL}", """, l AS (SELECT source, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'removed') AS removed FROM listing GROUP BY 1),
r AS (SELECT source, status AS last_status, seen FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1)
SELECT coalesce(l.source, r.source) AS source, last_status, seen, coalesce(active, 0) AS active, coalesce(removed, 0) AS removed FROM l FULL JOIN r ON r.source = l.source""".lstrip())(
    lambda s, d: views.status_table(adapter.listings(s, d), adapter.runs(s, d)).select("source", "last_status", "seen", "active", "removed")
)


def _upserted(s, d):
    return cdc.apply_upsert(adapter.listings(s, d), _crawl(s, d), _at(_NOW))


_query("listing_history", LISTING_SQL, "SELECT source, source_listing_id, 1 AS step, CASE WHEN status = 'removed' THEN 'relisted' ELSE 'updated' END AS change_type, CASE WHEN id % 11 = 0 THEN 'price' ELSE '' END AS changed FROM listing WHERE id % 13 <> 0 AND (status = 'removed' OR id % 11 = 0)")(
    lambda s, d: views.history(_upserted(s, d)[1]).select("source", "source_listing_id", F.col("step").cast("long").alias("step"), "change_type", "changed")
)
_query("sync_stats", LISTING_SQL, f"""SELECT a.source, a.seen, a.created, a.updated, a.unchanged, a.relisted, coalesce(r.n, 0) AS marked_removed FROM (SELECT source, count(*) AS seen, count(*) FILTER (WHERE id % 17 = 0) AS created,
    count(*) FILTER (WHERE id % 17 <> 0 AND status <> 'removed' AND id % 11 = 0) AS updated, count(*) FILTER (WHERE id % 17 <> 0 AND status <> 'removed' AND id % 11 <> 0) AS unchanged, count(*) FILTER (WHERE id % 17 <> 0 AND status = 'removed') AS relisted FROM listing WHERE id % 13 <> 0 GROUP BY 1) a
    LEFT JOIN (SELECT source, count(*) AS n FROM listing WHERE status = 'active' AND last_seen_at < TIMESTAMP '{LATEST}' - INTERVAL 10 DAY GROUP BY 1) r ON r.source = a.source""")(
    lambda s, d: views.sync_stats(cdc.upsert(adapter.listings(s, d).where("id % 17 <> 0"), _crawl(s, d), _at(_NOW)), adapter.listings(s, d).where(f"status = 'active' AND last_seen_at < TIMESTAMP '{LATEST}' - INTERVAL 10 DAYS"))
)
_query("known_versions", LISTING_SQL, "SELECT source, source_listing_id, '2001-0' || CAST(id % 9 + 1 AS VARCHAR) AS lastmod FROM listing WHERE status = 'active'")(
    lambda s, d: views.known_versions(adapter.listings(s, d).withColumn("raw", F.to_json(F.struct(F.concat(F.lit("2001-0"), (F.col("id") % 9 + 1).cast("string")).alias("lastmod")))))
)
_query("photos_to_check", LISTING_SQL, "SELECT id, CASE WHEN id % 10 = 3 THEN id END AS rank FROM listing WHERE status = 'active' AND id % 4 <> 0")(
    lambda s, d: (lambda x: views.photos_to_check(x, x.where("id % 4 = 0"), x.where("id % 10 = 3").select("id", F.col("id").alias("rank"))).select("id", "rank"))(adapter.listings(s, d))
)


def _finished(s, d):
    """A run of "portal" that completed the scopes of region ASIA, of which a third of the listings were confirmed unread."""
    x = adapter.listings(s, d)
    run = s.createDataFrame([("portal", 5000, 4000, True, [], False, ["ASIA/PROMO", "ASIA/LARGE"])], "source string, seen int, n_distinct int, complete boolean, errors array<string>, crashed boolean, scopes_completed array<string>")
    return cdc.finish_run(x, run, x.where("id % 3 = 0"), _at(LATEST) - F.expr("INTERVAL 2 DAYS"), _at(_NOW))


_query("removal_versions", LISTING_SQL, f"SELECT source, source_listing_id, 'removed' AS change_type FROM listing WHERE source = 'portal' AND scope_key IN ('ASIA/PROMO', 'ASIA/LARGE') AND status = 'active' AND id % 3 <> 0 AND last_seen_at < TIMESTAMP '{LATEST}' - INTERVAL 2 DAY")(
    lambda s, d: _finished(s, d)[1].select("source", "source_listing_id", "change_type")
)
_query("run_status", None, """SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 3 > 0 AND event_id % 2 = 0 THEN 'completed' WHEN floor(value) > 0 THEN 'partial' ELSE 'failed' END AS status FROM events""")(
    lambda s, d: cdc.run_status(table(s, d, "events").select(F.col("event_id").alias("id"), F.floor("value").alias("seen"), (F.col("event_id") % 3 > 0).alias("complete"), (F.col("event_id") % 2).alias("n_errors"), (F.col("event_id") % 11 == 0).alias("crashed"))).select("id", "status")
)
_query("abandoned_errors", RUNS_SQL, "SELECT id, CASE WHEN status = 'running' AND epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(started_at) > 6 * 3600 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(started_at) > 6 * 3600 THEN 'first|abandoned: the process ended before the run finished' ELSE 'first' END AS errors FROM runs")(
    lambda s, d: health.close_abandoned(adapter.runs(s, d).withColumn("errors", F.array(F.lit("first"))), _at("2024-01-20 12:00:00")).select("id", "status", F.array_join("errors", "|").alias("errors"))
)
_query("run_windows", RUNS_SQL, "SELECT date_trunc('day', started_at) AS start, source, count(*) AS runs, CAST(sum(seen) AS BIGINT) AS seen, count(*) FILTER (WHERE status = 'failed') AS failed FROM runs GROUP BY 1, 2")(lambda s, d: health.windows(adapter.runs(s, d)))
_query("crawl_plan", None, "SELECT n_name AS source, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' category=villas city=' || lower(n_name) ELSE '' END AS label FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3')")(
    lambda s, d: health.active_plan(table(s, d, "nation").select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("city"), F.lower("n_name"), F.lit("category"), F.lit("villas"))).otherwise(F.create_map().cast("map<string,string>")).alias("params")), ("NATION_1", "NATION_2", "NATION_3")).select("source", "label")
)
_query("scope_keys", None, """SELECT event_id AS id, '[{"key":"city","value":"c' || CAST(event_id % 5 AS VARCHAR) || '"},{"key":"kind","value":"' || event_type || '"}]' AS scope FROM events""")(
    lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), health.scope_key(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("max_pages"), F.lit("9"), F.lit("city"), F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")))).alias("scope"))
)
_query("price_history", LISTING_SQL, "SELECT id, 2 AS step, round_even(price * 0.95, 0) AS price, round_even(round_even(price * 0.95, 0) / price - 1, 4) AS change FROM listing UNION ALL SELECT id, 1, price, NULL FROM listing")(
    lambda s, d: cdc.price_history(adapter.listings(s, d).select(F.col("id").alias("property_id"), F.posexplode(F.array(F.col("price"), F.bround(F.col("price") * 0.95))).alias("captured_at", "price"))).select(F.col("property_id").alias("id"), (F.col("captured_at") + 1).cast("long").alias("step"), "price", "change")
)
_J = lambda c: f"""coalesce('"' || {c} || '"', 'null')"""
_query("content_hashes", LISTING_SQL, f"""SELECT id, sha256('{{"area_m2": ' || CAST(CAST(area_m2 AS DOUBLE) AS VARCHAR) || ', "bathrooms": ' || CAST(bathrooms AS VARCHAR) || ', "bedrooms": ' || CAST(bedrooms AS VARCHAR) || ', "city": ' || {_J("city")} || ', "compound": ' || {_J("compound")} || ', "currency": ' || {_J("currency")}
    || coalesce(', "delivery_date": "' || delivery_date || '"', '') || ', "delivery_status": ' || {_J("delivery_status")} || ', "description": ' || {_J("description")} || ', "developer": ' || {_J("developer")} || ', "district": ' || {_J("district")} || ', "down_payment": ' || coalesce(CAST(round_even(down_payment, 0) AS VARCHAR), 'null')
    || ', "finishing": ' || {_J("finishing")} || ', "governorate": null, "images": [], "installment_months": ' || coalesce(CAST(installment_months AS VARCHAR), 'null') || ', "is_installment": ' || CAST(is_installment AS VARCHAR) || ', "is_resale": ' || coalesce(CAST(is_resale AS VARCHAR), 'null')
    || ', "lat": null, "lng": null, "phone": null, "posted_at": null, "price": ' || CAST(price AS VARCHAR) || ', "price_negotiable": null, "property_type": ' || {_J("property_type")} || ', "purpose": "sale", "resale_evidence": ' || CASE WHEN id % 20 > 1 THEN '"owner"' ELSE 'null' END
    || ', "seller_type": null, "title": ' || {_J("title")} || ', "url": ' || {_J("url")} || '}}') AS content_hash FROM listing""")(
    lambda s, d: (lambda x: x.select("id", cdc.content_hash(x).alias("content_hash")))(adapter.listings(s, d).withColumn("down_payment", F.bround("down_payment")))
)


def _filled(s, d):
    """Every second listing has a stored fill, half of them read from another text."""
    x = adapter.listings(s, d).withColumn("bathrooms", F.when(F.col("id") % 3 > 0, F.col("bathrooms")))
    text = F.when(F.col("id") % 4 == 0, T.text_hash(T.listing_text(F.col("title"), F.col("description")))).otherwise(F.lit("other"))
    e = x.where("id % 2 = 0").select("source", "source_listing_id", text.alias("description_hash"), F.lit("done").alias("status"), F.create_map(F.lit("bathrooms"), F.lit("9"), F.lit("finishing"), F.lit("lux")).alias("applied"))
    return cdc.with_fills(x, e).select("id", "bathrooms", "finishing")


_query("stored_fills", LISTING_SQL, "SELECT id, CASE WHEN id % 3 > 0 THEN bathrooms WHEN id % 4 = 0 THEN 9 END AS bathrooms, CASE WHEN id % 4 = 0 AND finishing = '-' THEN 'lux' ELSE finishing END AS finishing FROM listing")(_filled)

# ---- name resolution -----------------------------------------------------------------------------

_query("resolution_batches", _PAIRS, "SELECT key, CAST(floor((row_number() OVER (ORDER BY listings DESC, key) - 1) / 120) AS BIGINT) AS batch, (row_number() OVER (ORDER BY listings DESC, key) - 1) % 120 AS position FROM pairs")(
    lambda s, d: resolution.batches(entities.spelling_pairs(adapter.listings(s, d))).select("key", "batch", F.col("position").cast("long").alias("position"))
)


def _answered(s, d):
    """An answer for the items of even places, from a stand-in for a resolver."""
    b = resolution.batches(entities.spelling_pairs(adapter.listings(s, d)))

    def invoke(text: str) -> list[dict]:
        import json

        items = json.loads(text[text.index("items:\n") + 7 :])
        return [{"id": i["id"], "kind": "compound", "compound": i["compound"], "developer": i["developer"], "confidence": "high"} for i in items if i["id"] % 2 == 0]

    got = resolution.answers(resolution.prompts(b), invoke)
    stored = b.where("position = 0").select("key", F.lit(2).alias("attempts"))
    return resolution.resolved(b, got, stored, entities.reference_index(adapter.launches(s, d)))


_query("resolved_pairs", _PAIRS, """SELECT key, listings, CASE WHEN p % 2 = 0 THEN 'done' ELSE 'failed' END AS status, CASE WHEN p = 0 THEN 3 ELSE 1 END AS attempts, CASE WHEN p % 2 = 0 THEN compound END AS compound, CASE WHEN p % 2 = 1 THEN 'missing from the answer' END AS error
    FROM (SELECT *, (row_number() OVER (ORDER BY listings DESC, key) - 1) % 120 AS p FROM pairs)""")(lambda s, d: _answered(s, d).select("key", "listings", "status", "attempts", "compound", "error"))

# ---- functions -----------------------------------------------------------------------------------

_query("iso_dates", None, """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') END AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")(
    lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t")).select("id", M.iso_date(F.when(F.col("id") % 4 == 0, F.col("t")).when(F.col("id") % 4 == 1, F.concat("t", F.lit("+02:00"))).when(F.col("id") % 4 == 2, F.substring("t", 1, 10)).otherwise("no date")).alias("at"))
)
_query("backoff_seconds", None, "SELECT n_nationkey AS attempt, CAST(least(60, 3 * pow(3, n_nationkey)) AS INTEGER) AS seconds FROM nation")(lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("attempt"), M.backoff(F.col("n_nationkey")).alias("seconds")))
_query("safe_links", None, "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@]+') AND NOT regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN url END AS link FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", T.safe_url(F.col("url")).alias("link")))
_query("photo_links", None, "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN url ELSE '' END AS photos FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", F.array_join(T.photo_urls(F.to_json(F.array("url", F.lit("ftp://a/b"), "url"))), "|").alias("photos"))
)
_query("instalment_terms", LISTING_SQL, """SELECT id, CASE WHEN id % 3 = 0 THEN installment_months WHEN (10 + id % 50) * 3 <= 120 THEN (10 + id % 50) * 3 END AS months FROM listing WHERE is_installment""")(
    lambda s, d: adapter.listings(s, d).where("is_installment").select("id", M.instalment_months(F.when(F.col("id") % 3 == 0, F.col("installment_months") / 12), F.lit(1000.0) * (10 + F.col("id") % 50), F.lit(1000.0), F.lit(3)).alias("months"))
)
_query("highlight_parts", LISTING_SQL, "SELECT id, bedrooms, bathrooms, CAST(floor(area_m2) AS DOUBLE) AS area_m2 FROM listing")(
    lambda s, d: adapter.listings(s, d).select("id", T.highlights(F.concat(F.col("bedrooms").cast("string"), F.lit(" Bedrooms » "), F.col("bathrooms").cast("string"), F.lit(" Bathrooms | "), F.floor("area_m2").cast("string"), F.lit(" m2"))).alias("h")).select("id", "h.*")
)

# ---- pages of sources ----------------------------------------------------------------------------


def _items(s, d):
    """A page of results for each order: one item made of its columns."""
    x = adapter.listings(s, d)
    text = lambda c: F.col(c).cast("string")
    item = F.struct(text("id").alias("id"), F.when(F.col("id") % 3 == 0, F.concat(F.col("title"), F.lit(" resale"))).otherwise(F.col("title")).alias("title"), F.concat(F.floor("price").cast("string"), F.lit(" EGP")).alias("price_amount"),
        F.array(F.concat(text("bedrooms"), F.lit(" bedrooms")), F.concat(F.floor("area_m2").cast("string"), F.lit(" m2"))).alias("cps"), F.upper("city").alias("city_label"), F.concat(F.lit("unit/"), text("id")).alias("post_url"))
    return cards.item_listings(cards.items(x.select(F.col("id").alias("page_id"), F.to_json(F.array(item)).alias("body"))), _at(LATEST))


_query("result_items", LISTING_SQL, """SELECT CAST(id AS VARCHAR) AS source_listing_id, 'https://www.example.com/unit/' || CAST(id AS VARCHAR) AS url, CASE WHEN id % 3 = 0 THEN 1 END AS is_resale, floor(price) AS price, CAST(floor(area_m2) AS DOUBLE) AS area_m2, bedrooms, lower(city) AS city FROM listing""")(
    lambda s, d: _items(s, d).select("source_listing_id", "url", F.col("is_resale").cast("int").alias("is_resale"), "price", "area_m2", "bedrooms", "city")
)


def _cards(s, d):
    """A page for each order with one card that shows its down payment, or its price."""
    x = adapter.listings(s, d)
    html = F.concat(F.lit('<div class="card" itemtype="http://schema.org/House"><a class="card-link" href="https://a.example/u/'), F.col("id").cast("string"), F.lit('"></a><h2 itemprop="name">'), "title", F.lit('</h2><meta itemprop="price" content="'), F.floor("price").cast("string"),
        F.lit('"><span class="price">'), F.when(F.col("id") % 2 == 0, F.lit("مقدم ")).otherwise(F.lit("")), F.floor(F.col("price") / F.when(F.col("id") % 4 == 0, 1).otherwise(10)).cast("string"), F.lit('</span><span itemprop="numberOfRooms">'), F.col("bedrooms").cast("string"), F.lit("</span></div>"))
    return cards.card_listings(cards.cards(x.select(F.col("id").alias("page_id"), html.alias("html"))))


_query("card_listings", LISTING_SQL, """SELECT CAST(id AS VARCHAR) AS source_listing_id, title, floor(price) AS price, id % 2 = 0 AS is_installment, CASE WHEN id % 4 = 2 THEN floor(price / 10) END AS down_payment, bedrooms, 'house' AS property_type FROM listing""")(
    lambda s, d: _cards(s, d).select("source_listing_id", "title", "price", "is_installment", "down_payment", "bedrooms", "property_type")
)
_query("newest_entries", None, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderkey DESC LIMIT 200")(lambda s, d: cards.newest(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id")), 200))
_query("hinted_resales", LISTING_SQL, "SELECT id, CAST(CASE WHEN is_resale IS NULL AND id % 40 = 0 THEN true ELSE is_resale END AS INTEGER) AS is_resale FROM listing")(
    lambda s, d: (lambda x: cards.with_hints(x, x.where("id % 40 < 9").select("source_listing_id"), "listed on a resale page"))(adapter.listings(s, d)).select("id", F.col("is_resale").cast("int").alias("is_resale"))
)
_query("detail_enrichment", LISTING_SQL, """SELECT id, CASE WHEN id % 2 = 0 THEN '0100' || CAST(id AS VARCHAR) END AS phone, CASE WHEN id % 2 = 0 THEN floor(price) + 5 ELSE price END AS price FROM listing""")(
    lambda s, d: (lambda x: cards.with_detail(x, x.where("id % 2 = 0").select("source_listing_id", F.concat(F.lit('<script type="application/ld+json"> {"telephone": "0100'), F.col("id").cast("string"), F.lit('", "offers": {"price": "'), (F.floor("price") + 5).cast("string"), F.lit('"}} </script>')).alias("html"))))(adapter.listings(s, d)).select("id", "phone", "price")
)
_query("offer_lists", LISTING_SQL, "SELECT source_listing_id, floor(area_m2) * 1.0::DOUBLE AS area_m2, nullif(bedrooms, 0) AS bedrooms, id % 2 = 0 AS is_installment, 'semi_finished' AS finishing FROM listing")(
    lambda s, d: cards.offers(adapter.listings(s, d).select("source_listing_id", F.concat(F.lit('<ul><li class="product-offer-item"><strong>Area</strong><small>'), F.floor("area_m2").cast("string"), F.lit(' m2</small></li><li class="product-offer-item"><strong>Bedrooms</strong> <small>'), F.col("bedrooms").cast("string"),
        F.lit('</small></li><li class="product-offer-item"><strong>Method Payment</strong><small>'), F.when(F.col("id") % 2 == 0, "Installments").otherwise("Cash"), F.lit('</small></li><li class="product-offer-item"><strong>Finishing</strong><small>Semi Finished</small></li></ul>')).alias("html"))).select("source_listing_id", "area_m2", "bedrooms", "is_installment", "finishing")
)

# ---- publication ---------------------------------------------------------------------------------

_query("search_rows", COMPARED, """SELECT id, coalesce(is_resale, false) AS listed, compound_key, kind AS property_type, lower(concat_ws(' ', coalesce(title, ''), coalesce(district, ''), coalesce(compound, ''), coalesce(developer, ''), coalesce(compound_display, ''), coalesce(developer_display, ''))) AS search,
    CASE WHEN cash_equivalent <> 0 THEN cash_equivalent / area_m2 END AS cash_ppm, row_number() OVER (ORDER BY """ + RANK + """) - 1 AS rank FROM units""")(
    lambda s, d: (lambda z: publish.search_rows(z.records, compare.all_ranks(z.records)))(_snap(s, d)).select("id", "listed", "compound_key", "property_type", "search", "cash_ppm", "rank")
)


def _published(s, d):
    """A version with three tables, read back by its pointer."""
    from .plans.storage import folder

    path, z = folder(s), _snap(s, d)
    entity = {"compound": (z.compounds.select("compound_key", "units"), "compound_key"), "developer": (z.developers.select("developer_key", "units"), "developer_key")}
    publish.publish({"units": z.records.select("id", "level"), "documents": publish.parts(publish.documents(entity))}, path, "one")
    return publish.manifest(s, path, publish.active_version(s, path), ["units", "documents"])


_query("published_version", COMPARED, """SELECT 'one' AS version, 'units' AS "table", count(*) AS n FROM units UNION ALL SELECT 'one', 'documents', (SELECT count(DISTINCT compound_key) + count(DISTINCT developer_key) FROM resale)""")(_published)
_query("staging_batches", None, "SELECT count(*) AS rows, true AS within FROM orders")(
    lambda s, d: publish.staging(table(s, d, "orders").select("o_orderkey", (F.lit(1000) + F.col("o_orderkey") % 20000).alias("size")), "size", ["o_orderkey"]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + 1).alias("b")).agg(F.sum("n").alias("rows"), F.bool_and((F.col("n") <= 40) & (F.col("b") <= 300_001)).alias("within"))
)
_query("rejoined_parts", None, "SELECT CAST(doc_id AS VARCHAR) AS key, length(text) AS size, md5(text) AS hash FROM documents")(
    lambda s, d: publish.assembled(publish.parts(table(s, d, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("key"), "text"))).select("key", F.length("text").cast("long").alias("size"), F.md5("text").alias("hash"))
)
