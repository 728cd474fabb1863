"""All queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import money as M
from .functions import text as T
from .operators import cdc, clean, compare, entities, health, model, publish, rollup, search
from .plans import adapter, snapshot
from .plans.adapter import LATEST, LISTING_SQL, RUNS_SQL
from .sources import pages

QUERIES: dict = {}
SQL: dict = {}

# ---- SQL steps, each a list of common table expressions -----------------------------------------

_Q = "pow(1.2, -(m / greatest(1.0, round_even(m / 3.0, 0)) / 12))"
_N = "greatest(1.0, round_even(m / 3.0, 0))"
ELIGIBLE = f"""{LISTING_SQL},
allrows AS (SELECT id, source, url, title, property_type, is_resale, price, currency, is_installment, down_payment, installment_months, area_m2, bedrooms, finishing, delivery_status, delivery_date,
    compound, developer, district, contract_year, status, first_seen_at, last_seen_at FROM listing
  UNION ALL SELECT id, 'benchmark', NULL, NULL, kind, false, price, 'EGP', true, price * (0.05 + (k % 4) * 0.05), 12 * (5 + k % 6), area_m2, NULL, CASE WHEN k % 3 = 0 THEN 'semi_finished' ELSE 'finished' END, NULL,
    CAST(2002 + k % 4 AS VARCHAR) || '-06-30', compound, 'NATION_' || CAST(k % 25 AS VARCHAR) || ' Group', split_part(compound, ' ', 2), NULL, 'active', TIMESTAMP '{LATEST}', TIMESTAMP '{LATEST}' FROM launch0),
latest AS (SELECT source, max(last_seen_at) AS source_latest FROM allrows GROUP BY source),
el0 AS (SELECT a.* REPLACE (CASE WHEN contract_year BETWEEN 2000 AND 2100 THEN contract_year END AS contract_year), CASE property_type WHEN 'apartments' THEN 'apartment' ELSE property_type END AS kind, CAST(installment_months AS DOUBLE) AS m, source <> 'classified' AS known_cash,
    CASE WHEN finishing = 'semi_finished' THEN 'semi_finished' WHEN finishing IN ('lux', 'finished') THEN 'finished' ELSE 'unknown' END AS finishing_class
  FROM allrows a WHERE status = 'active' AND currency = 'EGP' AND price BETWEEN 100000 AND 200000000 AND area_m2 BETWEEN 20 AND 5000),
el1 AS (SELECT *, CASE WHEN kind IN ('apartment', 'studio') THEN 'apartment' WHEN kind = 'chalet' THEN 'chalet' WHEN kind = 'villa' THEN 'house' END AS class,
    round_even(price / area_m2, 0) AS price_per_m2, is_installment AND down_payment IS NOT NULL AS has_plan,
    down_payment + greatest(0.0, price - down_payment) * ({_Q} * (1 - pow({_Q}, {_N})) / (1 - {_Q}) / {_N}) AS present FROM el0),
elig AS (SELECT *, CASE WHEN has_plan THEN 'plan' WHEN is_installment THEN 'partial' WHEN known_cash THEN 'cash' ELSE 'unknown' END AS terms,
    CASE WHEN has_plan THEN round_even(present, 0) WHEN is_installment THEN NULL WHEN known_cash THEN round_even(price, 0) END AS cash_equivalent,
    CASE WHEN has_plan THEN round_even(greatest(0.0, price - down_payment), 0) WHEN is_installment THEN NULL WHEN known_cash THEN 0.0 END AS remaining,
    CASE WHEN has_plan THEN round_even(greatest(0.0, price - down_payment) / price, 4) WHEN is_installment THEN NULL WHEN known_cash THEN 0.0 END AS remaining_share,
    CASE WHEN has_plan THEN round_even(m / 12, 1) WHEN is_installment THEN NULL WHEN known_cash THEN 0.0 END AS years,
    CASE WHEN has_plan THEN round_even(1 - present / price, 4) WHEN is_installment THEN NULL WHEN known_cash THEN 0.0 END AS discount FROM el1),
proj AS (SELECT e.* FROM elig e JOIN latest l ON l.source = e.source WHERE epoch(l.source_latest) - epoch(e.last_seen_at) < 14 * 86400)"""

_SLUG = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '-_')"
_DEV = r"regexp_replace(regexp_replace(lower({}), '\b(developments|group)\b', ' ', 'g'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
RESOLVED = f"""{ELIGIBLE},
rec AS (SELECT *, {_SLUG.format("compound")} AS own_key, {_DEV.format("developer")} AS own_dev FROM proj WHERE source <> 'benchmark'),
kk AS (SELECT own_key AS key, count(*) AS n, list(DISTINCT own_dev) AS devs FROM rec GROUP BY own_key),
variants AS (SELECT v.key, arg_max(a.key, length(a.key)) AS target FROM kk v JOIN kk a ON v.n < 5 AND a.n >= 5 AND starts_with(v.key, a.key || '-') AND list_has_any(v.devs, a.devs) GROUP BY v.key),
keyed AS (SELECT r.*, coalesce(v.target, r.own_key) AS compound_key, own_dev AS developer_key, CASE WHEN v.target IS NULL THEN 0 ELSE 1 END AS variant FROM rec r LEFT JOIN variants v ON v.key = r.own_key),
dv AS (SELECT compound_key, district, row_number() OVER (PARTITION BY compound_key ORDER BY count(*) DESC, min(variant * 1000000000 + id)) AS k FROM keyed GROUP BY compound_key, district),
nv AS (SELECT compound_key, compound AS cname, row_number() OVER (PARTITION BY compound_key ORDER BY count(*) DESC, min(id)) AS k FROM keyed WHERE variant = 0 GROUP BY compound_key, compound),
vv AS (SELECT developer_key, developer AS dname, row_number() OVER (PARTITION BY developer_key ORDER BY count(*) DESC, min(id)) AS k FROM keyed GROUP BY developer_key, developer),
res0 AS (SELECT k.* EXCLUDE (district), dv.district, nv.cname AS compound_display, vv.dname AS developer_display, date_diff('day', DATE '{LATEST}', CAST(delivery_date AS DATE)) / 365.25 AS y
  FROM keyed k JOIN dv ON dv.compound_key = k.compound_key AND dv.k = 1 LEFT JOIN nv ON nv.compound_key = k.compound_key AND nv.k = 1 JOIN vv ON vv.developer_key = k.developer_key AND vv.k = 1),
res AS (SELECT *, CASE WHEN y <= 0 THEN 'ready' WHEN y <= 1 THEN 'under_1y' WHEN y <= 2 THEN '1_2y' WHEN y <= 3 THEN '2_3y' WHEN y IS NOT NULL THEN '3y_plus' WHEN delivery_status = 'ready' THEN 'ready' ELSE 'unknown' END AS delivery_bucket,
    round_even(y, 2) + 0.0 AS delivery_years FROM res0)"""

MATCHED = f"""{RESOLVED},
idx AS (SELECT compound_key AS key, arg_max(developer_key, id) AS dev FROM res WHERE is_resale GROUP BY compound_key),
l0 AS (SELECT *, {_SLUG.format("compound")} AS own_key, {_DEV.format("developer")} AS own_dev FROM proj WHERE source = 'benchmark' AND coalesce(cash_equivalent, 0) <> 0),
ph AS (SELECT l.id, arg_max(i.key, length(i.key)) AS key FROM l0 l JOIN idx i ON starts_with(l.own_key, i.key || '-') AND i.dev = l.own_dev GROUP BY l.id),
matched AS (SELECT l.*, coalesce(i.key, ph.key) AS compound_key FROM l0 l LEFT JOIN idx i ON i.key = l.own_key LEFT JOIN ph ON ph.id = l.id)"""

_NEAR = "abs(ln(b.area_m2 / a.area_m2)) <= ln(1.5)"
COMPARED = f"""{MATCHED},
pp AS (SELECT a.id, a.cash_equivalent / a.area_m2 AS own, a.price_per_m2 AS head, b.cash_equivalent / b.area_m2 AS ppm, b.price_per_m2 AS o_head,
    a.finishing_class = b.finishing_class AS eq, a.finishing_class = b.finishing_class AND a.finishing_class <> 'unknown' AS same
  FROM res a JOIN res b ON a.compound_key = b.compound_key AND a.kind = b.kind AND a.id <> b.id AND {_NEAR} AND b.is_resale AND coalesce(b.cash_equivalent, 0) <> 0 WHERE coalesce(a.cash_equivalent, 0) <> 0),
pc AS (SELECT *, count(*) FILTER (WHERE same) OVER (PARTITION BY id) AS ns FROM pp),
pg AS (SELECT id, any_value(own) AS own, any_value(head) AS head, count(*) AS n, count(*) FILTER (WHERE ppm < own) AS cheaper, median(ppm) AS mppm, median(o_head) AS mhead, min(ppm) AS lppm, min(o_head) AS lhead, bool_and(eq) AS eq
  FROM pc WHERE ns < 4 OR same GROUP BY id HAVING count(*) >= 4),
peers AS (SELECT id, n + 1 AS peer_count, cheaper + 1 AS peer_rank, round_even(own, 0) AS peer_cash_ppm, round_even(mppm, 0) AS peer_median_cash_ppm, round_even(greatest(own / mppm - 1, head / mhead - 1), 4) AS peer_gap,
    round_even(own / mppm - 1, 4) AS peer_cash_gap, round_even(head / mhead - 1, 4) AS peer_headline_gap, round_even(greatest(own / lppm - 1, head / lhead - 1), 4) AS peer_cheapest_gap, eq AS peer_same_finishing FROM pg),
lp AS (SELECT a.id, a.area_m2 AS area, a.cash_equivalent AS cash, a.price_per_m2 AS own_head, a.contract_year, b.id AS o_id, b.cash_equivalent / b.area_m2 AS ppm, b.price_per_m2 AS o_head, b.area_m2 AS o_area, b.remaining_share, b.years,
    b.delivery_date, b.finishing_class AS o_fin, a.finishing_class = b.finishing_class AS eq, a.finishing_class = b.finishing_class AND a.finishing_class <> 'unknown' AS same, abs(ln(b.area_m2 / a.area_m2)) AS dist
  FROM res a JOIN matched b ON a.compound_key = b.compound_key AND a.kind = b.kind AND {_NEAR} WHERE coalesce(a.cash_equivalent, 0) <> 0),
lc AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, count(*) FILTER (WHERE same) OVER (PARTITION BY id) AS ns FROM lp),
ln5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, o_id) AS r FROM lc WHERE n >= 2 AND (ns < 2 OR same)) WHERE r <= 5),
lg AS (SELECT id, any_value(area) AS area, any_value(cash) AS cash, any_value(own_head) AS own_head, any_value(contract_year) AS cy, count(*) AS launch_units, median(ppm) AS ppm, median(o_head) AS head,
    round_even(median(round((1 - coalesce(remaining_share, 0)) * 10000)), 0) / 10000 AS launch_down_share, round_even(median(years), 1) AS launch_plan_years, CAST(round_even(median(CAST(substr(delivery_date, 1, 4) AS DOUBLE)), 0) AS INTEGER) AS launch_delivery_year,
    min(o_area) AS launch_area_min, max(o_area) AS launch_area_max, bool_and(eq) AS launch_same_finishing FROM ln5 GROUP BY id),
lch AS (SELECT *, head / own_head - 1 AS ch, date_diff('day', CAST(CAST(cy AS VARCHAR) || '-07-01' AS DATE), DATE '{LATEST}') / 365.25 AS cyears FROM lg),
launch AS (SELECT id, launch_units, launch_down_share, launch_plan_years, launch_delivery_year, launch_area_min, launch_area_max, launch_same_finishing, round_even(greatest(cash / (ppm * area) - 1, own_head / head - 1), 4) AS launch_gap,
    round_even(cash / (ppm * area) - 1, 4) AS launch_cash_gap, round_even(own_head / head - 1, 4) AS launch_headline_gap, round_even(ppm * area, -3) AS launch_developer_cash, round_even(ppm, 0) AS launch_cash_ppm,
    round_even(head, 0) AS launch_headline_ppm, CASE WHEN cy <= year(DATE '{LATEST}') THEN round_even(ch, 4) END AS launch_contract_change,
    CASE WHEN cy <= year(DATE '{LATEST}') AND cyears >= 1 AND ch > -1 THEN round_even(pow(1 + ch, 1 / cyears) - 1, 4) END AS launch_contract_annual FROM lch),
op0 AS (SELECT r.*, p.* EXCLUDE (id), l.* EXCLUDE (id), coalesce(l.launch_same_finishing, false) AS dev, p.id IS NOT NULL AS peer,
    CASE WHEN l.launch_same_finishing THEN greatest(launch_cash_gap, launch_headline_gap) END AS cd, CASE WHEN l.launch_same_finishing THEN least(launch_cash_gap, launch_headline_gap) END AS dd,
    greatest(peer_cash_gap, peer_headline_gap) AS cp, least(peer_cash_gap, peer_headline_gap) AS dp,
    CAST(round(10000 * CASE WHEN l.launch_same_finishing THEN greatest(launch_cash_gap, launch_headline_gap) END) AS BIGINT) + CAST(round(10000 * greatest(peer_cash_gap, peer_headline_gap)) AS BIGINT) AS s2 FROM res r LEFT JOIN peers p ON p.id = r.id LEFT JOIN launch l ON l.id = r.id),
units AS (SELECT *, CASE WHEN NOT dev AND NOT peer THEN 'unrated' WHEN (dev AND launch_gap <= -0.7) OR (peer AND (peer_gap <= -0.6 OR peer_cheapest_gap <= -0.25)) THEN 'check'
      WHEN greatest(cd, cp) <= -0.15 AND least(cd, cp) <= -0.25 THEN 'strong' WHEN greatest(cd, cp) <= -0.05 AND least(cd, cp) <= -0.1 THEN 'good'
      WHEN least(cd, cp) <= -0.1 AND greatest(dd, dp) >= 0.1 THEN 'mixed' WHEN greatest(dd, dp) >= 0.1 THEN 'pricier' ELSE 'in_line' END AS level,
    CASE WHEN dev AND peer THEN round_even(s2 / 2.0, 0) / 10000 ELSE coalesce(cd, cp) END AS score, CAST(dev AS INTEGER) + CAST(peer AS INTEGER) AS n_signals FROM op0),
resale AS (SELECT * FROM units WHERE is_resale)"""

LEVEL_ORDER = "CASE level " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(compare.LEVELS)) + " END"
RANK = f"{LEVEL_ORDER}, n_signals DESC, coalesce(score, 0.0), id"


def _query(name: str, steps: str | None = None, select: str | None = None):
    """Registers a function of a snapshot's frames; select is the SQL on top of steps."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir)
        if select:
            # A select that begins with a comma adds steps of its own.
            SQL[name] = (f"WITH {steps}" + ("" if select.startswith(",") else "\n") if steps else "") + select
        return build

    return add


def _snap(spark, sf_dir) -> snapshot.Snapshot:
    return snapshot.cached(spark, sf_dir)


def flagship(spark, sf_dir: str):
    """The 25 best resale units."""
    return QUERIES["top_opportunities"](spark, sf_dir)


# ---- projection, payment, delivery --------------------------------------------------------------

_ELIG = ["id", "source", "property_type", "class", "price", "area_m2", "price_per_m2", "finishing_class", "district"]
_query("eligible_units", ELIGIBLE, "SELECT id, source, kind AS property_type, class, price, area_m2, price_per_m2, finishing_class, district FROM elig WHERE source <> 'benchmark'")(
    lambda s, d: clean.eligible(adapter.listings(s, d)).select(*_ELIG)
)
_query("freshness_filter", ELIGIBLE, "SELECT source, count(*) AS n FROM proj GROUP BY source")(lambda s, d: _snap(s, d).projected.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
_TERMS = ["id", "terms", "cash_equivalent", "remaining", "remaining_share", "years", "discount"]
_query("payment_terms", ELIGIBLE, f"SELECT {', '.join(_TERMS)} FROM proj")(lambda s, d: _snap(s, d).projected.select(*_TERMS))
_query("plan_buckets", ELIGIBLE, """SELECT CASE WHEN terms IN ('cash', 'unknown') THEN 'cash' WHEN years IS NULL THEN 'unknown' WHEN years < 3 THEN 'under_3y' WHEN years < 6 THEN '3_6y' WHEN years < 9 THEN '6_9y' ELSE '9y_plus' END AS bucket,
    count(*) AS n FROM proj GROUP BY 1""")(lambda s, d: _snap(s, d).projected.groupBy(M.plan_bucket(F.col("terms"), F.col("years")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
_query("delivery_buckets", RESOLVED, "SELECT id, delivery_bucket, delivery_years FROM res")(lambda s, d: _snap(s, d).resolved.select("id", "delivery_bucket", "delivery_years"))
_query("signing_amounts", ELIGIBLE, "SELECT id, price - remaining AS signing, CASE WHEN terms = 'plan' AND years > 0 THEN remaining / (years * 4) END AS quarterly FROM proj")(
    lambda s, d: _snap(s, d).projected.select("id", M.signing(F.col("price"), F.col("remaining")).alias("signing"), M.quarterly(F.col("remaining"), F.col("years"), F.col("terms")).alias("quarterly"))
)
_query("class_projection", ELIGIBLE, "SELECT class, kind AS property_type, count(*) AS n FROM proj GROUP BY 1, 2")(lambda s, d: _snap(s, d).projected.groupBy("class", "property_type").agg(F.count(F.lit(1)).alias("n")))
_query("unknowns_list", RESOLVED, """SELECT id, concat_ws(',', CASE WHEN terms = 'unknown' THEN 'payment_terms' END, CASE WHEN terms = 'partial' THEN 'installment_term' END, CASE WHEN finishing_class = 'unknown' THEN 'finishing' END,
    CASE WHEN delivery_bucket = 'unknown' THEN 'delivery' END, 'floor_and_view', 'legal_status', 'transfer_fee', 'maintenance_deposit') AS unknowns FROM res""")(
    lambda s, d: _snap(s, d).resolved.select("id", F.array_join("unknowns", ",").alias("unknowns"))
)
# ---- entities ------------------------------------------------------------------------------------

_query("compound_votes", RESOLVED, "SELECT compound_key, compound AS value, count(*) AS n, row_number() OVER (PARTITION BY compound_key ORDER BY count(*) DESC, min(id)) AS rank FROM keyed GROUP BY 1, 2")(
    lambda s, d: entities.ranked_votes(_snap(s, d).resolved, "compound_key", "compound_name").select("compound_key", F.col("compound_name").alias("value"), "n", F.col("rank").cast("long").alias("rank"))
)
_query("developer_votes", RESOLVED, "SELECT developer_key, developer AS value, count(*) AS n FROM keyed GROUP BY 1, 2")(
    lambda s, d: entities.ranked_votes(_snap(s, d).resolved, "developer_key", "developer_name").select("developer_key", F.col("developer_name").alias("value"), "n")
)
_query("district_votes", RESOLVED, "SELECT DISTINCT compound_key, district FROM res")(lambda s, d: _snap(s, d).resolved.select("compound_key", "district").distinct())
_query("anchors", RESOLVED, "SELECT key, n FROM kk WHERE n >= 5")(
    lambda s, d: _snap(s, d).projected.where("source <> 'benchmark'").groupBy(T.slug(F.col("compound_name")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
)
_query("variant_match", RESOLVED, "SELECT id, compound_key FROM keyed WHERE variant = 1")(lambda s, d: _snap(s, d).resolved.where(F.col("compound_key") != T.slug(F.col("compound_name"))).select("id", "compound_key"))
_FOLD = r"regexp_replace(regexp_replace(lower({}), '\b(compound|project)\b', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_PAIRS = f"""{LISTING_SQL}, sp AS (SELECT id, {_FOLD.format("compound")} || '|' || regexp_replace({_DEV.format("developer")}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key, compound, developer, district FROM listing WHERE status = 'active'),
sd AS (SELECT key, district, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(id)) AS k FROM sp GROUP BY key, district),
pairs AS (SELECT sp.key, count(*) AS listings, min(compound) AS compound, min(developer) AS developer, min(sd.district) AS district FROM sp JOIN sd ON sd.key = sp.key AND sd.k = 1 GROUP BY sp.key)"""
_query("spelling_pairs", _PAIRS, "SELECT key, compound, developer, district, listings FROM pairs")(lambda s, d: entities.spelling_pairs(adapter.listings(s, d)))


def _stored(s, d):
    """Answers for some pairs: by the length of the key."""
    p, n = entities.spelling_pairs(adapter.listings(s, d)), F.length("key")
    return p.where(n % 3 != 0).select("key", F.when(n % 2 == 0, "done").otherwise("failed").alias("status"), (n % 5).cast("int").alias("attempts"), "compound", "developer", "listings", F.lit("compound").alias("kind"),
        F.when(n % 4 == 0, F.col("compound")).alias("reference"), F.when(n % 5 == 0, "low").otherwise("high").alias("confidence"))


_query("pending_pairs", _PAIRS, "SELECT key, listings FROM pairs WHERE length(key) % 3 = 0 OR (length(key) % 2 = 1 AND CASE WHEN length(key) % 5 = 0 THEN 1 ELSE length(key) % 5 END < 3)")(
    lambda s, d: entities.pending(entities.spelling_pairs(adapter.listings(s, d)), _stored(s, d)).select("key", "listings")
)
_query("known_names", _PAIRS, """SELECT compound || ' | ' || developer AS name, CAST(sum(listings) AS BIGINT) AS weight FROM pairs WHERE length(key) % 3 <> 0 AND length(key) % 2 = 0 AND length(key) % 4 <> 0 AND length(key) % 5 <> 0
    GROUP BY 1 ORDER BY weight DESC, name LIMIT 1500""")(lambda s, d: entities.known_names(_stored(s, d)))
_query("reference_index", LISTING_SQL, """, rr AS (SELECT id, compound, 'NATION_' || CAST(k % 25 AS VARCHAR) || ' Group' AS developer FROM launch0), rv AS (SELECT compound, developer, row_number() OVER (PARTITION BY compound ORDER BY count(*) DESC, min(id)) AS k FROM rr GROUP BY 1, 2)
SELECT rr.compound, min(rv.developer) AS developer, count(*) AS units FROM rr JOIN rv ON rv.compound = rr.compound AND rv.k = 1 GROUP BY rr.compound""")(lambda s, d: entities.reference_index(adapter.launches(s, d)).select("compound", "developer", "units"))
_query("launch_placement", MATCHED, "SELECT id, compound_key FROM matched")(lambda s, d: _snap(s, d).matched.select("id", "compound_key"))


def _aliases(s, d):
    """Every spelling pair of region ASIA is one compound's, of which the name is the brand's."""
    p = entities.spelling_pairs(adapter.listings(s, d)).where(F.contains("key", F.lit("asia")))
    name = F.concat(F.lit("Asia "), F.regexp_extract("compound", r"^Brand#(\d+)", 1))
    return p.select("key", F.lit("done").alias("status"), F.lit("compound").alias("kind"), name.alias("compound"), F.lit(None).cast("string").alias("compound_ar"), F.lit("Asia Land").alias("developer"),
        F.lit(None).cast("string").alias("developer_ar"), F.lit(None).cast("string").alias("reference"), F.lit("high").alias("confidence"))


_query("alias_join", ELIGIBLE, r"""SELECT id, CASE WHEN compound LIKE '% ASIA%' THEN 'Asia ' || regexp_extract(compound, '^Brand#(\d+)', 1) ELSE compound END AS compound_name, CASE WHEN compound LIKE '% ASIA%' THEN 'Asia Land' ELSE developer END AS developer_name
    FROM proj WHERE source <> 'benchmark'""")(lambda s, d: entities.apply_aliases(_snap(s, d).projected.where("source <> 'benchmark'"), _aliases(s, d))[0].select("id", "compound_name", "developer_name"))


_VALIDATED = f"""{_PAIRS}, ref AS (SELECT compound, min(dev) AS dev FROM (SELECT compound, 'NATION_' || CAST(k % 25 AS VARCHAR) || ' Group' AS dev, row_number() OVER (PARTITION BY compound ORDER BY count(*) DESC, min(id)) AS r FROM launch0 GROUP BY 1, 2) WHERE r = 1 GROUP BY 1),
va AS (SELECT p.key, length(p.key) AS n, p.compound, p.developer, r.compound IS NOT NULL AS listed, r.dev, length(p.key) % 3 <> 0 AS sure, length(p.key) % 2 = 0 AS asked FROM pairs p LEFT JOIN ref r ON r.compound = p.compound),
vb AS (SELECT *, asked AND NOT listed AS n1, asked AND listed AND NOT sure AS n2, asked AND listed AND sure AND {_DEV.format("dev")} <> {_DEV.format("developer")} AS n3, n % 7 = 0 AS n4 FROM va)"""


@_query("validated_answers", _VALIDATED, """SELECT key, 'compound' AS kind, CASE WHEN NOT n4 THEN compound END AS compound, CASE WHEN asked AND listed AND sure AND NOT n3 THEN dev ELSE developer END AS developer, CASE WHEN asked AND listed AND sure AND NOT n3 THEN compound END AS reference,
    CASE WHEN n4 THEN 'low' WHEN sure THEN 'high' ELSE 'medium' END AS confidence, concat_ws(',', CASE WHEN n1 THEN 'reference_not_listed' END, CASE WHEN n2 THEN 'reference_not_certain' END, CASE WHEN n3 THEN 'reference_developer_differs' END, CASE WHEN n4 THEN 'compound_missing' END) AS notes FROM vb""")
def _validated(s, d):
    ref = entities.reference_index(adapter.launches(s, d))
    p = entities.spelling_pairs(adapter.listings(s, d))
    n = F.length("key")
    a = p.select("key", F.lit("compound").alias("kind"), F.when(n % 7 != 0, F.col("compound")).alias("compound"), "developer", F.when(n % 2 == 0, F.col("compound")).alias("reference"), F.when(n % 3 == 0, "medium").otherwise("high").alias("confidence"))
    return entities.validated(a, p, ref).withColumn("notes", F.array_join("notes", ","))


# ---- comparisons ---------------------------------------------------------------------------------

_PEER = ["id", "peer_count", "peer_rank", "peer_cash_ppm", "peer_median_cash_ppm", "peer_gap", "peer_cash_gap", "peer_headline_gap", "peer_cheapest_gap", "peer_same_finishing"]
_query("peer_comparison", COMPARED, f"SELECT {', '.join(_PEER)} FROM peers")(lambda s, d: (lambda z: compare.peer_comparison(z.resolved, z.default))(_snap(s, d)).select(*_PEER))
_LAUNCH = ["id", "launch_units", "launch_gap", "launch_cash_gap", "launch_headline_gap", "launch_developer_cash", "launch_cash_ppm", "launch_headline_ppm", "launch_down_share", "launch_plan_years", "launch_delivery_year", "launch_area_min", "launch_area_max", "launch_same_finishing"]
_query("launch_nearest5", COMPARED, f"SELECT {', '.join(_LAUNCH)} FROM launch")(lambda s, d: (lambda z: compare.launch_comparison(z.resolved, z.matched, z.today))(_snap(s, d)).select(*_LAUNCH))
_query("since_contract", COMPARED, "SELECT id, launch_contract_change, launch_contract_annual FROM launch WHERE launch_contract_change IS NOT NULL")(
    lambda s, d: _snap(s, d).records.where("launch_contract_change IS NOT NULL").select("id", "launch_contract_change", "launch_contract_annual")
)
_query("opportunity_levels", COMPARED, "SELECT id, level, score, n_signals FROM units")(lambda s, d: _snap(s, d).signals.select("id", "level", "score", "n_signals"))
_query("opportunity_ranking", COMPARED, f"SELECT id, row_number() OVER (ORDER BY {RANK}) - 1 AS rank FROM units QUALIFY rank < 1000")(lambda s, d: compare.ranked(_snap(s, d).records, 1000))
_TOP = ["id", "compound_key", "property_type", "price", "area_m2", "level", "score", "launch_gap", "peer_gap"]
_query("top_opportunities", COMPARED, f"SELECT id, compound_key, kind AS property_type, price, area_m2, level, score, launch_gap, peer_gap FROM resale ORDER BY {RANK} LIMIT 25")(lambda s, d: search.unit_query(_snap(s, d).records).limit(25).select(*_TOP))
_COMPARABLES = f""", ca AS (SELECT a.id, b.id AS other_id, b.cash_equivalent / b.area_m2 AS ppm, abs(ln(b.area_m2 / a.area_m2)) AS dist, a.finishing_class = b.finishing_class AND a.finishing_class <> 'unknown' AS same
  FROM units a JOIN units b ON a.compound_key = b.compound_key AND a.kind = b.kind AND a.id <> b.id AND {_NEAR} AND b.is_resale AND coalesce(b.cash_equivalent, 0) <> 0),
cb AS (SELECT *, count(*) FILTER (WHERE same) OVER (PARTITION BY id) AS ns FROM ca),
cl AS (SELECT a.id, b.id AS other_id, b.cash_equivalent / b.area_m2 AS ppm, abs(ln(b.area_m2 / a.area_m2)) AS dist FROM units a JOIN units b ON a.compound_key = b.compound_key AND a.class IS NOT DISTINCT FROM b.class AND a.id <> b.id
  AND b.is_resale AND coalesce(b.cash_equivalent, 0) <> 0 WHERE a.id NOT IN (SELECT id FROM ca)),
cc AS (SELECT id, other_id, ppm, dist FROM cb WHERE ns < 4 OR same UNION ALL SELECT id, other_id, ppm, dist FROM cl)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, other_id) AS position, other_id, round_even(ppm, 0) AS cash_ppm FROM cc QUALIFY position <= 60"""
_query("comparables_topk", COMPARED, _COMPARABLES)(lambda s, d: (lambda z: compare.comparables(z.resolved, z.default))(_snap(s, d)).select("id", F.col("position").cast("long").alias("position"), "other_id", "cash_ppm"))


_KEYS = "keys AS (SELECT compound_key AS key, any_value(compound_display) AS name, count(*) AS n FROM res WHERE is_resale AND compound_key <> '' GROUP BY 1)"
_ASKED = f"""{MATCHED}, {_KEYS},
ask0 AS (SELECT id AS request_id, CASE property_type WHEN 'apartments' THEN 'apartment' ELSE property_type END AS kind, area_m2, price, down_payment, CAST(installment_months AS DOUBLE) AS m, lower(compound) AS wanted,
    down_payment IS NOT NULL AND installment_months IS NOT NULL AS has_plan FROM listing WHERE area_m2 >= 20),
asked AS (SELECT a.*, -request_id - 1 AS id, coalesce(k.key, v.key, '') AS compound_key, round_even(price / area_m2, 0) AS price_per_m2, 'finished' AS finishing_class, NULL::INTEGER AS contract_year,
    CASE WHEN has_plan THEN round_even(down_payment + greatest(0.0, price - down_payment) * ({_Q} * (1 - pow({_Q}, {_N})) / (1 - {_Q}) / {_N}), 0) ELSE round_even(price, 0) END AS cash_equivalent
  FROM ask0 a LEFT JOIN keys k ON k.key = {_SLUG.format("a.wanted")} LEFT JOIN (SELECT lower(name) AS name, arg_min(key, n) AS key FROM keys GROUP BY 1) v ON v.name = a.wanted),
""" + COMPARED[COMPARED.index("pp AS (SELECT a.id") :].replace("FROM res a JOIN", "FROM asked a JOIN").replace("FROM res r LEFT JOIN peers", "FROM asked r LEFT JOIN peers")  # fmt: skip


@_query("evaluate_batch", _ASKED[: _ASKED.rindex(",\nresale AS")], """SELECT request_id, CASE WHEN compound_key = '' THEN 'compound_not_found' ELSE 'compared' END AS status, compound_key, cash_equivalent, '1_2y' AS delivery_bucket, launch_gap, peer_gap, peer_count, level, score,
    concat_ws(',', CASE WHEN dev THEN 'developer' END, CASE WHEN peer THEN 'peers' END) AS signals FROM units""")
def _evaluate(s, d):
    z = _snap(s, d)
    o = adapter.listings(s, d)
    ask = o.select(F.col("id").alias("request_id"), "property_type", F.col("area_m2"), "price", F.lower("compound").alias("compound"), "down_payment", (F.col("installment_months") / 12).alias("installment_years"), F.lit("2003").alias("delivery"), F.lit("finished").alias("finishing"))
    return compare.evaluate(ask.where("area_m2 >= 20"), z.named, z.default, z.matched, z.today)


# ---- rollups -------------------------------------------------------------------------------------

_LEVELS = ", ".join(f"count(*) FILTER (WHERE level = '{v}') AS {v}" for v in compare.LEVELS)
_PROFILE = f"""count(*) AS units, round_even(count(*) FILTER (WHERE delivery_bucket = 'ready') / nullif(count(*) FILTER (WHERE delivery_bucket <> 'unknown'), 0), 4) AS ready_share, count(*) FILTER (WHERE delivery_bucket <> 'unknown') AS delivery_known,
    round_even(median(round(delivery_years * 100)) FILTER (WHERE delivery_years > 0), -1) / 100 AS median_years_to_delivery, max(CAST(substr(delivery_date, 1, 4) AS INTEGER)) AS latest_delivery_year,
    round_even(count(*) FILTER (WHERE terms = 'plan') / nullif(count(*) FILTER (WHERE terms IN ('plan', 'cash')), 0), 4) AS plan_share, round_even(median(round((remaining_share) * 10000)) FILTER (WHERE terms = 'plan'), 0) / 10000 AS median_remaining_share,
    round_even(median(round(years * 10)) FILTER (WHERE terms = 'plan'), 0) / 10 AS median_plan_years, round_even(median(round((discount) * 10000)) FILTER (WHERE terms = 'plan'), 0) / 10000 AS median_plan_discount, min(area_m2) AS area_min, max(area_m2) AS area_max,
    count(*) FILTER (WHERE level IN ('strong', 'good')) AS good_count, {_LEVELS}"""
_PROFILE_COLUMNS = ["units", "ready_share", "delivery_known", "median_years_to_delivery", "latest_delivery_year", "plan_share", "median_remaining_share", "median_plan_years", "median_plan_discount", "area_min", "area_max", "good_count", *compare.LEVELS]
_query("compound_rollup", COMPARED, f"SELECT compound_key, {_PROFILE} FROM resale GROUP BY compound_key")(lambda s, d: _snap(s, d).compounds.select("compound_key", *_PROFILE_COLUMNS))
_query("developer_rollup", COMPARED, f"SELECT developer_key, {_PROFILE} FROM resale GROUP BY developer_key")(lambda s, d: _snap(s, d).developers.select("developer_key", *_PROFILE_COLUMNS))
_query("district_rollup", COMPARED, f"SELECT {_SLUG.format('district')} AS district_key, {_PROFILE} FROM resale GROUP BY 1")(lambda s, d: _snap(s, d).districts.select("district_key", *_PROFILE_COLUMNS))
_CLASSES = """, pcl AS (SELECT compound_key, class, count(*) AS units, round_even(median(price_per_m2), -2) AS median_asking_ppm, round_even(median(cash_equivalent / area_m2) FILTER (WHERE cash_equivalent <> 0), -2) AS median_cash_ppm,
  round_even(median(round((launch_gap) * 10000)) FILTER (WHERE launch_same_finishing), 0) / 10000 AS median_gap, count(*) FILTER (WHERE launch_same_finishing) AS compared FROM resale WHERE class IS NOT NULL GROUP BY 1, 2),
pdv AS (SELECT compound_key, class, round_even(median(price_per_m2), -2) AS developer_ppm FROM matched WHERE class IS NOT NULL AND compound_key IS NOT NULL GROUP BY 1, 2)
SELECT pcl.*, pdv.developer_ppm FROM pcl LEFT JOIN pdv ON pdv.compound_key = pcl.compound_key AND pdv.class = pcl.class"""
_query("price_classes", COMPARED, _CLASSES)(lambda s, d: (lambda z: rollup.price_classes(z.resale, z.matched.where("compound_key IS NOT NULL"), ["compound_key"]))(_snap(s, d)).select("compound_key", "class", "units", "median_asking_ppm", "median_cash_ppm", "median_gap", "compared", "developer_ppm"))
_DEVELOPER = """, du AS (SELECT compound_key, count(*) AS launch_units, round_even(median(price_per_m2), -2) AS median_headline_ppm, round_even(median(cash_equivalent / area_m2), -2) AS median_cash_ppm,
  round_even(median(round((1 - coalesce(remaining_share, 0)) * 10000)), 0) / 10000 AS median_down_share FROM matched WHERE compound_key IS NOT NULL GROUP BY 1),
dr AS (SELECT compound_key, count(*) FILTER (WHERE launch_same_finishing) AS compared, round_even(median(round((launch_gap) * 10000)) FILTER (WHERE launch_same_finishing), 0) / 10000 AS median_gap, round_even(median(round((launch_contract_annual) * 10000)), 0) / 10000 AS median_since_contract FROM resale GROUP BY 1)
SELECT du.*, coalesce(compared, 0) AS compared, median_gap, median_since_contract FROM du LEFT JOIN dr ON dr.compound_key = du.compound_key"""
_query("developer_prices", COMPARED, _DEVELOPER)(lambda s, d: (lambda z: rollup.developer_prices(z.matched.where("compound_key IS NOT NULL"), z.resale, ["compound_key"]))(_snap(s, d)).select("compound_key", "launch_units", "median_headline_ppm", "median_cash_ppm", "median_down_share", "compared", "median_gap", "median_since_contract"))
_query("source_scope", COMPARED, "SELECT compound_key, source, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY compound_key), 4) AS share FROM resale GROUP BY 1, 2")(lambda s, d: rollup.scope(_snap(s, d).resale, ["compound_key"]))
_query("overview_counts", COMPARED, f"""SELECT (SELECT count(*) FROM allrows WHERE source <> 'benchmark') AS total_records, (SELECT count(*) FROM units) AS total_eligible, count(*) AS total_resale, count(*) FILTER (WHERE level <> 'unrated') AS rated_count, {_LEVELS},
    count(*) FILTER (WHERE terms = 'plan') AS terms_plan, count(*) FILTER (WHERE terms = 'cash') AS terms_cash, count(*) FILTER (WHERE launch_same_finishing) AS compared, round_even(median(round((launch_gap) * 10000)) FILTER (WHERE launch_same_finishing), 0) / 10000 AS median_gap,
    count(peer_gap) AS ranked, round_even(median(round((launch_contract_annual) * 10000)), 0) / 10000 AS since_median FROM resale""")(
    lambda s, d: (lambda z: rollup.overview(z.raw, z.records, z.resale, z.roles.primary))(_snap(s, d)).select("total_records", "total_eligible", "total_resale", "rated_count", *compare.LEVELS, "terms_plan", "terms_cash", "compared", "median_gap", "ranked", "since_median")
)
_query("source_rows", f"{COMPARED}", """SELECT a.source, a.n AS rows, coalesce(r.n, 0) AS resale_count, coalesce(r.rated, 0) AS rated_count FROM (SELECT source, count(*) AS n FROM allrows GROUP BY 1) a
    LEFT JOIN (SELECT source, count(*) AS n, count(*) FILTER (WHERE level <> 'unrated') AS rated FROM resale GROUP BY 1) r ON r.source = a.source""")(lambda s, d: (lambda z: rollup.source_rows(z.raw, z.resale, adapter.runs(s, d)))(_snap(s, d)).select("source", "rows", "resale_count", "rated_count"))
_query("developer_gaps", COMPARED, """SELECT developer_key, count(*) FILTER (WHERE launch_same_finishing) AS compared, round_even(median(round((launch_gap) * 10000)) FILTER (WHERE launch_same_finishing), 0) / 10000 AS median_gap FROM resale
    WHERE developer_key IN (SELECT i.dev FROM (SELECT compound_key, arg_min(developer_key, (""" + LEVEL_ORDER + """, -n_signals, coalesce(score, 0.0), id)) AS dev FROM resale GROUP BY 1) i JOIN matched m ON m.compound_key = i.compound_key)
    GROUP BY 1 HAVING count(*) FILTER (WHERE launch_same_finishing) >= 20""")(lambda s, d: search.entity_query(_snap(s, d).developers, "developer", sort="gap_asc").select("developer_key", "compared", "median_gap"))
_query("delivery_changes", COMPARED, """SELECT developer_key, count(delivery_date) AS tracked_units, count(*) FILTER (WHERE id % 7 = 0) AS postponed, count(*) FILTER (WHERE id % 7 = 1) AS brought_forward FROM resale GROUP BY 1""")(
    lambda s, d: (lambda z: rollup.delivery_changes(
        z.raw.where("id % 7 < 2").select(F.col("id").alias("property_id"), F.col("last_seen_at").alias("captured_at"), F.create_map(F.lit("delivery_date"), F.struct(F.when(F.col("id") % 7 == 0, "2001").otherwise("2003").alias("old"), F.lit("2002").alias("new"))).alias("changed_fields")), z.default))(_snap(s, d))
)
_query("catalog_types", COMPARED, "SELECT kind AS property_type, class, count(*) AS n FROM resale GROUP BY 1, 2")(lambda s, d: _snap(s, d).resale.groupBy("property_type", "class").agg(F.count(F.lit(1)).alias("n")))

# ---- search --------------------------------------------------------------------------------------

_ORDERS = {"launch_gap": ("level <> 'check' AND launch_same_finishing", "launch_gap, id"), "peer_gap": ("level <> 'check' AND peer_gap IS NOT NULL", "peer_gap, id"), "cash_ppm_asc": ("coalesce(cash_equivalent, 0) <> 0", "cash_equivalent / area_m2, id"),
    "price_asc": ("true", "price, id"), "price_desc": ("true", "price DESC, id"), "area_desc": ("true", "area_m2 DESC, id"), "newest": ("true", "id DESC")}
for _sort, (_where, _by) in _ORDERS.items():
    _query(f"units_by_{_sort}", COMPARED, f"SELECT id, price, level FROM resale WHERE {_where} ORDER BY {_by} LIMIT 30 OFFSET 30")(
        lambda s, d, sort=_sort: search.page_of(search.unit_query(_snap(s, d).records, sort=sort), 2, 30).select("id", "price", "level")
    )
_query("units_budget", COMPARED, """SELECT id FROM resale WHERE price <= 20000000 AND cash_equivalent <= 12000000 AND price - remaining <= 6000000 AND area_m2 >= 60 AND bedrooms >= 2 AND (delivery_bucket = 'ready' OR substr(delivery_date, 1, 4) <= '2003')""")(
    lambda s, d: search.unit_query(_snap(s, d).records, price_max=20_000_000, cash_max=12_000_000, signing_max=6_000_000, area_min=60, bedrooms_min=2, delivery="2003").select("id")
)
_query("units_search", COMPARED, "SELECT id FROM resale WHERE contains(lower(concat_ws(' ', title, district, compound, developer)), 'widget') AND contains(lower(concat_ws(' ', title, district, compound, developer)), 'asia')")(lambda s, d: search.unit_query(_snap(s, d).records, q="Widget asia").select("id"))
_query("entities_gap_sort", COMPARED, """SELECT compound_key, count(*) FILTER (WHERE launch_same_finishing) AS compared, round_even(median(round((launch_gap) * 10000)) FILTER (WHERE launch_same_finishing), 0) / 10000 AS median_gap FROM resale
    WHERE compound_key IN (SELECT compound_key FROM matched) GROUP BY 1 HAVING count(*) FILTER (WHERE launch_same_finishing) >= 5""")(lambda s, d: search.entity_query(_snap(s, d).compounds, "compound", sort="gap_asc").select("compound_key", "compared", "median_gap"))
_query("entities_name_sort", COMPARED, "SELECT compound_key, count(*) AS units FROM resale GROUP BY 1 ORDER BY any_value(lower(compound_display)), units DESC, compound_key LIMIT 30")(lambda s, d: search.page_of(search.entity_query(_snap(s, d).compounds, "compound", sort="name"), 1, 30).select("compound_key", "units"))
_query("url_lookup", RESOLVED, "SELECT min(id) AS id, 'example.com/unit/' || CAST(id - CASE WHEN id % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS url_key FROM res GROUP BY 2 HAVING count(*) = 1")(lambda s, d: rollup.unique_urls(_snap(s, d).resolved))
_query("page_count", COMPARED, "SELECT count(*) AS total, CAST(ceil(count(*) / 30) AS BIGINT) AS pages FROM resale")(lambda s, d: search.page_count(_snap(s, d).resale, 30))
_query("saved_search_new", RESOLVED, "SELECT count(*) AS n, max(id) AS newest FROM res WHERE id > 5000")(lambda s, d: search.newer(_snap(s, d).resolved, 5000))

# ---- change capture ------------------------------------------------------------------------------


def _crawl(s, d):
    """A later crawl: some listings are cheaper, some are gone."""
    rows = adapter.listings(s, d).where("id % 13 <> 0")
    return rows.withColumn("price", F.when(F.col("id") % 11 == 0, F.bround(F.col("price") * 0.95)).otherwise(F.col("price")))


_NOW = "2001-08-02"
_query("upsert_actions", LISTING_SQL, "SELECT id, CASE WHEN status = 'removed' THEN 'relisted' WHEN id % 11 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM listing WHERE id % 13 <> 0 AND id % 17 <> 0 UNION ALL SELECT id, 'created' FROM listing WHERE id % 13 <> 0 AND id % 17 = 0")(
    lambda s, d: cdc.upsert(adapter.listings(s, d).where("id % 17 <> 0"), _crawl(s, d), F.lit(_NOW).cast("timestamp")).select(F.col("source_listing_id").cast("long").alias("id"), "action")
)
_query("version_diffs", LISTING_SQL, "SELECT id, price AS old_price, round_even(price * 0.95, 0) AS new_price FROM listing WHERE id % 13 <> 0 AND id % 11 = 0 AND status = 'active'")(
    lambda s, d: cdc.upsert(adapter.listings(s, d), _crawl(s, d), F.lit(_NOW).cast("timestamp")).where("action = 'updated'").select(F.col("source_listing_id").cast("long").alias("id"), F.col("changed_fields")["price"]["old"].cast("double").alias("old_price"), F.col("changed_fields")["price"]["new"].cast("double").alias("new_price"))
)
_query("mark_removals", LISTING_SQL, f"SELECT scope_key, count(*) AS n FROM listing WHERE status = 'active' AND source = 'portal' AND scope_key LIKE 'ASIA/%' AND last_seen_at < TIMESTAMP '{LATEST}' - INTERVAL 5 DAY GROUP BY 1")(
    lambda s, d: (lambda x: cdc.mark_removals(x, x.where("source = 'portal' AND scope_key LIKE 'ASIA/%'").select("source", "scope_key").distinct().withColumn("cutoff", F.lit(LATEST).cast("timestamp") - F.expr("INTERVAL 5 DAYS")), F.lit(_NOW).cast("timestamp"))
        .where("removed_now").groupBy("scope_key").agg(F.count(F.lit(1)).alias("n")))(adapter.listings(s, d))
)
_query("touch_present", LISTING_SQL, "SELECT count(*) AS n FROM listing WHERE status = 'active' AND id % 3 = 0")(
    lambda s, d: (lambda x: cdc.touch_present(x, x.where("id % 3 = 0"), F.lit(_NOW).cast("timestamp")).where(F.col("last_seen_at") == F.lit(_NOW).cast("timestamp")).agg(F.count(F.lit(1)).alias("n")))(adapter.listings(s, d))
)
_query("inventory_diff", None, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'gone' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS kind FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)")(
    lambda s, d: (lambda o: cdc.inventory_diff(o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "b").otherwise("a").alias("lastmod")), o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.lit("a").alias("lastmod"))))(adapter.table(s, d, "orders"))
)
_query("paging_guard", None, "SELECT event_type AS run_id, count(*) AS seen, count(DISTINCT user_id) AS n_distinct, count(*) >= 200 AND 2 * count(DISTINCT user_id) < count(*) AS repeats FROM events GROUP BY 1")(lambda s, d: cdc.repeats_itself(adapter.table(s, d, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("listing_id"))))
_query("canonical_types", LISTING_SQL, "SELECT CASE property_type WHEN 'apartments' THEN 'apartment' ELSE property_type END AS property_type, count(*) AS n FROM listing GROUP BY 1")(
    lambda s, d: cdc.canonical_types(adapter.listings(s, d), ("apartment", "studio", "villa", "chalet", "office")).groupBy("property_type").agg(F.count(F.lit(1)).alias("n"))
)
_query("backfill_fields", LISTING_SQL, "SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(down_payment, CASE WHEN price * 0.5 < price THEN price * 0.5 END) ELSE down_payment END AS down_payment, is_installment OR id % 2 = 0 AS is_installment FROM listing")(
    lambda s, d: (lambda x: cdc.backfill(x, x.where("id % 2 = 0").select("source", "source_listing_id", (F.col("price") * 0.5).alias("down_payment"), F.lit(True).alias("is_installment"))).select("id", "down_payment", "is_installment"))(adapter.listings(s, d))
)
# ---- monitoring, publication, model --------------------------------------------------------------

_AT = "2024-01-20 12:00:00"
_HEALTH = f""", h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM runs QUALIFY n <= 60),
good AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS g FROM h WHERE status IN ('completed', 'partial') AND seen > 0), first AS (SELECT * FROM good WHERE g = 1),
same AS (SELECT good.*, row_number() OVER (PARTITION BY good.source ORDER BY good.n) AS k FROM good JOIN first f ON f.source = good.source AND f.scope IS NOT DISTINCT FROM good.scope),
typ AS (SELECT source, median(seen) AS typical_seen FROM same WHERE k BETWEEN 2 AND 6 GROUP BY 1),
fin AS (SELECT source, count(*) AS ended, count(*) FILTER (WHERE status = 'failed') AS failed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS k FROM h WHERE status <> 'running') WHERE k <= 2 GROUP BY 1)
SELECT h.source, CASE WHEN h.status = 'running' AND epoch(TIMESTAMP '{_AT}') - epoch(h.started_at) <= 6 * 3600 THEN 'running' WHEN f.source IS NULL THEN 'failing' WHEN ended = 2 AND failed = 2 THEN 'failing'
  WHEN epoch(TIMESTAMP '{_AT}') - epoch(coalesce(f.finished_at, f.started_at)) > 36 * 3600 THEN 'stale' WHEN typical_seen > 0 AND f.seen < 0.5 * typical_seen THEN 'dropped' ELSE 'ok' END AS state, h.status AS last_status, coalesce(f.seen, 0) AS last_seen, typical_seen
FROM h LEFT JOIN first f ON f.source = h.source LEFT JOIN typ ON typ.source = h.source LEFT JOIN fin ON fin.source = h.source WHERE h.n = 1"""
_query("source_health", RUNS_SQL, _HEALTH)(lambda s, d: (lambda r: health.source_health(r, r, F.lit(_AT).cast("timestamp")))(adapter.runs(s, d)).select("source", "state", "last_status", "last_seen", "typical_seen"))
_query("abandoned_runs", RUNS_SQL, f"SELECT source, count(*) AS closed FROM runs WHERE status = 'running' AND epoch(TIMESTAMP '{_AT}') - epoch(started_at) > 6 * 3600 GROUP BY 1")(lambda s, d: health.close_abandoned(adapter.runs(s, d), F.lit(_AT).cast("timestamp")).where("closed").groupBy("source").agg(F.count(F.lit(1)).alias("closed")))
_query("run_totals", RUNS_SQL, "SELECT source, count(*) AS runs, CAST(sum(seen) AS BIGINT) AS seen, " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in ("completed", "partial", "failed", "running")) + " FROM runs GROUP BY 1")(lambda s, d: health.totals(adapter.runs(s, d)))
_query("document_chunks", None, "SELECT CAST(doc_id AS VARCHAR) AS key, unnest(range(0, greatest(1, CAST(ceil(length(text) / 8000.0) AS BIGINT)))) AS part, length(substr(text, CAST(unnest(range(0, greatest(1, CAST(ceil(length(text) / 8000.0) AS BIGINT)))) AS BIGINT) * 8000 + 1, 8000)) AS size FROM documents")(
    lambda s, d: publish.parts(adapter.table(s, d, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("key"), "text")).select("key", F.col("part").cast("long").alias("part"), F.length("text").cast("long").alias("size"))
)
_query("retention_versions", None, "SELECT p_brand AS version, n FROM (SELECT p_brand, count(*) AS n, max(p_partkey) AS g, row_number() OVER (ORDER BY max(p_partkey) DESC, p_brand DESC) AS k FROM part GROUP BY 1) WHERE k <= 3 OR p_brand = 'Brand#1'")(
    lambda s, d: publish.kept_versions(adapter.table(s, d, "part").groupBy(F.col("p_brand").alias("version")).agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("generated_at")), "Brand#1").select("version", "n")
)
_query("activation_check", None, "SELECT l_returnflag AS version, l_returnflag <> 'R' AS ready, count(*) AS rows FROM lineitem GROUP BY 1")(
    lambda s, d: (lambda c: publish.activation(c.withColumn("n", F.when(F.col("version") == "R", F.col("n") + 1).otherwise(F.col("n"))), c))(adapter.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("version"), F.col("l_linestatus").alias("table")).agg(F.count(F.lit(1)).alias("n")))
)


def _model_units(s, d):
    r = _snap(s, d).resolved.where("coalesce(cash_equivalent, 0) <> 0")
    return r.select("id", F.col("class").alias("cls"), F.col("property_type").alias("type"), "district", F.col("developer_key").alias("developer"), F.col("compound_key").alias("compound"), F.col("finishing_class").alias("finishing"),
        F.col("delivery_bucket").alias("delivery"), M.plan_bucket(F.col("terms"), F.col("years")).alias("plan"), F.log("area_m2").alias("log_area"), F.log(F.col("cash_equivalent") / F.col("area_m2")).alias("y"))


def _fit(s, d):
    from .plans.storage import saver

    return model.fit(_model_units(s, d), saver(s))


_query("model_backtest")(lambda s, d: model.backtest(_fit(s, d)))
_query("model_predictions")(lambda s, d: model.predict(_m := _fit(s, d), _m.units, exclude=True).select("id", "grade", F.bround("log_fair", 6).alias("log_fair")))
_NAIVE = """, mu AS (SELECT id, class AS cls, lower(district) AS dk, ln(cash_equivalent / area_m2) AS y FROM res WHERE coalesce(cash_equivalent, 0) <> 0 AND class IS NOT NULL),
mr AS (SELECT *, row_number() OVER (PARTITION BY cls, dk ORDER BY y, id) AS r, count(*) OVER (PARTITION BY cls, dk) AS n FROM mu),
ml AS (SELECT cls, dk, list(y ORDER BY y, id) AS ys FROM mu GROUP BY 1, 2),
mx AS (SELECT mr.*, ys, n // 2 AS lo, (n + 1) // 2 AS hi FROM mr JOIN ml USING (cls, dk) WHERE n >= 6)
SELECT id, round(abs(exp(y - (ys[CASE WHEN r <= lo THEN lo + 1 ELSE lo END] + ys[CASE WHEN r <= hi THEN hi + 1 ELSE hi END]) / 2) - 1), 6) AS naive_error FROM mx"""
_query("model_naive_errors", COMPARED, _NAIVE)(lambda s, d: model.naive(_model_units(s, d).where("cls IS NOT NULL")).withColumn("naive_error", F.round("naive_error", 6)))

# ---- text, pages ---------------------------------------------------------------------------------

_query("slug_keys", None, f"SELECT doc_id, {_SLUG.format('text')} AS key FROM documents")(lambda s, d: adapter.table(s, d, "documents").select("doc_id", T.slug(F.col("text")).alias("key")))
_query("parse_numbers", None, r"SELECT page_id, CAST(nullif(regexp_extract(regexp_replace(url, '[,\s'']', '', 'g'), '[0-9]+(\.[0-9]+)?'), '') AS DOUBLE) AS n FROM pages")(lambda s, d: adapter.table(s, d, "pages").select("page_id", T.parse_number(F.col("url")).alias("n")))
_query("url_keys", None, r"SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS url_key FROM pages")(
    lambda s, d: adapter.table(s, d, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"))
)
_query("fold_keys", LISTING_SQL, f"SELECT id, {_FOLD.format('compound')} AS folded FROM listing")(lambda s, d: adapter.listings(s, d).select("id", T.fold(F.col("compound")).alias("folded")))
_PLAIN = r"""WITH a AS (SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[\s\x{a0}\x{85}]+', ' ', 'g')) AS t FROM a)
SELECT page_id, substr(t, 1, 400) AS text FROM b"""
_query("clean_text", None, _PLAIN)(lambda s, d: adapter.table(s, d, "pages").select("page_id", T.clean_text(F.col("html"), closed=True, withhold=False).alias("text")))
_query("phone_redaction", LISTING_SQL, "SELECT o_orderkey AS id, p_name || ' call [contact withheld]' AS description FROM raw0")(lambda s, d: adapter.listings(s, d).select("id", T.clean_text(F.col("description")).alias("description")))
_query("html_listings")(lambda s, d: pages.page_listings(adapter.table(s, d, "pages")))
