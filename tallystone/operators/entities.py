"""Names to entities: votes, aliases, variants of compounds, spelling pairs, validation of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as T

ANCHOR_LISTINGS, MAX_ATTEMPTS, KNOWN_LIMIT = 5, 3, 1500


def vote(df: DataFrame, key, value: str, order: list[Column], out: str, n: Column | None = None) -> DataFrame:
    """The most frequent non-empty value of each key; of equal counts the one met first. n: how often a row counts (once).

    Votes are counted before they are ranked, so a frequent key costs a row for each of
    its values, not for each of its rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    met = F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    times = F.count(F.lit(1)) if n is None else F.sum(n)
    votes = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(*keys, value).agg(times.alias("n"), met.alias("met"))
    best = votes.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("n", *(F.struct((-F.col(f"met.o{i}")).alias("o")) for i in range(len(order))))).alias(out))
    return best


def ranked_votes(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n and the rank of each value of a key."""
    votes = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("met"))
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "met")))


def good_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.where("status = 'done' AND confidence IN ('high', 'medium')")


def apply_aliases(records: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with canonical names, and (reference, key): which compound a reference name belongs to.

    Spellings of one compound share its reference, else its folded name and developer;
    each such identity shows one name, its most frequent. Where two identities would share
    a key, the smaller takes its developer into the name.
    """
    a = good_aliases(aliases).select("key", "kind", F.col("compound").alias("a_compound"), "compound_ar", F.col("developer").alias("a_developer"), "developer_ar", "reference", "confidence")
    r = records.withColumn("key", T.alias_key(F.col("compound_name"), F.col("developer_name"))).join(a, "key", "left").drop("key")
    named = (F.coalesce("kind", F.lit("")) != "not_compound") & (F.coalesce("a_compound", F.lit("")) != "")
    developer = F.coalesce(T.or_null(F.col("a_developer")), F.col("developer_name"))
    has_ref = F.coalesce("reference", F.lit("")) != ""
    identity = F.when(has_ref, F.concat(F.lit("reference\t"), "reference")).otherwise(F.concat(F.lit("name\t"), T.fold(F.col("a_compound")), F.lit("\t"), T.developer_key(developer)))
    drop = (F.col("kind") == "not_compound") & (F.col("confidence") == "high")
    r = r.withColumns({
        "identity": F.when(named, identity), "developer_name": F.when(named, developer).otherwise(F.col("developer_name")),
        "compound_name": F.when(F.coalesce(drop, F.lit(False)), F.lit(None)).otherwise(F.col("compound_name")),
        "developer_name_ar": F.when(named, F.col("developer_ar")), "compound_name_ar": F.when(named, F.col("compound_ar")),
    }).drop("kind", "confidence", "developer_ar", "compound_ar", "a_developer")
    on = r.where("identity IS NOT NULL")
    sums = on.groupBy("identity").agg(F.count(F.lit(1)).alias("total"), F.min("id").alias("met"), F.min_by("developer_name", "id").alias("dev"), F.max("reference").alias("reference"))
    names = vote(on, "identity", "a_compound", [F.col("id")], "name").join(sums, "identity").withColumn("slug", T.slug(F.col("name")))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("total"), "met"))
    tail = F.coalesce(T.or_null(F.col("dev")), F.element_at(F.split("identity", "\t"), -1))
    names = names.withColumn("display", F.when(place > 1, F.concat("name", F.lit(" ("), tail, F.lit(")"))).otherwise(F.col("name")))
    out = r.drop("reference", "a_compound").join(names.select("identity", "display"), "identity", "left")
    out = out.withColumn("compound_name", F.coalesce("display", "compound_name")).drop("display", "identity")
    refs = names.where(F.startswith("identity", F.lit("reference\t"))).select(T.slug(F.col("reference")).alias("reference"), T.slug(F.col("display")).alias("key"))
    return out, refs


def prefixes(key: str) -> Column:
    """Every proper prefix of a key that ends before a dash."""
    parts = F.split(key, "-")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "-"))).otherwise(F.array().cast("array<string>"))


def match_variants(keys: DataFrame) -> DataFrame:
    """key, target: the established compound that a rarer key spells in another way.

    keys has key, n (listings) and developers (an array). Candidates share a developer, or
    are all anchors where the key has none. In this order: a known Arabic spelling; the
    same letters; one a prefix of the other (the longest anchor inside the key, else the
    shortest around it); one candidate with the key's first telling word. All are joins by
    equality. Between equals the shorter, then the alphabetically first anchor is taken.
    """
    anchors = keys.where(F.col("n") >= ANCHOR_LISTINGS).select(F.col("key").alias("anchor"), F.col("developers").alias("a_devs"))
    plain = F.regexp_replace("key", "^(كمبوند|compound)-", "")
    v = keys.where(F.col("n") < ANCHOR_LISTINGS).select("key", "developers", plain.alias("plain"))
    shared = (F.size("developers") == 0) | F.arrays_overlap("developers", "a_devs")
    by_alias = v.select("key", L.lookup({k: x for k, x in _slugged()}, F.col("plain")).alias("anchor")).join(anchors.select("anchor"), "anchor").select("key", "anchor", F.lit(1).alias("rule"), F.lit(0).alias("by"))
    flat = lambda c: F.regexp_replace(c, "-", "")
    same = v.join(anchors, (flat("plain") == flat("anchor")) & shared).select("key", "anchor", F.lit(2).alias("rule"), F.length("anchor").alias("by"))
    inside = v.withColumn("p", F.explode(prefixes("plain"))).join(anchors, (F.col("p") == F.col("anchor")) & shared).select("key", "anchor", F.lit(3).alias("rule"), (-F.length("anchor")).alias("by"))
    around = v.join(anchors.withColumn("p", F.explode(prefixes("anchor"))), (F.col("plain") == F.col("p")) & shared).select("key", "anchor", F.lit(4).alias("rule"), F.length("anchor").alias("by"))
    telling = lambda a: F.filter(a, lambda w: ~w.isin(*L.GENERIC) & (F.length(w) >= 4))
    word = v.where(F.size("developers") > 0).withColumn("w", F.try_element_at(telling(F.split("plain", "-")), F.lit(1))).where("w IS NOT NULL")
    by_word = word.join(anchors.withColumn("w2", F.explode(F.array_distinct(F.split("anchor", "-")))), (F.col("w") == F.col("w2")) & shared)
    by_word = by_word.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("anchor").alias("anchor")).where("c = 1").select("key", "anchor", F.lit(5).alias("rule"), F.lit(0).alias("by"))
    found = by_alias.unionByName(same).unionByName(inside).unionByName(around).unionByName(by_word)
    return found.groupBy("key").agg(F.min(F.struct("rule", "by", "anchor")).alias("m")).select("key", F.col("m.anchor").alias("target"))


def _slugged():
    for name, key in L.COMPOUNDS.items():
        yield "-".join(name.split()), key


#: Rows of a table of names that are broadcast.
NAMES = 10_000


def _looked_up(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with what a saved table says of a key; small ones are broadcast, so that rows stay where they are."""
    small = names.limit(NAMES + 1).count() <= NAMES
    return rows.join(F.broadcast(names) if small else names, key, "left")


def resolve(records: DataFrame, save=lambda df, name: df) -> DataFrame:
    """Records with compound_key, developer_key, district, and the shown names of both.

    Keys are formed and votes are counted over the distinct spellings, which are saved with
    their number and the first id that has them. Records only look the results up by their names.
    """
    spelt = {"_c": F.coalesce("compound_name", F.lit("")), "_d": F.coalesce("developer_name", F.lit(""))}
    g = records.withColumns(spelt).groupBy("_c", "_d", "district").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("met"))
    g = save(T.computed(g, {"own_key": T.slug(F.col("_c")), "own_dev": T.developer_key(F.col("_d"))}), "spellings")
    keys = g.where("own_key <> ''").groupBy(F.col("own_key").alias("key")).agg(F.sum("n").alias("n"), F.collect_set(T.or_null(F.col("own_dev"))).alias("developers"))
    variants = match_variants(save(keys, "keys"))
    g = save(g.join(variants.withColumnRenamed("key", "own_key"), "own_key", "left").withColumn("compound_key", F.coalesce("target", "own_key")), "placed")
    inside = g.where("compound_key <> ''").withColumn("variant", F.col("target").isNotNull().cast("int"))
    order, n = [F.col("variant"), F.col("met")], F.col("n")
    district = vote(inside, "compound_key", "district", order, "c_district", n)
    developer = vote(inside, "compound_key", "own_dev", order, "c_dev", n)
    # A variant's name is no vote for its target's name.
    name = vote(inside.where("variant = 0"), "compound_key", "_c", [F.col("met")], "compound", n)
    dev_name = vote(g.where("own_dev <> ''").withColumnRenamed("own_dev", "developer_key"), "developer_key", "_d", [F.col("met")], "developer", n)
    compounds = g.select("_c", "compound_key").distinct().join(district, "compound_key", "left").join(developer, "compound_key", "left").join(name, "compound_key", "left")
    out = _looked_up(records.withColumns(spelt), save(compounds, "compound_names"), "_c")
    out = _looked_up(out, save(g.select("_d", "own_dev").distinct(), "developer_names"), "_d")
    out = out.withColumns({"developer_key": F.coalesce(T.or_null(F.col("own_dev")), "c_dev", F.lit("")), "district": F.coalesce("c_district", "district")})
    out = _looked_up(out, save(dev_name, "developers"), "developer_key").drop("_c", "_d", "own_dev", "c_district", "c_dev")
    # Names in Arabic come with aliases; a compound and a developer have the one that most of their records have.
    for what in ("compound", "developer"):
        if f"{what}_name_ar" in records.columns:
            names = arabic_names(out, f"{what}_key", f"{what}_name_ar").withColumnRenamed("name_ar", f"{what}_ar")
            out = out.join(names, f"{what}_key", "left")
    return out


def arabic_names(records: DataFrame, key: str, value: str) -> DataFrame:
    """key and the Arabic name that most of its records have; keys without one are left out."""
    return vote(records.where(F.coalesce(F.col(key), F.lit("")) != ""), key, value, [F.col("id")], "name_ar")


def _clean(c: str, limit: int = 200) -> Column:
    return T.or_null(F.substring(T.squeeze(F.col(c)), 1, limit))


def spelling_pairs(rows: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """key, compound, developer, district, listings of every pair of spellings in active rows, most frequent first."""
    r = rows.where("status = 'active' AND compound IS NOT NULL")
    r = r if sources is None else r.where(F.col("source").isin(*sources))
    # Spellings are counted as they are before any key is formed: keys are needed of distinct ones only.
    g = r.groupBy("compound", "developer", "district").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("met"))
    pair = F.struct(_clean("compound").alias("c"), _clean("developer").alias("d"))
    g = T.computed(g, {"key": T.alias_key(F.col("compound"), F.col("developer")), "pair": pair, "place": _clean("district")}).where("key IS NOT NULL")
    out = g.groupBy("key").agg(F.sum("n").alias("listings")).join(_weighted_vote(g, "pair"), "key").join(_weighted_vote(g.where("place IS NOT NULL"), "place"), "key", "left")
    return out.select("key", F.col("pair.c").alias("compound"), F.col("pair.d").alias("developer"), F.col("place").alias("district"), "listings")


def _weighted_vote(groups: DataFrame, value: str) -> DataFrame:
    """Of each key, the value of most listings (n); of equal ones the one met first."""
    v = groups.groupBy("key", value).agg(F.sum("n").alias("n"), F.min("met").alias("met"))
    return v.groupBy("key").agg(F.max_by(value, F.struct("n", (-F.col("met")).alias("m"))).alias(value))


def reference_index(rows: DataFrame) -> DataFrame:
    """compound, developer, area, units of a reference source's rows."""
    r = rows.select("id", _clean("compound").alias("compound"), _clean("developer").alias("developer"), _clean("district").alias("area")).where("compound IS NOT NULL")
    units = r.groupBy("compound").agg(F.count(F.lit(1)).alias("units"))
    return units.join(vote(r, "compound", "developer", [F.col("id")], "developer"), "compound", "left").join(vote(r, "compound", "area", [F.col("id")], "area"), "compound", "left")


def pending(pairs: DataFrame, stored: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Pairs without an answer, and those that failed fewer than MAX_ATTEMPTS times."""
    s = stored.select("key", F.col("status").alias("s"), F.coalesce(F.nullif("attempts", F.lit(0)), F.lit(1)).alias("a"))
    again = (F.col("s") == "failed") & (F.col("a") < MAX_ATTEMPTS) if retry_failed else F.lit(False)
    joined = pairs.join(s, "key", "left")
    return joined.where(F.col("s").isNull() | again).drop("s", "a")


def known_names(stored: DataFrame, limit: int = KNOWN_LIMIT) -> DataFrame:
    """The most listed names given to compounds outside the reference."""
    ok = "status = 'done' AND kind = 'compound' AND reference IS NULL AND compound IS NOT NULL AND confidence <> 'low'"
    name = F.regexp_replace(F.concat("compound", F.lit(" | "), F.coalesce("developer", F.lit(""))), r"^[ |]+|[ |]+$", "")
    return stored.where(ok).groupBy(name.alias("name")).agg(F.sum(F.coalesce(F.nullif("listings", F.lit(0)), F.lit(1))).alias("weight")).orderBy(F.desc("weight"), "name").limit(limit)


def validated(answers: DataFrame, pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Answers (key, kind, compound, developer, reference, confidence, …) as they may be stored, with notes on what was refused.

    A reference must be listed, certain and of the same developer, whose spelling it then
    brings; a compound without a name is of low confidence; a reference compound is not
    placed inside one of another area.
    """
    p = pairs.select("key", F.col("compound").alias("p_compound"), F.col("district").alias("p_district"))
    a = answers.join(p, "key")
    kind = F.when(F.col("kind").isin("compound", "not_compound"), F.col("kind"))
    sure = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low")
    is_c = F.coalesce(kind == "compound", F.lit(False))
    a = a.select("key", "p_compound", "p_district", kind.alias("kind"), sure.alias("confidence"), F.when(is_c, _clean("compound")).alias("compound"), _clean("developer").alias("developer"), F.when(is_c, _clean("reference")).alias("target"))
    of = lambda name, on: reference.select(F.col("compound").alias(on), F.lit(True).alias(f"{name}_listed"), F.col("developer").alias(f"{name}_dev"), F.col("area").alias(f"{name}_area"))
    a = a.join(of("t", "target"), "target", "left").join(of("own", "p_compound"), "p_compound", "left").join(of("up", "compound"), "compound", "left")
    note1 = F.when(F.col("target").isNotNull() & F.col("t_listed").isNull(), "reference_not_listed")
    note2 = F.when(F.col("t_listed") & (F.col("confidence") != "high"), "reference_not_certain")
    kept = F.coalesce(F.col("t_listed"), F.lit(False)) & (F.col("confidence") == "high")
    differs = kept & F.col("t_dev").isNotNull() & (T.developer_key(F.col("t_dev")) != T.developer_key(F.col("developer")))
    note3 = F.when(F.coalesce(differs, F.lit(False)), "reference_developer_differs")
    target_ok = kept & note3.isNull()
    nameless = (F.col("kind") == "compound") & F.col("compound").isNull()
    area = (F.col("p_compound") != F.col("compound")) & F.col("own_listed") & F.col("up_listed") & (F.col("p_district") == F.col("own_area")) & (F.col("own_area") != F.col("up_area"))
    area = F.coalesce(area, F.lit(False))
    notes = F.array_compact(F.array(note1, note2, note3, F.when(nameless, "compound_missing"), F.when(area, "parent_area_differs")))
    return a.select(
        "key", "kind", F.when(area, F.col("p_compound")).otherwise(F.col("compound")).alias("compound"), F.when(target_ok, F.coalesce("t_dev", "developer")).otherwise(F.col("developer")).alias("developer"),
        F.when(target_ok, F.col("target")).alias("reference"), F.when(F.coalesce(nameless, F.lit(False)), "low").otherwise(F.col("confidence")).alias("confidence"), notes.alias("notes"),
    )
