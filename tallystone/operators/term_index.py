"""Search for terms by an index of trigrams: only rows that hold the rarest trigrams of a query are looked at.

A posting is a trigram and a row's id, without positions; postings lie in buckets of
trigrams, texts in buckets of ids. A query picks the rarest trigrams of its terms, meets
their postings, and proves the rows that are left by the texts themselves, so that the
result is that of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

GRAM, BUCKETS, PICKED = 3, 64, 3


@dataclass
class Read:
    """What a search read: rows of postings, rows of texts."""

    postings: int = 0
    texts: int = 0


def _bucket(c: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    n = F.length(text) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def build(rows: DataFrame, key: str, values: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Writes postings, their counts and the texts of all rows below path. A row's text is its values in lower case, as a scan joins them."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(v), F.lit("")) for v in values)))
    t = rows.select(F.col(key).alias("id"), text.alias("text"))
    t.withColumn("bucket", _bucket("id", buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")
    t = rows.sparkSession.read.parquet(f"{path}/texts").select("id", "text")
    p = t.select("id", F.explode(_grams(F.col("text"))).alias("gram")).withColumn("bucket", _bucket("gram", buckets))
    # A frequent trigram's bucket may be large: its rows are dealt to several tasks, sorted so that row groups of other trigrams are passed over.
    p.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counts = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, queries: list[str], buckets: int = BUCKETS, picked: int = PICKED, read: Read | None = None) -> DataFrame:
    """query (its place in the list) and id of every row that holds all terms of a query. An empty query holds for every row.

    Queries whose terms are all shorter than a trigram scan the texts, all of them at once.
    """
    terms = [T.search_terms(q) for q in queries]
    grams = [sorted({t[k : k + GRAM] for t in ts for k in range(len(t) - GRAM + 1)}) for ts in terms]
    texts = spark.read.parquet(f"{path}/texts")
    ids = texts.schema["id"].dataType.simpleString()
    indexed = [k for k, g in enumerate(grams) if g]
    scanned = [k for k, g in enumerate(grams) if not g]
    out = spark.createDataFrame([], f"query int, id {ids}")
    if indexed:
        wanted = sorted({g for k in indexed for g in grams[k]})
        counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(wanted)).collect()}  # trigrams of the queries
        # A trigram that no row has means that no row has its query.
        picks = [(k, g) for k in indexed if all(g in counts for g in grams[k]) for g in sorted(grams[k], key=lambda g: (counts[g], g))[:picked]]
        if picks:
            chosen = spark.createDataFrame(picks, "query int, gram string")
            touched = sorted({r.b for r in chosen.select(_bucket("gram", buckets).alias("b")).distinct().collect()})
            p = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(touched) & F.col("gram").isin(sorted({g for _, g in picks})))
            need = chosen.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
            hits = p.join(F.broadcast(chosen), "gram").groupBy("query", "id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(need), "query").where("n = need").select("query", "id")
            places = sorted(r.b for r in hits.select(_bucket("id", buckets).alias("b")).distinct().collect())  # `buckets` numbers at most
            some = texts.where(F.col("bucket").isin(places)).select("id", "text")
            if read is not None:
                read.postings, read.texts = p.count(), some.count()
            said = F.element_at(F.create_map(*(x for k in indexed for x in (F.lit(k), F.array(*map(F.lit, terms[k]))))), F.col("query"))
            out = out.union(hits.join(some, "id").where(F.forall(said, lambda t: F.contains(F.col("text"), t))).select("query", "id"))
    if scanned:
        cases = F.array(*(F.when(_all(terms[k]), F.lit(k)) for k in scanned))
        out = out.union(texts.select(F.explode(F.array_compact(cases)).alias("query"), "id"))
    return out


def _all(terms: list[str]) -> Column:
    found = F.lit(True)
    for t in terms:
        found = found & F.contains(F.col("text"), F.lit(t))
    return found
