"""The whole analysis as one lazy graph of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..operators import clean, compare, entities, rollup
from . import adapter
from .serving import Served
from .storage import saver


#: Sources whose latest observations are broadcast.
SOURCES = 10_000


@dataclass
class Snapshot:
    """Every table follows from raw listings; none is computed before it is asked for.

    save writes a table to shared storage and reads it back. Tables that many others read
    are saved: each is computed once, its lineage ends there, and plans stay small.
    """

    raw: DataFrame
    today: Column
    roles: clean.Roles = clean.Roles()
    aliases: DataFrame | None = None
    hidden: DataFrame | None = None
    save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df

    @cached_property
    def projected(self) -> DataFrame:
        rows = clean.eligible(self.raw, self.roles)
        latest = self.save(self.raw.groupBy("source").agg(F.max("last_seen_at").alias("source_latest")), "latest")
        # A row for each source: broadcast as long as it stays within a bound, joined by key otherwise.
        small = latest.limit(SOURCES + 1).count() <= SOURCES
        rows = clean.confirmed(rows.join(F.broadcast(latest) if small else latest, "source", "left")).drop("source_latest")
        return self.save(clean.without_hidden(rows, self.hidden) if self.hidden is not None else rows, "projected")

    @cached_property
    def launches(self) -> DataFrame:
        return self.projected.where(F.col("source").isin(*self.roles.primary))

    @cached_property
    def _applied(self):
        own = self.projected.where(~F.col("source").isin(*self.roles.primary))
        return entities.apply_aliases(own, self.aliases) if self.aliases is not None else (own, None)

    @cached_property
    def resolved(self) -> DataFrame:
        r = entities.resolve(self._applied[0], self.save)
        d = M.delivery(F.col("delivery_date"), F.col("delivery_status"), self.today)
        r = r.withColumn("d", d).withColumns({"delivery_bucket": F.col("d.bucket"), "delivery_years": F.col("d.years")}).drop("d")
        return self.save(r.withColumn("unknowns", clean.unknowns()), "resolved")

    @cached_property
    def default(self) -> DataFrame:
        return self.resolved.where("is_resale")

    @cached_property
    def compound_index(self) -> DataFrame:
        return self.default.where("compound_key <> ''").groupBy(F.col("compound_key").alias("key")).agg(F.max_by("developer_key", "id").alias("developer_key"))

    @cached_property
    def named(self) -> DataFrame:
        """key, name, developer_key and position (units) of each compound with resale units, as evaluations look them up: no comparison is needed."""
        own = self.default.where("compound_key <> ''").groupBy(F.col("compound_key").alias("key"))
        return own.agg(F.max("compound").alias("name"), F.max_by("developer_key", "id").alias("developer_key"), F.count(F.lit(1)).alias("position"))

    @cached_property
    def matched(self) -> DataFrame:
        return self.save(compare.match_launches(self.launches, self.compound_index, self._applied[1], self.aliases), "matched")

    @cached_property
    def signals(self) -> DataFrame:
        """Comparisons and level of each record, without what the record says itself."""
        return compare.signals(self.resolved, self.default, self.matched, self.today, self.save)

    @cached_property
    def records(self) -> DataFrame:
        return self.save(self.resolved.join(self.signals, "id", "left"), "records")

    @cached_property
    def resale(self) -> DataFrame:
        return self.records.where("is_resale")

    @cached_property
    def compounds(self) -> DataFrame:
        return self.save(rollup.compounds(self.resale, self.matched), "compounds")

    @cached_property
    def developers(self) -> DataFrame:
        return rollup.developers(self.resale, self.matched, self.compounds)

    @cached_property
    def districts(self) -> DataFrame:
        return rollup.districts(self.resale, self.compounds)


def of_driver_tables(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] | None = None) -> Snapshot:
    """The snapshot of these tables, or of some of its sources only: rows of others are not projected at all."""
    raw = adapter.listings(spark, sf_dir).select(*adapter.COLUMNS).unionByName(adapter.launches(spark, sf_dir))
    if sources is not None:
        raw = raw.where(F.col("source").isin(*sources))
    return Snapshot(raw, F.lit(adapter.LATEST).cast("date"), save=saver(spark))


#: Snapshots of an application, by folder: each served until a newer one is there.
_served: dict[tuple, Served[Snapshot]] = {}


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Length and time of every input, as the file system has them."""
    out = []
    for name in ("orders", "lineitem", "part", "supplier", "customer", "nation", "region"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        status = fs.getFileStatus(at)
        files = list(fs.listStatus(at)) if status.isDirectory() else [status]
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(out)


def cached(spark: SparkSession, sf_dir: str, seconds: float = 0) -> Snapshot:
    """The snapshot of these tables, built once for an application and as long as no input changes.

    With seconds, inputs are looked at that often, and a snapshot that they no longer fit
    is served while the next one is made.
    """
    key = (spark.sparkContext.applicationId, sf_dir, seconds)
    for old in [k for k in _served if k[0] != key[0]]:
        del _served[old]
    if key not in _served:
        _served[key] = Served(lambda: _warm(of_driver_tables(spark, sf_dir)) if seconds else of_driver_tables(spark, sf_dir), lambda: _signature(spark, sf_dir), seconds)
    return _served[key].get()


def _warm(s: Snapshot) -> Snapshot:
    """With the tables that most others read, so that no reader waits for them."""
    s.records, s.compounds  # noqa: B018
    return s
