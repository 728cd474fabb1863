"""Versioned publication: documents in parts, activation behind counts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.places import numbered
from ..plans.storage import saver

PART, KEEP = 8000, 3


def parts(documents: DataFrame, size: int = PART) -> DataFrame:
    """Documents (kind, key, text) as parts of at most size characters; an empty one has one part."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size).cast("int"))
    p = documents.select("kind", "key", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return p.select("kind", "key", "part", F.substring(F.col("text"), F.col("part") * size + 1, F.lit(size)).alias("text"))


def assembled(p: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("part", "text")))
    return p.groupBy("kind", "key").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))


def activation(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether each version may go live: every table must hold what its manifest says.

    manifest and counts: version, table, n.
    """
    j = manifest.select("version", "table", F.col("n").alias("expected")).join(counts.select("version", "table", F.col("n").alias("found")), ["version", "table"], "left")
    return j.groupBy("version").agg(F.bool_and(F.col("expected") == F.coalesce("found", F.lit(0))).alias("ready"), F.sum(F.coalesce("found", F.lit(0))).cast("long").alias("rows"))


def kept_versions(datasets: DataFrame, active: str | None, keep: int = KEEP) -> DataFrame:
    """The latest versions and the active one."""
    if keep < 2:
        raise ValueError("at least two versions must stay")
    w = Window.orderBy(F.desc("generated_at"), F.desc("version"))  # a row for each version
    return datasets.withColumn("_place", F.row_number().over(w)).where((F.col("_place") <= keep) | F.col("version").eqNullSafe(F.lit(active))).drop("_place")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, path: str, version: str, names: list[str]) -> DataFrame:
    """version, table, n of what was written: counted from the files, not from a plan run twice."""
    out = None
    for name in names:
        n = spark.read.parquet(f"{path}/version={version}/{name}").agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(version).alias("version"), F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def publish(frames: dict[str, DataFrame], path: str, version: str) -> DataFrame:
    """Writes each frame below its version with the rows that its tasks counted, checks the files against that, and only then points readers to it.

    The pointer is a new file of its own, written aside and renamed: readers find the old
    version or the new one, never none. Returns the manifest.
    """
    spark = next(iter(frames.values())).sparkSession
    expected = []
    for name, df in frames.items():
        seen = Observation(f"rows-{name}-{version}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
        expected.append((version, name, seen.get["n"]))
    wanted = spark.createDataFrame(expected, "version string, table string, n long")
    found = manifest(spark, path, version, list(frames))
    if not activation(wanted, found).first()["ready"]:
        raise RuntimeError(f"{version} is incomplete; the active version stays")
    wanted.write.mode("overwrite").parquet(f"{path}/version={version}/_manifest")
    activate(spark, path, version)
    return wanted


def activate(spark: SparkSession, path: str, version: str) -> None:
    """Moves the pointer to a version that is there, forward or back."""
    fs, aside = _files(spark, f"{path}/pointers/.{version}")
    numbers = [int(f.getPath().getName().split("-")[0]) for f in fs.listStatus(aside.getParent())] if fs.exists(aside.getParent()) else []
    out = fs.create(aside, True)
    out.close()
    if not fs.rename(aside, _files(spark, f"{path}/pointers/{max(numbers, default=0) + 1:012d}-{version}")[1]):
        raise RuntimeError("the pointer did not move")


def active_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers see."""
    fs, at = _files(spark, f"{path}/pointers")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if not f.getPath().getName().startswith(".")) if fs.exists(at) else []
    return names[-1].split("-", 1)[1] if names else None


def read_active(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the active version; what was read stays of one version, whatever is published meanwhile."""
    version = active_version(spark, path)
    if version is None:
        raise ValueError("nothing was published yet")
    return spark.read.parquet(f"{path}/version={version}/{name}")


def documents(entities: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """kind, key and the JSON text of each row of some tables (kind → table and its key column)."""
    out = None
    for kind, (df, key) in entities.items():
        row = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("text"))
        out = row if out is None else out.unionByName(row)
    return out


def search_rows(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """The narrow table that a serving store searches: flags, keys, the text that terms are looked up in, figures to sort by."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "district", "compound_name", "developer_name", "compound", "developer"))))
    r = records.join(ranks, "id", "left")
    return r.select(
        "id", F.coalesce("is_resale", F.lit(False)).alias("listed"), T.slug(F.col("district")).alias("district_key"), "compound_key", "developer_key", "property_type", "level", "terms", "source", text.alias("search"),
        "price", "area_m2", "rank", "launch_gap", "launch_same_finishing", "peer_gap", F.when(F.col("cash_equivalent") != 0, F.col("cash_equivalent") / F.col("area_m2")).alias("cash_ppm"), T.url_key(F.col("source_url")).alias("url_key"),
    )


def staging(rows: DataFrame, size: str, order: list[str], most_bytes: int = 300_000, most_rows: int = 40) -> DataFrame:
    """rows with the batch they are sent in: consecutive rows of a stretch, of most_rows and most_bytes at most.

    A batch closes where the next row would not fit, row by row, which is a fold; stretches
    of 1,000 rows are folded on their own, so that no task holds a whole table; place (from 0) stays. A row
    larger than a batch is an error.
    """
    placed = numbered(rows, order, saver(rows.sparkSession), "staging")
    g = placed.groupBy(F.floor(F.col("place") / 1000).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("place", F.col(size).cast("long").alias("bytes")))).alias("rows"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("long").alias("bytes"), F.lit(most_rows).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a, r):
        new = (a["n"] >= most_rows) | (a["bytes"] + r["bytes"] > most_bytes)
        batch = a["batch"] + new.cast("int")
        return F.struct(batch.alias("batch"), (F.when(new, F.lit(0).cast("long")).otherwise(a["bytes"]) + r["bytes"] + 1).alias("bytes"), (F.when(new, 0).otherwise(a["n"]) + 1).alias("n"), F.concat(a["out"], F.array(batch)).alias("out"))

    folded = g.select("rows", "stretch", F.aggregate("rows", start, step)["out"].alias("batches"))
    each = folded.select("stretch", F.explode(F.arrays_zip("rows", "batches")).alias("x")).select(F.col("x.rows.place").alias("place"), F.struct("stretch", F.col("x.batches").alias("n")).alias("batch"))
    out = placed.join(each, "place")
    return out.withColumn("batch", F.when(F.col(size) <= most_bytes, F.col("batch")).otherwise(F.raise_error(F.lit("a row is larger than a batch"))))


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, or an error where it has more rows than a reader can take: never a silent cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def fingerprint(df: DataFrame) -> DataFrame:
    """n and a digest of a table's rows in any order: sums of two unrelated 64-bit hashes of each row, so that repeated rows count as often as they occur."""
    h = [F.xxhash64(*(c for c in df.columns)), F.xxhash64(F.lit("second"), *(c for c in df.columns))]
    sums = [F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for x in h]
    return df.agg(F.count(F.lit(1)).alias("n"), *(x.alias(f"s{k}") for k, x in enumerate(sums))).select("n", F.sha2(F.concat_ws(":", "n", "s0", "s1"), 256).alias("digest"))
