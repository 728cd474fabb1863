"""Checkpoints of a table that write only what differs from the one before, and prove what they give back.

Rows lie in ranges of a hash of their key. Each range has a digest that does not depend on
the order of its rows, in which a row counts as often as it occurs; digests of ranges are
joined pairwise up to one root. Two versions with equal roots hold the same rows; otherwise
the tree leads to the ranges that differ, and only those are written.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publish
from .storage import saver

RANGES = 256


class Damaged(RuntimeError):
    """A range does not hold the rows that were written."""


@dataclass(frozen=True)
class Saved:
    version: str
    root: str
    written: tuple[int, ...]
    compared: int


def _row_hashes(columns: list[str]) -> list[Column]:
    # Nulls pass by a hash of Spark's; a struct's JSON does not, and tells "" from null.
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _range(key: list[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(ranges)).cast("int")


def digests(df: DataFrame, key: list[str], ranges: int) -> dict[int, tuple[int, str]]:
    """Rows and digest of each range that has rows: one aggregation, `ranges` rows at most."""
    h = _row_hashes(sorted(df.columns))
    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    rows = df.groupBy(_range(key, ranges).alias("r")).agg(F.count(F.lit(1)).alias("n"), total(h[0]).alias("a"), total(h[1]).alias("b")).collect()
    return {r.r: (r.n, hashlib.sha256(f"{r.n}:{r.a}:{r.b}".encode()).hexdigest()) for r in rows}


def tree(leaves: dict[int, tuple[int, str]], ranges: int) -> list[list[str]]:
    """Levels of the tree, leaves first; a range without rows has an empty digest."""
    level = [leaves[k][1] if k in leaves else "" for k in range(ranges)]
    out = [level]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 2]).encode()).hexdigest() for k in range(0, len(level), 2)]
        out.append(level)
    return out


def differing(a: list[list[str]], b: list[list[str]]) -> tuple[list[int], int]:
    """The leaves in which two trees differ, from the root down, and how many nodes were compared."""
    if len(a) != len(b):
        raise ValueError("trees of unlike height")
    found, seen = [0], 0
    for k in reversed(range(len(a))):
        seen += len(found)
        found = [n for n in found if a[k][n] != b[k][n]]
        if k:
            found = [m for n in found for m in (2 * n, 2 * n + 1) if m < len(a[k - 1])]
    return found, seen


def _manifest(spark: SparkSession, path: str, version: str) -> tuple[dict, dict[int, tuple[int, str, int]]]:
    head = spark.read.parquet(f"{path}/version={version}/head").first().asDict()
    parts = spark.read.parquet(f"{path}/version={version}/ranges").collect()  # `ranges` rows at most
    return head, {r.range: (r.n, r.digest, r.epoch) for r in parts}


def save(df: DataFrame, path: str, key: list[str], ranges: int = RANGES) -> Saved:
    """A new version of the table below path; ranges that hold what they held are pointed to.

    Where the key, the number of ranges or the columns differ from the version before,
    all is written. The frame is saved first, so that what is hashed is what is written.
    """
    spark = df.sparkSession
    if ranges < 1:
        raise ValueError("at least one range is needed")
    df = saver(spark)(df, "rows")
    leaves, shape = digests(df, key, ranges), f"{','.join(key)}|{ranges}|{df.schema.simpleString()}"
    nodes = tree(leaves, ranges)
    active = publish.active_version(spark, path)
    n, old = 0, {}
    if active is not None:
        n = int(active[1:]) + 1
        head, parts = _manifest(spark, path, active)
        old = parts if head["shape"] == shape else {}
    changed, compared = differing(nodes, tree({k: (c, d) for k, (c, d, _) in old.items()}, ranges)) if old else (list(range(ranges)), 0)
    write = [k for k in changed if k in leaves]
    if write:
        rows = df.withColumn("range", _range(key, ranges)).where(F.col("range").isin(*write))
        rows.repartition("range").write.mode("overwrite").partitionBy("range").parquet(f"{path}/data/epoch={n}")
    epochs = {k: n if k in changed else old[k][2] for k in leaves}
    listed = [(k, c, d, epochs[k]) for k, (c, d) in sorted(leaves.items())]
    spark.createDataFrame(listed, "range int, n long, digest string, epoch int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version=v{n}/ranges")
    head = (nodes[-1][0], shape, ",".join(key), ranges, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))
    spark.createDataFrame([head], "root string, shape string, key string, ranges int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version=v{n}/head")
    publish.activate(spark, path, f"v{n}")
    return Saved(f"v{n}", nodes[-1][0], tuple(write), compared)


def restore(spark: SparkSession, path: str, version: str | None = None, verify: bool = True) -> DataFrame:
    """The table of a version (the active one). Each range is proved against its digest first; the error names those that fail."""
    version = version or publish.active_version(spark, path)
    if version is None:
        raise ValueError("nothing was saved yet")
    head, parts = _manifest(spark, path, version)
    places = {k: f"{path}/data/epoch={e}/range={k}" for k, (_, _, e) in sorted(parts.items())}
    reader = spark.read.schema(head["schema"])
    if not places:
        return spark.createDataFrame([], head["schema"])
    fs = spark._jvm.org.apache.hadoop.fs
    there = {k: p for k, p in places.items() if fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs.Path(p))}
    wrong = sorted(set(places) - set(there))
    if verify and not wrong:
        try:
            found = digests(reader.parquet(*there.values()), head["key"].split(","), head["ranges"])
            wrong = [k for k, (c, d, _) in sorted(parts.items()) if found.get(k) != (c, d)]
        except Exception:  # noqa: BLE001  a file that cannot be read at all: find out whose it is
            wrong = [k for k, p in there.items() if not _readable(reader, p, head, parts[k])]
    if wrong:
        raise Damaged(f"{version}: " + ", ".join(places[k] for k in wrong))
    return reader.parquet(*there.values())


def _readable(reader, place: str, head: dict, part: tuple[int, str, int]) -> bool:
    try:
        return list(digests(reader.parquet(place), head["key"].split(","), head["ranges"]).values()) == [part[:2]]
    except Exception:  # noqa: BLE001
        return False


def compact(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes what none of the last versions points to; the epochs that went."""
    active = publish.active_version(spark, path)
    if active is None:
        return []
    kept = range(max(0, int(active[1:]) - keep + 1), int(active[1:]) + 1)
    needed = {e for v in kept for _, _, e in _manifest(spark, path, f"v{v}")[1].values()}
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.Path(f"{path}/data")
    fs, gone = at.getFileSystem(conf), []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        epoch = int(s.getPath().getName().split("=")[1])
        if epoch not in needed and epoch <= int(active[1:]):
            fs.delete(s.getPath(), True)
            gone.append(epoch)
    return sorted(gone)
