"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a class for regular expressions.
BLANK = r"[\x20\x09-\x0D]"
#: Stands for a null identifier inside an operator, so that it can be a join key.
NO_ID = -(2**63)
#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 8 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables, below spark.checkpoint.dir.

    Where that setting is absent (local tests) a temporary folder takes its place; on a
    cluster its absence is an error. The folder goes when the application ends.
    """
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="tallystone-")
        root = f"file://{_own_dir}"
    path = f"{root}/tallystone/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to shared storage and reads it back: the lineage ends there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the bytes of an Arrow batch where the session has Spark's own bound.

    A batch is held by the JVM and by the Python worker at once; texts make it large.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "67108864", "64MB", "64m"):
        conf.set(key, str(BATCH_BYTES))
    return df


def placed(df: DataFrame) -> DataFrame:
    """df with columns named c0, c1, … by their places, so that no name of its own can clash."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """Under which name placed(df) has a column: the first of just this name, else of this name in another case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for k, c in enumerate(df.columns):
            if same(c):
                return f"c{k}"
    raise ValueError(f"no column {name}")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else df has."""
    return placed(df).select(*(F.col(place(df, n)).alias(n) for n in names))


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(c: Column) -> Column:
    return F.when(c != F.lit(NO_ID), c)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters outside BLANK, as UTF-8. bytes.split() cuts at exactly those six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word (SipHash under a fixed key, the same on every machine)."""
    if not words:
        return np.zeros(0, np.uint64)
    col = np.empty(len(words), object)
    col[:] = words
    return pd.util.hash_array(col, categorize=False)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(h: np.ndarray, k: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the k words from each position on; len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    f = np.uint64(factor)
    for j in range(k):
        out *= f
        out += h[j : j + n]
    return mix(out)


def shingles(words: list[bytes], k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles. One to k-1 words make one shingle, no word none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)
    return np.unique(gram_hashes(h, min(k, len(h))))
