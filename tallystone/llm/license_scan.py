"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

A document's shingles that any template has come from one scan, by a lookup in the
templates' shingles; bands of the shingles in a window pick templates, and the share of
a template's shingles that the window holds decides.

DataFrame functions only, and none that runs lambdas over words: five neighbouring words
are zipped from shifted slices of a document's word array and hashed by generated code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, id_key, only, saved, shared_dir

SHINGLE, CONTAINMENT = 5, 0.8
#: One-row bands: at containment s a template is retrieved with chance 1 - (1 - s) ** BANDS.
BANDS = 32
#: Window lengths in shingles are FIRST, then each GROWTH times the one before; a template goes to the
#: first whose half holds it, and windows start each half.
FIRST, GROWTH = 32, 4
#: Template shingles up to this number are broadcast; more are joined by hash.
BROADCAST_SHINGLES = 200_000

#: Texts of notices (fixed values).
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
    ),
)


@dataclass(frozen=True)
class Settings:
    containment: float = CONTAINMENT
    bands: int = BANDS
    broadcast_shingles: int = BROADCAST_SHINGLES


def shingle_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, h: the hash of each five-word shingle and where it starts. Words are letters and digits in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    w = texts.select(*keys, words.alias("w")).where(F.size("w") >= SHINGLE)
    n = F.size("w") - (SHINGLE - 1)
    zipped = F.arrays_zip(*(F.slice("w", k + 1, n).alias(f"w{k}") for k in range(SHINGLE)))
    rows = w.select(*keys, F.posexplode(zipped).alias("pos", "s"))
    return rows.select(*keys, "pos", F.xxhash64(*(F.col(f"s.w{k}") for k in range(SHINGLE))).alias("h"))


def _bands(h: str, n: int):
    return [F.min(F.xxhash64(F.col(h), F.lit(k))).alias(f"b{k}") for k in range(n)]


def scan(docs: DataFrame, templates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, license_id, containment, first_word for each document and template that it contains.

    docs has doc_id and text, templates license_id and text. containment is the largest
    share of a template's distinct shingles that one window of a document holds;
    first_word is where the first of them starts in the first such window. Windows overlap
    by half, and a template fits into a half, so every whole occurrence lies in a window.
    MinHash values for a template are taken over those shingles of a window that it has
    itself, so that their similarity is the containment and a window at the threshold is
    missed with a chance of (1 - containment) ** bands (4e-23). Texts and
    templates of fewer than five words have no shingles and match nothing, as do nulls.
    Templates may be of any length: windows grow with them. A null doc_id is one more
    document; repeated rows of a document count once; empty tables give an empty result;
    other columns are ignored, whatever their names.
    """
    s, work = settings, shared_dir(docs.sparkSession)
    t = shingle_rows(only(templates, "license_id", "text").where("license_id IS NOT NULL"), ["license_id"])
    t = saved(t, f"{work}/shingles")
    length = F.lit(FIRST) * F.pow(F.lit(GROWTH), F.greatest(F.lit(0.0), F.ceil(F.log(float(GROWTH), (F.max("pos") + 1) / (FIRST / 2)))))
    sizes = t.groupBy("license_id").agg(F.count_distinct("h").cast("int").alias("size"), length.cast("int").alias("length"))
    t = saved(t.select("license_id", "h").distinct().join(sizes, "license_id"), f"{work}/templates")
    small = t.limit(s.broadcast_shingles + 1).count() <= s.broadcast_shingles
    hint = F.broadcast if small else (lambda df: df.hint("merge"))
    rows = shingle_rows(only(docs, "doc_id", "text").select(id_key().alias("doc_id"), "text"), ["doc_id"])
    rows = saved(rows.join(hint(t), "h").select("doc_id", "license_id", "size", "length", "h", "pos"), f"{work}/hits")
    # A shingle lies in the window that starts at its half-step and in the one before.
    step = F.floor(F.col("pos") / (F.col("length") / 2)).cast("int")
    rows = rows.select("doc_id", "license_id", "size", "h", "pos", F.explode(F.array(step, step - 1)).alias("window"))
    held = rows.groupBy("doc_id", "license_id", "window", "h").agg(F.min("pos").alias("pos"), F.first("size").alias("size"))
    # A window's bands for a template are of the template's own shingles in it, whatever else stands there.
    marks = held.groupBy("doc_id", "license_id", "window").agg(*_bands("h", s.bands), (F.count(F.lit(1)) / F.first("size")).alias("containment"), F.min("pos").alias("pos"))
    wanted = t.groupBy("license_id").agg(*_bands("h", s.bands)).select("license_id", *(F.col(f"b{k}").alias(f"t{k}") for k in range(s.bands)))
    same = reduce(or_, (F.col(f"b{k}") == F.col(f"t{k}") for k in range(s.bands)))
    # Exact: how many of the template's shingles the window holds.
    held = marks.join(hint(wanted), "license_id").where(same & (F.col("containment") >= s.containment))
    best = held.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", (-F.col("pos")).alias("neg"))).alias("best"))
    return best.select(id_back(F.col("doc_id")).alias("doc_id"), "license_id", F.col("best.containment").alias("containment"), (-F.col("best.neg")).cast("long").alias("first_word"))


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in TEMPLATES], "license_id string, text string")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), templates_table(spark))


_TEXTS = ",\n".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SQL = {
    "op2_license_scan": rf"""
WITH tt(license_id, text) AS (VALUES {_TEXTS}),
tw AS (SELECT license_id, {_WORDS} AS w FROM tt),
tp AS (SELECT license_id, w, unnest(range(0, len(w) - 4)) AS pos FROM tw),
ta AS (SELECT license_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM tp),
tz AS (SELECT license_id, count(DISTINCT s) AS size,
              CAST(32 * pow(4, greatest(0, ceil(log2((max(pos) + 1) / 16.0) / 2))) AS INTEGER) AS length FROM ta GROUP BY license_id),
t AS (SELECT DISTINCT ta.license_id, ta.s, tz.size, tz.length FROM ta JOIN tz ON tz.license_id = ta.license_id),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS pos FROM dw WHERE len(w) >= 5),
d AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM dp),
m AS (SELECT d.doc_id, d.pos, t.license_id, t.s, t.size, CAST(floor(d.pos * 2.0 / t.length) AS BIGINT) AS k FROM d JOIN t ON t.s = d.s),
x AS (SELECT doc_id, pos, license_id, s, size, k AS wnd FROM m UNION ALL SELECT doc_id, pos, license_id, s, size, k - 1 FROM m),
c AS (SELECT doc_id, license_id, wnd, count(DISTINCT s) / CAST(max(size) AS DOUBLE) AS containment, min(pos) AS pos FROM x GROUP BY doc_id, license_id, wnd),
r AS (SELECT doc_id, license_id, containment, pos, row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, pos) AS n FROM c WHERE containment >= 0.8)
SELECT doc_id, license_id, containment, CAST(pos AS BIGINT) AS first_word FROM r WHERE n = 1"""
}
