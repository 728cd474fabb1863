"""Columns that clash, empty tables, the classifier in plain form, and the pipeline against a plain one."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallystone.llm import byte_bpe, exact_dedup, image_copies, jaccard_join, lm_scoring, packing, quality, substring_dedup, url_filter
from tallystone.llm.common import words_of

SF = "/root/testdata/sf0.001"
SOME = [(1, "one two three four five six"), (2, "one two three four five seven"), (None, None), (3, ""), (3, ""), (4, "x " * 500)]


@pytest.fixture(scope="module")
def clashing(spark):
    """doc_id and text among columns of the same names in another case, and other extra ones."""
    return spark.createDataFrame([(t, "no", i, None if i is None else -i, "en", 7) for i, t in SOME], "text string, TEXT string, doc_id long, DOC_ID long, lang string, N_CHARS int")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


def test_columns_that_clash(spark, clashing, marks):
    ids = sorted(map(str, (i for i, _ in SOME)))
    for op in (byte_bpe.encode, lambda d: byte_bpe.encode_native(d, memo_slots=16), lambda d: quality.quality(d, marks), lm_scoring.lm_scores, exact_dedup.exact_dedup, jaccard_join.jaccard_join, substring_dedup.substring_dedup):
        assert sorted(str(r.doc_id) for r in op(clashing).collect()) == ids
    assert {str(r.doc_id) for r in packing.pack(clashing).collect()} == set(ids)
    for op in (exact_dedup.without_copies, jaccard_join.one_of_each_class, substring_dedup.without_repeats, lambda d: quality.good_documents(d, marks, threshold=0.0)):
        assert op(clashing).columns == clashing.columns
    pictures = spark.createDataFrame([(1, bytearray(range(256)) * 4, 32, b"x", 2), (2, bytearray(range(256)) * 4, 32, b"y", 3), (3, None, 4, b"", 1)], "media_id long, pixels binary, width int, Pixels binary, Media_Id int")
    assert {r.media_id: (r.class_id, r.n_links) for r in image_copies.image_copies(pictures).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    captures = spark.createDataFrame([(1, "https://a.example.com/x", None, "no", 5)], "id long, url string, fetch_time timestamp, URL string, Id int")
    entries = spark.createDataFrame([("ads", "domain", "a.example.com", "add", "2024-01-01", "z")], "list string, kind string, value string, action string, at string, LIST string")
    assert url_filter.filter_urls(captures, entries).count() == 1


def test_empty_tables(empty, marks):
    for op in (exact_dedup.without_copies, jaccard_join.one_of_each_class, substring_dedup.without_repeats, lambda d: quality.good_documents(d, marks)):
        out = op(empty)
        assert out.columns == empty.columns and out.count() == 0
    for op in (exact_dedup.exact_dedup, jaccard_join.jaccard_join, substring_dedup.substring_dedup, packing.pack, lm_scoring.lm_scores, byte_bpe.encode):
        assert op(empty).count() == 0


# ---- the classifier ------------------------------------------------------------------------------


def plain_score(m, text, declared):
    """The sum over all pairs, one document at a time."""
    bucket, value, stats = quality.features(text, declared)
    col = np.concatenate([bucket, np.arange(quality.BUCKETS, quality.BUCKETS + len(stats))])
    x = np.concatenate([value, np.clip((stats - m.mean) * m.scale, -6, 6)]).astype(np.float64)
    v = m.v[col].astype(np.float64) * x[:, None]
    gram = v @ v.T
    z = m.bias + float(m.w[col].astype(np.float64) @ x) + float(np.triu(gram, 1).sum())
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_gradient_of_the_machine():
    rng = np.random.default_rng(3)
    texts = ["good plain words about things", "BAD!!! ### bad", "other words, and more words", "### !!! $$$"]
    parts, label, weight = [quality.features(t, len(t)) for t in texts], np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    n = quality.BUCKETS + len(quality.STATISTICS)
    m = quality.Machine(0.1, rng.normal(0, 0.1, n), rng.normal(0, 0.1, (n, 3)), np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))

    def loss():
        p = np.array([plain_score(m, t, len(t)) for t in texts])
        return float((weight * -(label * np.log(p) + (1 - label) * np.log(1 - p))).mean())

    g, gw, gv = m.gradients(parts, label, weight)
    step = 1e-5
    m.bias += step
    up = loss()
    m.bias -= 2 * step
    down = loss()
    m.bias += step
    assert g[0] == pytest.approx((up - down) / (2 * step), rel=2e-3)
    used = np.unique(np.concatenate([p[0] for p in parts] + [np.arange(quality.BUCKETS, n)]))
    for k in rng.choice(used, 12, replace=False):
        for table, grad, at in ((m.w, gw, k), (m.v, gv, (k, 1))):
            table[at] += step
            up = loss()
            table[at] -= 2 * step
            down = loss()
            table[at] += step
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=5e-3, abs=2e-5)


def test_scores_are_those_of_the_plain_form(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for r in docs.collect():
        want = plain_score(machine, r.text, r.n_chars)
        assert got[r.doc_id].score == pytest.approx(want, abs=2e-4)
        assert abs(want - quality.THRESHOLD) < 1e-3 or got[r.doc_id].predicted == int(want >= quality.THRESHOLD)


# ---- the pipeline --------------------------------------------------------------------------------


def grams(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_pipeline(rows, machine):
    """rows: (doc_id, text, n_chars). The ids and texts that reach the packing, in no order."""
    least = lambda i: (i is not None, i or 0)
    kept = [r for r in rows if plain_score(machine, r[1], r[2]) >= quality.THRESHOLD]
    best = {}
    for r in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        rank = (-len(r[1] or ""), least(r[0]))
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    kept = [r for _, r in best.values()]
    sets, root = [grams(r[1]) for r in kept], list(range(len(kept)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                root[top(a)] = top(b)
    classes = {}
    for k, r in enumerate(kept):
        key = top(k) if sets[k] else ("blank", k)
        if key not in classes or least(r[0]) < least(classes[key][0]):
            classes[key] = r
    seen, out = set(), []
    for i, t, _ in sorted(classes.values(), key=lambda r: least(r[0])):
        w = words_of(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        if left or not w:
            out.append((i, b" ".join(left).decode() if any(gone) else t))
    return out


def test_pipeline_is_the_plain_one(spark, tmp_path):
    from tokenizers import Tokenizer

    own = spark.read.parquet(f"{SF}/documents.parquet")
    long = max((r for r in own.collect()), key=lambda r: len(r.text or ""))
    words = long.text.split()
    edited = " ".join(words[:40] + ["changed"] + words[41:])
    extra = [(9001, edited, "en", "s", len(edited)), (None, long.text.replace(" ", "  "), "en", "s", len(long.text)), (9002, " ".join(words[5:60]), "en", "s", 300), (9003, "", "en", "s", 0), (9004, None, None, None, None)]
    docs = own.unionByName(spark.createDataFrame(extra, own.schema)).unionByName(own.where("doc_id < 5"))
    sf = f"{tmp_path}/sf"
    docs.repartition(4).write.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.train(docs, labels)
    rows = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    want = plain_pipeline(rows, machine)
    got = corpus_pipeline.run(spark, sf).collect()
    model = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokens = Counter()
    for i, t in want:
        tokens[i] += len(model.encode(t or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in got:
        packed[r.doc_id] += r.length
    assert packed == tokens and len(want) < len(rows) - 5
    # A score nearer than rounding to the threshold could fall either way in the two forms.
    assert all(abs(plain_score(machine, t, n) - quality.THRESHOLD) > 1e-6 for _, t, n in rows)


def test_pipeline_of_nothing(spark, empty, tmp_path):
    sf = f"{tmp_path}/sf"
    empty.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    blank = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], empty.schema)
    blank.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).where(F.col("doc_tokens") != 1).count() == 0
