"""Tokenizers, packing, quality, language model, licences, URL lists, images, the pipeline."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallystone.llm import byte_bpe, image_copies, license_scan, lm_scoring, packing, quality, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("form", [byte_bpe.encode, lambda d: byte_bpe.encode_native(d, memo_slots=64)])
def test_byte_bpe(docs, rows, empty, form):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = docs.where("doc_id IN (1, 2, 60, 140, 141, 142, 143) OR doc_id IS NULL")
    texts = {i: t or "" for i, t in rows}
    got = form(some.union(some.where("doc_id = 1").withColumn("text", F.lit("naïve 你好's  \n\t x<|endoftext|>٣")))).collect()
    for r in got:
        t = texts[r.doc_id]
        if r.doc_id == 1 and r.decoded_sha256 != hashlib.sha256(t.encode()).hexdigest():
            t = "naïve 你好's  \n\t x<|endoftext|>٣"
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 9 and form(empty).count() == 0


def token_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], np.uint32)


@pytest.mark.parametrize("length", [64, 4096])
def test_packing(docs, rows, empty, length):
    got = packing.pack(docs, length=length, plan_tokens=3000).toPandas()
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= length
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.offset == seq.groupby("sequence_id").length.cumsum() - seq.length).all()
    for i, t in rows:
        if i in (None, 147):
            continue
        ids, at = token_ids(t or ""), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(empty).count() == 0


def test_tokens_of_odd_texts():
    texts = ["It's İSTANBUL ΟΔΟΣ, naïve é  x y don't!!! a.,b 12½ <|endoftext|> ＡＢＣ", "", "...", "ÀÉ.×÷"]
    ids, counts = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY)).encode(texts)
    want = [token_ids(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_plan_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 8, 25))])
        cost = rng.integers(0, 5, len(cuts))
        pad = lambda d: 0 if d & (d - 1) == 0 else 16 - d
        best = [0] + [10**9] * 25
        for j in range(1, 26):
            best[j] = min(best[i] + pad(int(cuts[j] - cuts[i])) + int(cost[j]) + packing.SEQUENCE_COST for i in range(j) if cuts[j] - cuts[i] <= 16)
        ends = packing.plan(cuts, cost, 16)
        at = np.searchsorted(cuts, ends)
        assert sum(pad(b - a) for a, b in zip([0, *ends], ends, strict=False)) + int(cost[at].sum()) + packing.SEQUENCE_COST * len(ends) == best[-1]


def test_quality(spark, docs, empty):
    r = quality.op7_quality(spark, SF.replace("0.001", "0.01")).toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    assert (r.predicted == r.quality)[r.held_out].mean() > 0.95
    assert [h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(r.doc_id, r.held_out, strict=True)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs.drop("n_chars"), marks).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 for x in got)
    assert quality.quality(docs, marks.limit(0)).count() == docs.count() and quality.quality(empty, marks).count() == 0
    assert quality.good_documents(docs, marks, threshold=0.0).columns == docs.columns


def test_machine_identity():
    """The linear-time form is the sum over pairs."""
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=6).astype(np.float32), rng.normal(size=(6, 3)).astype(np.float32), np.zeros(0), np.zeros(0))
    x = rng.normal(size=6).astype(np.float32)
    z, _ = m.logits(np.zeros(6, int), np.arange(6), x, 1)
    pairs = sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i in range(6) for j in range(i))
    assert z[0] == pytest.approx(0.3 + float(m.w @ x) + pairs, rel=1e-4)


def test_language_model(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, rows = lm_scoring.fit(d, lm_scoring.shared_dir(spark))
    total = lambda t: (lambda r: r.log_prob.sum() / r.n_tokens.sum())(t.toPandas())
    trained = total(lm_scoring.score_rows(rows, model))
    untrained = lm_scoring.Model(model.words, lm_scoring.Network.start(), model.totals, model.counts)
    assert trained > total(lm_scoring.score_rows(rows, untrained)) + 1
    shuffled = d.withColumn("text", F.array_join(F.shuffle(F.split("text", " "), 3), " "))
    assert trained > total(lm_scoring.score(shuffled, model)) + 0.05
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    assert got[140].n_tokens == got[141].n_tokens == 0 and got[141].mean_log_prob is None and got[143].log_prob < 0
    assert lm_scoring.lm_scores(empty).count() == 0


def test_language_model_does_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 40_000)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = (lm_scoring.lm_scores(d.repartition(n)).toPandas().set_index("doc_id").mean_log_prob.sort_index() for n in (1, 16))
    assert len(one) == d.count() and (one - many).abs().max() < 1e-3


def test_score_is_the_pseudo_likelihood(spark):
    """Every token's probability given two on either side, worked out one by one."""
    texts = ["one two three two one zebra", "one two", "", "three three two one two Zulu"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, rows = lm_scoring.fit(d, lm_scoring.shared_dir(spark))
    keep = {w: s for w, s in model.words.items() if w not in (b"zebra", b"Zulu", b"one")}
    model = lm_scoring.Model(keep, model.network, lm_scoring.shape_totals(model.counts, keep), model.counts)
    count = {r.w: r.n for r in model.counts.collect()}
    net, want = model.network, {}
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    for i, t in enumerate(texts):
        w = t.split()
        s = [lm_scoring.SYMBOLS] * 2 + [keep.get(x.encode(), lm_scoring.shape_class(x.encode())) for x in w] + [lm_scoring.SYMBOLS] * 2
        want[i] = 0.0
        for k, x in enumerate(w):
            h = np.append(np.tanh(sum(net.embed[j][s[k + 2 + o]].astype(float) for j, o in enumerate(lm_scoring.OFFSETS))), 1)
            c, m = divmod(s[k + 2], lm_scoring.MEMBERS)
            p = soft(h @ net.top)[c] * soft(h @ net.low[c])[m]
            want[i] += np.log(p) if x.encode() in keep else np.log(p * count[x] / model.totals[s[k + 2]])
    got = {r.doc_id: r.log_prob for r in lm_scoring.score(d, model).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_rare_words_have_their_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORDS", 200)
    monkeypatch.setattr(lm_scoring, "vocabulary", lambda counts: {f"f{k}".encode(): k for k in range(200)})
    texts = [" ".join(f"f{k}" for k in range(250))] * 5 + ["f0 f1 zebra f2 f3"] * 4 + ["f0 f1 zqxwa f2 f3"]
    got = lm_scoring.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    s = {r.doc_id: r.log_prob for r in got}
    assert len(got) == 10 and s[5] == pytest.approx(s[8]) and s[5] - s[9] == pytest.approx(np.log(4), abs=1e-4)


def test_encoding_looks_up_each_word_once(monkeypatch):
    """Symbols and hashes of all occurrences, a hash worked out once a word; the memo ends at MEMO words and nothing changes."""
    import pyarrow as pa

    texts = ["one Zebra two Zebra one", None, "", "x Zebra ié two x ié", "y x one"] * 3
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["at", "doc_id", "h", "text"])
    hashed, hash_words = [], lm_scoring.hash_words
    monkeypatch.setattr(lm_scoring, "hash_words", lambda w: hashed.extend(w) or hash_words(w))
    known = {b"one": 70, b"two": 5}
    want = [[known[w] if w in known else lm_scoring.shape_class(w) for w in (t or "").encode().split()] for t in texts]
    rare = [hash_words([w for w in (t or "").encode().split() if w not in known]).view(np.int64).tolist() for t in texts]
    for memo in (500_000, 1):
        monkeypatch.setattr(lm_scoring, "MEMO", memo, raising=False)
        hashed.clear()
        got = list(lm_scoring._encode(known)([batch.slice(0, 7), batch.slice(7)]))
        assert [np.frombuffer(s, np.uint16).tolist() for b in got for s in b["symbols"].to_pylist()] == want
        assert [r for b in got for r in b["rare"].to_pylist()] == rare and [n for b in got for n in b["n_tokens"].to_pylist()] == [len(w) for w in want]
        assert len(hashed) == (4 if memo > 1 else 8)
    words = pa.array(["", "A", "zz", "ié", "\N{CYRILLIC SMALL LETTER A}", "Z" * 40, "9x"])[1:]
    assert lm_scoring.shape_classes(words).tolist() == [lm_scoring.shape_class(w.encode()) for w in words.to_pylist()]


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    target, context = rng.integers(0, lm_scoring.SYMBOLS, 200), rng.integers(0, lm_scoring.SYMBOLS + 1, (4, 200))
    net = lm_scoring.Network.start()
    net = lm_scoring.Network(*(p.astype(np.float64) for p in net.parts()))
    g_embed, g_top, g_low = net.gradient(target, context)
    loss = lambda: -net.log_probs(target, context).mean()

    def slope(array, at):
        array[at] += 1e-3
        up = loss()
        array[at] -= 2e-3
        down = loss()
        array[at] += 1e-3
        return (up - down) / 2e-3

    c = int(target[0]) // lm_scoring.MEMBERS
    symbol, rows = g_embed[2]
    for array, at, g in ((net.top, (3, c), g_top[3, c]), (net.low[c], (15, target[0] % lm_scoring.MEMBERS), g_low[c][15, target[0] % lm_scoring.MEMBERS]), (net.embed[2], (symbol[5], 7), rows[5, 7])):
        assert slope(array, at) == pytest.approx(g, rel=0.02, abs=2e-6)


def test_licences(spark, docs, empty):
    mit = dict(license_scan.TEMPLATES)["MIT"]
    rows = [(1, "x " * 50 + mit + " tail"), (2, " ".join(mit.split()[:40])), (3, "so: Licensed under CC BY-NC 4.0. ok"), (4, None), (5, ""), (6, "Licensed under"), (3, "so: Licensed under CC BY-NC 4.0. ok"), (7, (mit + " other words here ") * 400)]
    t = license_scan.templates_table(spark)
    got = {(r.doc_id, r.license_id): r.containment for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), t).collect()}
    assert got == {(1, "MIT"): 1.0, (3, "CC-BY-NC-4.0-notice"): 1.0, (7, "MIT"): 1.0}
    joined = {(r.doc_id, r.license_id): r.containment for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), t, license_scan.Settings(broadcast_shingles=0)).collect()}
    assert joined == got and license_scan.scan(empty, t).count() == 0


def test_long_licences(spark):
    """A template of 5,000 words, whole, cut to 85 %, and cut to half."""
    w = [f"w{k * 7919 % 50021}" for k in range(5000)]
    t = spark.createDataFrame([("long", " ".join(w)), (None, "a b c d e f"), ("short", "a b")], "license_id string, text string")
    rows = [(1, "x " * 700 + " ".join(w)), (2, " ".join(w[:4250])), (3, " ".join(w[:2500])), (None, " ".join(w))]
    d = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, h int")
    got = {r.doc_id: (r.containment, r.first_word) for r in license_scan.scan(d, t).collect()}
    assert set(got) == {1, 2, None} and got[1] == (1.0, 700) and got[None] == (1.0, 0) and 0.84 < got[2][0] < 0.87


def test_licences_side_by_side(spark):
    """Adjacent notices, in every order and at many offsets, against brute force."""
    notices = dict(license_scan.TEMPLATES[:4])
    orders = [o for n in (2, 3, 4) for o in itertools.permutations(notices, n)]
    rows, want = [], set()
    for at in range(0, 20, 2):
        for o in orders:
            rows.append((len(rows), " ".join(f"w{k}" for k in range(at)) + " " + " ".join(notices[x] for x in o)))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: [tuple(w[k : k + 5]) for w in [words(t)] for k in range(len(w) - 4)]
    for i, text in rows:
        g = grams(text)
        for name, notice in license_scan.TEMPLATES:
            t = grams(notice)
            length = next(n for n in (32, 128, 512) if len(t) <= n // 2)
            share = max(len(set(t) & set(g[max(k, 0) : k + length])) / len(set(t)) for k in range(-length // 2, len(g), length // 2))
            if share >= 0.8:
                want.add((i, name, share))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.templates_table(spark)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.license_id, r.containment) for r in got} == want


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("a", "domain", "Bad.com", "add", "2024-01-10"), ("a", "domain", "bad.com", "remove", "2024-02-01"), ("a", "domain", "bad.com", "add", "2024-03-01"), ("b", "host", "x.bad.com", "add", "2024-01-01"), ("c", "prefix", "ok.com/p", "add", "2024-01-01"), ("c", None, "z", "add", "2024-01-01"), ("d", "prefix", "Deep.com/Ads/x/", "add", "2024-01-01"), ("e", "prefix", "whole.com", "add", "2024-01-01")],
        "list string, kind string, value string, action string, at string",
    )
    c = [(1, "http://x.bad.com/q", "2024-01-05"), (2, "http://u:p@X.bad.com:80/q", "2024-01-10"), (3, "https://y.bad.com", "2024-02-15"), (4, "https://bad.com/", "2024-03-02"), (5, "https://notbad.com", "2024-03-02"), (6, "https://ok.com/p/1", "2024-03-02"), (7, None, "2024-03-02"), (8, "nonsense", "2024-03-02"), (9, "https://bad.com", None), (10, "https://deep.com//Ads/x/1?q=/y", "2024-03-02"), (11, "https://deep.com/ads/x/1", "2024-03-02"), (12, "https://deep.com/Ads/xy", "2024-03-02"), (13, "https://WHOLE.com/a/b", "2024-03-02"), (4, "https://bad.com/", "2024-03-02")]
    captures = spark.createDataFrame(c, "id long, url string, fetch_time string")
    for most in (100, 0):
        got = sorted((r.id, r.lists) for r in url_filter.filter_urls(captures, entries, most).collect())
        assert got == [(1, "b"), (2, "a,b"), (3, ""), (4, "a"), (4, "a"), (5, ""), (6, "c"), (7, ""), (8, ""), (9, ""), (10, "d"), (11, ""), (12, ""), (13, "e")]
    assert url_filter.filter_urls(captures, entries.limit(0)).where("blocked").isEmpty()


def test_images(spark):
    rng = np.random.default_rng(8)
    base = [np.kron(rng.integers(0, 255, (16, 16)), np.ones((4, 4))).astype(np.uint8) for _ in range(12)]
    crop = np.ascontiguousarray(base[0][5:, 3:-2])
    turned = np.ascontiguousarray(np.rot90(base[1]))
    bright = np.clip(base[2] * 0.8 + 30, 0, 255).astype(np.uint8)
    images = [(i, b.tobytes(), 64) for i, b in enumerate(base)] + [(20, crop.tobytes(), crop.shape[1]), (21, turned.tobytes(), 64), (22, bright.tobytes(), 64), (23, base[3].tobytes(), 64)]
    images += [(30, None, 64), (31, b"", 64), (32, b"abc", 2), (33, base[4].tobytes(), None), (None, b"\0" * 64, 8)]
    got = {r.media_id: r.class_id for r in image_copies.image_copies(spark.createDataFrame(images, "media_id long, pixels binary, width int")).collect()}
    assert (got[20], got[21], got[22], got[23]) == (0, 1, 2, 3)
    assert all(got[i] == i for i in [*range(12), 30, 31, 32, 33])
    assert image_copies.image_copies(spark.createDataFrame([], "media_id long, pixels binary, width int")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_images_meet_all_of_a_bucket(spark, monkeypatch, block):
    """Links of given descriptors against brute force; buckets mix images of three kinds and hold unrelated descriptors."""
    monkeypatch.setattr(image_copies, "BLOCK", block, raising=False)
    rng = np.random.default_rng(6)
    base, table, flat = rng.integers(-(2**63), 2**63 - 1, (3, 8, 2)), {}, []
    for i in range(24):
        for j in range(12):
            d = base[i % 3, j] if j < 8 else np.array([base[rng.integers(3), rng.integers(8), 0] & 0xFFFFFF | int(rng.integers(2**38)) << 24, rng.integers(2**62)])
            for b in rng.choice(128, rng.integers(0, 9), replace=False) if j < 8 else []:
                d = d ^ np.array([np.uint64(1 << int(b) % 64).view(np.int64) if b // 64 == k else 0 for k in (0, 1)])
            x, y = (20 * j + 3 * i, 15 * (j % 4) + 2 * i) if j < 8 else rng.integers(0, 300, 2)
            flat.append((i, int(x), int(y), int(d[0]), int(d[1])))
    for i, x, y, d0, d1 in flat:
        table.setdefault(i, []).append((x * 8 | y * 8 << 20, d0, d1))

    def given(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, *r) for i in b["id"].to_pylist() for r in table[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["id", "geo", "d0", "d1"])

    part = 128 // image_copies.TABLES
    cells, mask = {}, (1 << 128) - 1
    value = lambda r: (r[3] & (2**64 - 1) | (r[4] & (2**64 - 1)) << 64) & mask
    for a, b in itertools.product(flat, flat):
        apart = value(a) ^ value(b)
        if a[0] < b[0] and apart.bit_count() <= image_copies.MAX_BITS and any(not apart >> k * part & (1 << part) - 1 for k in range(image_copies.TABLES)):
            for g in (0, 0.5):
                cell = (g, *(int(np.floor((b[c] - a[c]) / image_copies.PIXELS + g)) for c in (1, 2)))
                cells.setdefault((a[0], b[0], cell), set()).add(a[1:3])
    links = {k[:2] for k, v in cells.items() if len(v) >= image_copies.CONSENSUS}
    monkeypatch.setattr(image_copies, "_features", given)
    images = spark.createDataFrame([(i, bytes([i]), 1) for i in range(24)], "media_id long, pixels binary, width int")
    got = {r.media_id: (r.class_id, r.n_links) for r in image_copies.image_copies(images).collect()}
    assert len(links) > 60 and got == {i: (i % 3, sum(i in k for k in links)) for i in range(24)}


def test_images_of_few_patches_meet_in_blocks(spark, monkeypatch, tmp_path):
    """Mosaics, of which most descriptors are close: no pair of descriptors is written, and the links are those of the tables."""
    rng = np.random.default_rng(11)
    mosaic = lambda a: np.kron(a, np.ones((8, 8))).astype(np.uint8)
    base = [mosaic(rng.integers(0, 255, (8, 8))) for _ in range(70)]
    images = [(i, a) for i, a in enumerate(base)] + [(i + 100, np.ascontiguousarray(a[3:, 5:-2] * 0.9 + 20).astype(np.uint8)) for i, a in enumerate(base[:20])] + [(201, np.ascontiguousarray(np.rot90(base[21])))]
    f = [(i, int(g), int(d["d0"]), int(d["d1"])) for i, a in images for d in [image_copies.describe(a)] for g, d in zip(image_copies.packed(d), d, strict=True)]
    f = spark.createDataFrame(f, "id long, geo long, d0 long, d1 long").repartition(4).cache()
    want = {tuple(r) for r in image_copies.linked(f, str(tmp_path / "tables")).collect()}
    monkeypatch.setattr(image_copies, "MANY", 0)
    met, block_links = [], image_copies._block_links
    monkeypatch.setattr(image_copies, "_block_links", lambda t: met.append(t) or block_links(t))
    for images_of_block in (4096, 9):
        monkeypatch.setattr(image_copies, "IMAGES", images_of_block)
        got = [tuple(r) for r in image_copies.linked(f, str(tmp_path / "blocks")).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {(i, i + 100) for i in range(20)} <= want
    assert len(met) == 2


def test_classes_of_images_without_all_links(spark, monkeypatch):
    """Where only classes are asked for, they are those of all links, though most images of a large class stop at their first link to it."""
    rng = np.random.default_rng(12)
    mosaic = lambda a: np.kron(a, np.ones((8, 8))).astype(np.uint8)
    one = rng.integers(0, 255, (8, 8))
    # Drawings of which many have parts in common, and others.
    base = [mosaic(np.where(rng.random((8, 8)) < 0.4, rng.integers(0, 255, (8, 8)), one)) for _ in range(80)] + [mosaic(rng.integers(0, 255, (8, 8))) for _ in range(40)]
    images = list(enumerate(base)) + [(i + 1000, np.ascontiguousarray(base[i][3:, 5:-2] * 0.9 + 20).astype(np.uint8)) for i in range(0, 120, 6)]
    images += [(2000, base[7]), (None, base[8])]
    df = spark.createDataFrame([(i, a.tobytes(), a.shape[1]) for i, a in images] + [(3000, None, 8)], "media_id long, pixels binary, width int").repartition(3).cache()
    for name, value in (("MANY", 0), ("DENSE", 1 << 40), ("FIRST", 4), ("GROUPS", 6), ("WINDOW", 2)):
        monkeypatch.setattr(image_copies, name, value)
    asked, class_links = [], image_copies._class_links
    monkeypatch.setattr(image_copies, "_class_links", lambda f, work: asked.append((f, class_links(f, work))) or asked[-1][1])
    want = {r.media_id: r.class_id for r in image_copies.image_copies(df).collect()}
    got = image_copies.image_copies(df, counted=False)
    assert got.columns == ["media_id", "class_id"] and got.count() == len(images) + 1
    assert {r.media_id: r.class_id for r in got.collect()} == want and len(asked) == 1
    everything = {tuple(sorted(r)) for r in image_copies._block_links(asked[0][0]).collect()}
    some = {tuple(sorted(r)) for r in asked[0][1].collect()}
    sizes = sorted(Counter(want.values()).values())
    assert some < everything and sizes[-1] > 50 and sizes[0] == 1 and 2 in sizes
    assert image_copies.image_copies(df.limit(0), counted=False).count() == 0


def test_images_strongly_edited(spark):
    """Crops to a third, noise and rescaling of large images: found as by brute force over all pairs of descriptors."""
    rng = np.random.default_rng(9)
    cloud = lambda a: np.clip(128 + 45 * a / a.std(), 0, 255).astype(np.uint8)
    base = [cloud(image_copies._box(image_copies._box(rng.normal(size=(192, 192)), 2), 2)) for _ in range(6)]
    noisy = lambda a: np.clip(a + rng.normal(0, 3, a.shape), 0, 255).astype(np.uint8)
    small = lambda a: np.clip(image_copies._resized(a.astype(float), 0.7), 0, 255).astype(np.uint8)
    edits = [lambda a: a[37:148, 50:161], lambda a: noisy(a[37:148, 50:161]), noisy, small]
    rows = [(i + 10 * k, np.ascontiguousarray(e(b))) for k, e in enumerate([lambda a: a, *edits]) for i, b in enumerate(base)]
    f = {i: image_copies.describe(a) for i, a in rows}
    table = lambda d: d.view(np.uint64)
    brute = set()
    for i, k in itertools.combinations(sorted(f), 2):
        a, b = f[i], f[k]
        apart = sum(np.bitwise_count(table(np.ascontiguousarray(a[d]))[:, None] ^ table(np.ascontiguousarray(b[d]))[None]).astype(int) for d in ("d0", "d1"))
        r, c = np.nonzero(apart <= image_copies.MAX_BITS)
        turn, zoom = (b["angle"][c] - a["angle"][r]) % (2 * np.pi), a["scale"][r] / b["scale"][c]
        sx = b["x"][c] - zoom * (np.cos(turn) * a["x"][r] - np.sin(turn) * a["y"][r])
        sy = b["y"][c] - zoom * (np.sin(turn) * a["x"][r] + np.cos(turn) * a["y"][r])
        for g in (0, 0.5):
            cell = zip(np.floor(turn * (image_copies.TURNS / 2 / np.pi) + g) % image_copies.TURNS, np.floor(np.log2(zoom) / image_copies.OCTAVE + g), np.floor(sx / image_copies.PIXELS + g), np.floor(sy / image_copies.PIXELS + g), strict=True)
            places = {}
            for w, x, y in zip(cell, np.round(a["x"][r]), np.round(a["y"][r]), strict=True):
                places.setdefault(w, set()).add((x, y))
            if any(len(v) >= max(image_copies.CONSENSUS, image_copies.SHARE * min(len(a), len(b))) for v in places.values()):
                brute.add((i, k))
    got = {r.media_id: (r.class_id, r.n_links) for r in image_copies.image_copies(spark.createDataFrame([(i, a.tobytes(), a.shape[1]) for i, a in rows], "media_id long, pixels binary, width int")).collect()}
    found = sum(n for _, n in got.values()) / 2
    assert len(brute) == 60 and found >= 0.95 * len(brute) and all(got[i][0] == i % 10 for i in f)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= size
            docs, size = out, out.count()
    assert set(packing_columns := out.columns) >= {"doc_id", "sequence_id", "offset"} and packing_columns
    assert isinstance(out.limit(3).toPandas(), pd.DataFrame)
