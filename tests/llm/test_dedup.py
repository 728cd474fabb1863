"""Exact, near and substring deduplication against brute force."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from tallystone.llm import components, exact_dedup, jaccard_join, substring_dedup, wavelet


def key(i):
    return -1 if i is None else i


def test_exact(docs, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), key(i)))
    for fan_in in (2, 8):
        got = exact_dedup.exact_dedup(docs.repartition(7).withColumns({"id": F.lit("clash"), "DIGEST": F.lit(1)}), fan_in=fan_in).collect()
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in groups.items()}
        for r in got:
            g = by_sha[r.text_sha256]
            assert (key(r.keep_id), r.group_size) == (min(g)[1], len(g)) and (not r.kept or key(r.doc_id) == min(g)[1])
        assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by_sha)


def test_exact_keeps_one_of_rows_with_one_id(spark):
    rows = [(1, "a b"), (1, "ab"), (2, "ab"), (2, "ab"), (None, ""), (None, None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text_sha256, r.doc_id, r.keep_id) for r in got if r.kept) == sorted([(hashlib.sha256(b"ab").hexdigest(), 1, 1), (hashlib.sha256(b"").hexdigest(), None, None)])
    kept = exact_dedup.without_copies(spark.createDataFrame([(*r, k, "same") for k, r in enumerate(rows)], "DOC_ID long, text string, k_id int, _sha string"))
    assert kept.columns == ["DOC_ID", "text", "k_id", "_sha"] and sorted((r.text or "", r._sha) for r in kept.collect()) == [("", "same"), ("a b", "same")]


def test_exact_keeps_one_of_each(docs, rows):
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def brute_windows(rows, n=20):
    """Rows of one id and text are one document."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: key(r[0])):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            if k in seen:
                gone[a : a + n] = [True] * n
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[key(i)] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(docs, rows):
    want = brute_windows(rows)
    for sizes in ({"block_words": 700, "shard_segments": 20}, {"block_words": 300, "shard_segments": 20, "hot": 3}, {}):
        got = substring_dedup.substring_dedup(docs, **sizes).collect()
        assert len(got) == len(rows)
        assert {key(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_substrings_of_hot_anchors(spark, words):
    """One passage in all documents, and one frequent gram with ever new neighbours: both in rounds."""
    import random

    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, " ".join([some(25), " ".join(words[:40]), some(10), " ".join(words[200:205]), some(10)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df, block_words=100, hot=4, shard_segments=50).collect()}
    assert got == brute_windows(rows)


def test_substrings_of_repeated_rows(spark, words):
    """More rows of one document, and of one text without an id, than an anchor may have segments; other documents share a passage."""
    one, passage = " ".join(words[:30]), " ".join(words[100:130])
    rows = [(7, one)] * 13 + [(None, f"{passage} tail")] * 9 + [(k, f"a{k} {passage} b{k} {one}") for k in range(3, 12)] + [(5, "short")] * 3
    want = brute_windows(rows)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=3, block_words=60, shard_segments=10).collect()]
    # Two texts have the id 7: in a fixed order, which is not that of brute force.
    assert len(got) == len(rows) and {key(g[0]): g[1:] for g in got if g[0] != 7} == {k: v for k, v in want.items() if k != key(7)}
    assert sum(g[0] == 7 for g in got) == 14 and len({g for g in got if g[0] == 7}) == 2


def test_twins_alone_end(spark, words):
    rows = [(1, " ".join(words[:30]))] * 12
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=3).collect()
    assert len(got) == 12 and {(r.n_words, r.n_removed) for r in got} == {(30, 0)}


def test_spans_of_repeated_rows_join():
    span = lambda a, s, e: {"anchor": a, "start": s, "stop": e}
    got = substring_dedup._merged([span(1, 0, 25), span(1, 3, 30), span(1, 40, 61), span(2, 5, 30), span(None, 0, 25), span(None, 3, 30), span(1, 0, 25)], 20)
    assert got == [span(None, 0, 25), span(None, 3, 30), span(1, 0, 30), span(1, 40, 61), span(2, 5, 30)]
    long = substring_dedup._merged([span(1, k, k + 60) for k in range(0, 600, 20)], 20)
    assert max(s["stop"] - s["start"] for s in long) < substring_dedup.MAX_RUN + 20 and {w for s in long for w in range(s["start"], s["stop"] - 19)} == set(range(621))


def test_without_repeats_leaves_other_columns(spark, words):
    passage = " ".join(words[:30])
    rows = [(1, passage + " a", "x", 7), (2, passage, "y", 8), (3, "b  " + passage, "z", 9), (None, None, "n", None)]
    out = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, k_id string, N_CHARS int"))
    assert out.columns == ["doc_id", "text", "k_id", "N_CHARS"]
    assert {r.k_id: (r.text, r.N_CHARS) for r in out.collect()} == {"n": ("", 0), "x": (rows[0][1], len(rows[0][1])), "z": ("b", 1)}


def test_substrings_other_window(docs, rows):
    want = brute_windows(rows, 8)
    assert {key(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, window=8, block_words=900).collect()} == want


def test_wavelet_rank():
    import numpy as np

    s = np.random.default_rng(1).integers(0, 37, 1000)
    wm = wavelet.WaveletMatrix(s, 37)
    start = wm.starts(37)
    sym, i = np.repeat(np.arange(37), 5), np.tile([0, 1, 500, 999, 1000], 37)
    assert wm.rank(sym, i, start[sym]).tolist() == [int((s[:k] == c).sum()) for c, k in zip(sym, i, strict=True)]


def test_near_copies(docs, rows):
    def grams(t):
        w = (t or "").encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(key(i), grams(t)) for i, t in rows]
    links, top = collections.Counter(), list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    want = sorted((i, links[k], min(least[find(k)])) for k, (i, _) in enumerate(sets))
    assert sorted((key(r.doc_id), r.n_links, key(r.class_id)) for r in jaccard_join.jaccard_join(docs).collect()) == want


def test_near_copies_in_blocks(docs, monkeypatch):
    one = sorted((key(r.doc_id), r.n_links, key(r.class_id)) for r in jaccard_join.jaccard_join(docs).collect())
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 5)
    assert sorted((key(r.doc_id), r.n_links, key(r.class_id)) for r in jaccard_join.jaccard_join(docs).collect()) == one


def test_near_copies_of_null_and_large_ids(spark, words, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 1)
    ids, texts = [(None, 5), (2**62, 2**62 + 1), (-(2**62), 2**63 - 1)], []
    for k, (a, b) in enumerate(ids):
        base = " ".join(words[100 * k : 100 * k + 100])
        texts += [(a, base), (b, base + " more")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, pair[0], 1) for pair in ids for i in pair}


def brute_links(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    return {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def test_links_close_to_the_threshold(spark, words, monkeypatch):
    """Pairs at 0.80 to 0.85, among families of pages at about a half that share prefixes: links and classes by brute force."""
    import random

    rng, texts = random.Random(7), []
    for _ in range(150):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(2):
            w = base.copy()
            for at in rng.sample(range(0, 200, 20), 2 * k):  # two words changed: about 10 of 196 shingles each way
                w[at] = f"n{rng.random()}"
            texts.append(" ".join(w[: 200 - rng.randint(0, 12) * k]))
    frame = [rng.choice(words) for _ in range(100)]
    texts += [" ".join(frame + [rng.choice(words) for _ in range(50)]) for _ in range(150)]
    want = brute_links(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(df).collect()}
    links = collections.Counter(i for pair in want for i in pair)
    assert len(want) > 100 and sum(got.values()) == 2 * len(want) and got == {i: links[i] for i in range(len(texts))}
    # The first members' clusters hold what is linked, not the whole family.
    work = str(jaccard_join.shared_dir(spark))
    keyed = jaccard_join._keyed(df)
    reps = jaccard_join.saved(keyed.mapInArrow(jaccard_join._sketches(16, 6), jaccard_join._SKETCH).withColumn("node", F.col("id")), work + "/r")
    edges = jaccard_join.forest_edges(keyed, reps, 16, 6, 0.9995, work)
    sizes = components.components(edges).groupBy("component").count().agg(F.max("count")).first()[0]
    assert sizes < 150


def test_prefixes_shorten_until_recall(spark):
    assert [next(d for d in range(6, 0, -1) if jaccard_join.chance(d, 16, 0.8) >= r) for r in (0.9, 0.995, 0.9995)] == [6, 5, 4]
    rows = [(i, i + 1000, 9, 10, bytes([6] * 16)) for i in range(60)] + [(i + 60, i + 2000, 9, 10, bytes([6, 1] * 8)) for i in range(20)] + [(i + 80, i + 3000, 9, 10, bytes([1, 6] * 8)) for i in range(20)]
    known = spark.createDataFrame(rows, jaccard_join._EDGE)
    assert abs(jaccard_join.measured_recall(known, 6) - 100 * 60 / (80 * 80)) < 1e-9 and jaccard_join.measured_recall(known, 1) == 1.0


def test_one_of_each_class(spark, words):
    base = " ".join(words[:100])
    rows = [(1, base, "a"), (1, base, "b"), (1, base + " more", "c"), (2, base, "d"), (3, None, "e"), (4, " ", "f"), (1, "other text", "g"), (None, base + " x", "h")]
    kept = jaccard_join.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string, k_id string"))
    assert kept.columns == ["doc_id", "text", "k_id"] and sorted(r.k_id for r in kept.collect()) == ["e", "f", "g", "h"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_needed_depths_are_compared_together(spark, docs, monkeypatch):
    """All depths of the forest down to the one that the worst link needs are one comparison; what was compared is not written again."""
    compared, tables = [], []
    verified, saved = jaccard_join._verified, jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "_verified", lambda e, s: compared.append(e) or verified(e, s))
    monkeypatch.setattr(jaccard_join, "saved", lambda df, path: tables.append(path.rsplit("/", 1)[1]) or saved(df, path))
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs.where("doc_id IN (60, 61, 90, 91, 143, 144, 145)")).collect()}
    assert got[143] == got[144] == 1 and got[145] == 0 and got[60] == got[61] >= 1
    assert len(compared) <= 1 + jaccard_join.PARTINGS and tables.count("known") == 0
    assert sum(t.startswith(("stars", "below")) for t in tables) == 2
