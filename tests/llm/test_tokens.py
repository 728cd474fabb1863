"""Alignment of tokenizers, fill-in-the-middle, sharding: against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallystone.llm import alignment, fill_middle, sharding
from tallystone.llm.common import only

ODD = [
    "  two  spaces\n\n  and\ttabs \n", " x", "x ", "\n", "a\n b\n\n  c", "don't <|endoftext|> <s> </s> <0x0A> <unk>", "naïve 你好 😀 é x  y  z", "a▁b c", "\x00 \x01a", "٣ ٤ '‏s",
    "aaaa" * 500, " " * 333, "　 ᠎ x", "…" * 40 + " ", "ü" * 70, "<P> inside", "A1b2 C3", ".", "é" * 3 + "ab" * 5, "x" * 70_000 + "1" + "y" * 70_000, "ﬁ Å Å", "z \x85 w\x1c v",
]


@pytest.fixture(scope="module")
def mixed(spark, rows):
    """The shared rows, odd texts, and columns whose names clash in all but case."""
    out = rows + [(1000 + k, t) for k, t in enumerate(ODD)] + [(-5, "negative"), (2**40, "large id")]
    df = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(out)], "doc_id long, text string, lang string, TEXT string, Doc_Id long").repartition(3)
    return df, out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- alignment -----------------------------------------------------------------------------------


def plain_alignment(texts):
    """Straight from the contract: whole texts through both libraries, all pairs of each group."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))
    signs = alignment._byte_signs()
    entry = {i: bytes(signs[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    cut, held = [], defaultdict(int)
    for t in texts:
        x, y = a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        if not t or not (b"".join(entry[i] for i in x) == b"".join(map(piece, y)) == (" " + t).encode()):
            cut.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(entry[i]) for i in x]).tolist(), np.cumsum([len(piece(i)) for i in y]).tolist()
        both, groups, at, bt = set(ends_a) & set(ends_b), [], 0, 0
        for end in sorted(both):
            na, nb = ends_a.index(end, at) + 1, ends_b.index(end, bt) + 1
            groups.append((x[at:na], y[bt:nb]))
            at, bt = na, nb
        cut.append((x, y, groups))
        for p in {(i, j) for g in groups for i in g[0] for j in g[1]}:
            held[p] += 1
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for c in cut:
        if c is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups = c
        pairs = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(x), len(y), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in pairs.items()), sha(text)))
    return out, held


@pytest.mark.parametrize("block, big, cached", [(500_000, 1 << 14, 300_000), (700, 3, 50)])
def test_alignment(mixed, monkeypatch, block, big, cached):
    monkeypatch.setattr(alignment, "BIG", big)
    df, rows = mixed
    # Workers import the module anew: what they see of BIG and the cache is set where they run.
    want, held = plain_alignment([t for _, t in rows])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got, pairs = alignment.alignment(df, block_groups=block)
    got = sorted((str(r.doc_id), *(r[c] for c in names)) for r in got.collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert {(r.a, r.b): r.docs for r in pairs.collect()} == dict(held)
    assert sum(w[0] == 0 for w in want) == 3 and sum(w[0] > 0 for w in want) > 150


def test_pieces_are_cut_where_neither_tokenizer_joins():
    import sentencepiece
    from tokenizers import Tokenizer

    paths = [public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE)]
    words, rng = alignment.Pieces(*paths, cached=20), random.Random(4)
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    signs = [" ", " ", "  ", "a", "the", "\n", "\t", ".", "'s", "é", "1", " ", "…", " ", "你", "Z", "ɏ", "ɐ", "\x1c", "​"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        parts = alignment._CUT.split(t)
        assert [i for p in parts for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        assert [i for p in parts for i in b.encode(p)] == b.encode(t), repr(t)
        index = words.of([t])[0]
        assert index is None or words.size[index, :2].sum(0).tolist() == [len(a.encode(" " + t, add_special_tokens=False).ids), len(b.encode(t))]


def test_pairs_of_big_groups(monkeypatch):
    rng = random.Random(2)
    groups = [(tuple(rng.randrange(50) for _ in range(30)), tuple(rng.randrange(60) for _ in range(25))) for _ in range(4)]
    want = {i << 16 | j for a, b in groups for i in a for j in b}
    got = np.concatenate(list(alignment._big_pairs(groups)))
    assert len(got) == len(want) and set(got.tolist()) == want
    monkeypatch.setattr(alignment, "BIG", 7)
    for a, b in groups:
        times = Counter(i << 16 | j for i in a for j in b)
        parts = list(alignment.links(a, b))
        assert len(parts) > 1 and {p: n for x, y in parts for p, n in zip(x.tolist(), y.tolist(), strict=True)} == times
        assert alignment.unpacked(alignment._packed(a, b)) == (a, b)


def test_documents_stay_whole_in_stretches():
    doc = np.array([0, 0, 1, 2, 2, 2, 5, 7])
    got = list(alignment._stretches(doc, np.array([3, 3, 1, 9, 9, 9, 1, 1]), 7))
    assert got == [(0, 3), (3, 6), (6, 8)] and list(alignment._stretches(doc[:0], doc[:0], 7)) == []


def test_big_groups_in_a_block(monkeypatch):
    """Blocks with the limit at a few pairs give the same rows as without it."""
    paths = [public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE)]
    words = alignment.Pieces(*paths)
    texts = [*ODD[:19], ODD[5] * 3, "", "plain words here", "plain words here"]
    docs = list(enumerate(words.of(texts)))

    def counts():
        out = Counter()
        for r in alignment._block(0, docs, words):
            for k, p, n in zip(*(r[c].to_pylist() for c in ("kind", "pair", "docs")), strict=True):
                if k == alignment._PAIR:
                    out[p] += n
        return out

    plain = counts()
    monkeypatch.setattr(alignment, "BIG", 2)
    words.forget()
    docs = list(enumerate(words.of(texts)))
    assert counts() == plain and max(plain.values()) > 1


# ---- fill in the middle --------------------------------------------------------------------------


def plain_transform(doc_id, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fill_middle(mixed, empty):
    df, rows = mixed
    want = sorted(map(str, ((i, *plain_transform(i, t or "")) for i, t in rows)))
    got = fill_middle.fill_middle(df).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    digests = {(r.doc_id, r.output_sha256): r for r in fill_middle.fill_middle(df, digests=True).collect()}
    texts = Counter((i, sha(t or "")) for i, t in rows)
    for r in got:
        d = digests[r.doc_id, sha(r.output)]
        assert (d.n, d.form, d.prefix_chars, d.middle_chars) == (r.n, r.form, r.prefix_chars, r.middle_chars) and texts[r.doc_id, d.restored_sha256]
    assert fill_middle.fill_middle(empty).count() == 0


def test_cuts_of_all_ranks(monkeypatch):
    monkeypatch.setattr(fill_middle, "LONG", 3)
    words = fill_middle.Cutter(cached=4)
    for t in ODD[:19]:
        ends = np.cumsum([0, *map(len, re.findall("[A-Za-z]+|[^A-Za-z]", t))]).tolist()
        assert words.cut(t, lambda n: range(n + 1)) == (len(ends) - 1, ends)


def test_markers_at_the_edges_of_slices():
    pieces = ["<", "<S", "P>", ">", "<M", "S>", "a", "", "<<"]
    for p in pieces:
        for m in pieces:
            for s in pieces:
                text = p + m + s
                if not any(x in text for x in ("<P>", "<S>", "<M>")):
                    assert fill_middle.restore(f"<P>{p}<S>{s}<M>{m}", "psm") == text == fill_middle.restore(f"<S>{s}<P>{p}<M>{m}", "spm")


# ---- sharding ------------------------------------------------------------------------------------


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**63, 3000)], np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(after[before != after].tolist()) == {24} and 60 < (before != after).sum() < 190
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_sharding(mixed, empty):
    df, rows = mixed
    got = sharding.shard_slots(df).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        key = int(hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.law, r.shard, r.grown_shard) == ("key", plain_jump(key, 24), plain_jump(key, 25)) and r.grown_shard in (r.shard, 24)
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in sorted(rs, key=lambda r: r.slot)]
        assert order == sorted(order)
    assert sharding.shard_slots(empty).count() == 0


def test_files_of_shards_grow(spark, mixed, tmp_path):
    df, rows = mixed
    df = only(df, "doc_id", "text")
    sharding.write_shards(df, f"{tmp_path}/old", 5)
    stay = sharding.grow(spark, f"{tmp_path}/old", f"{tmp_path}/new", 5).collect()
    moved = spark.read.parquet(f"{tmp_path}/new").collect()
    assert {r.shard for r in moved} == {5} and len(stay) + len(moved) == len(rows)
    assert sorted(str((r.doc_id, r.shard)) for r in sharding.sharded(df, 6).collect()) == sorted(str((r.doc_id, r.shard)) for r in [*stay, *moved])
    clash = spark.createDataFrame([("k", 1, 2)], "key string, SHARD int, Key int")
    assert sharding.sharded(clash, 4, key="key", name="part").columns == ["key", "SHARD", "Key", "part"]
