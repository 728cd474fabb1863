"""Alignment of two tokenizers by a dictionary of groups.

Byte offsets where tokens of A and of B both end cut a document into groups. A group is
known by its ids alone, and most groups occur very often, so groups are interned:

1. Texts are read in blocks. A text is cut before spaces where neither tokenizer can join
   both sides; each distinct piece is encoded once and gives its groups. A block yields
   its distinct groups, its documents (which of its groups, how often), and how many of
   its documents hold each linked pair of ids.
2. Pairs of all blocks are summed; the largest count of each A id follows.
3. The links of each distinct group are expanded once, whatever its frequency, and meet
   the counts of their pairs; a group has then a sum of counts and a number of best links.
4. These figures go back by the group's key to the blocks that hold it, and in each block
   to its documents, multiplied by the group's frequency there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, saved, shared_dir, small_batches
from .merges import Places, gather

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Groups of a block from which it is closed, pieces that a task remembers, pieces encoded at once.
BLOCK_GROUPS, CACHED_PIECES, AT_ONCE = 500_000, 300_000, 2048
#: Characters of a string of pieces, texts and characters that are cut before new pieces are learnt.
STRING, TEXTS, CHARS = 4096, 512, 1 << 20
#: Pairs of a group from which its documents' pairs are told apart id by id; bytes up to which a group's ids are its key.
BIG, SHORT = 1 << 14, 32

#: A space after a sign that is no white space under any definition starts a piece: no token of A or B holds both.
_CUT = re.compile("(?<=[!-~¡-ɏ]) (?!\\Z)")
_CUTTABLE = re.compile("[!-~¡-ɏ]\\Z")
_SPACE = "▁"


def _byte_signs() -> dict[str, int]:
    """The characters that stand for bytes in A's entries: bytes that print for themselves, the others by characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(sorted(set(range(256)) - set(plain)))}


class Pieces:
    """What each distinct piece of text is: its A and B ids and its groups, by number."""

    def __init__(self, a_path: str, b_path: str, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.cached = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path), cached
        self.a.encode_special_tokens = True
        signs = _byte_signs()
        with open(a_path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            bytes_a[i] = bytes(signs[c] for c in entry)
        inner = False
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            inner |= _SPACE in p.lstrip(_SPACE)
            bytes_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode())
        #: Where an entry of B holds a space after something else, texts can't be cut.
        self.whole = inner
        self.bytes = [(np.fromiter(map(len, x), np.int64, len(x)), np.frombuffer(b"".join(x), np.uint8)) for x in (bytes_a, bytes_b)]
        self.bytes = [(n, np.cumsum(n) - n, raw) for n, raw in self.bytes]
        self.forget()

    def forget(self) -> None:
        self.place, self.keys, self.singles = Places(), {}, {}
        # Of each group: its ids, how it is written, its distinct pairs (None: very many), its numbers of A and B tokens.
        self.ids: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
        self.written: list[str] = []
        self.pairs: list[list[int] | None] = []
        self.names: list[str] = []  # of each piece: its groups, written out
        self.size = np.zeros((0, 3), np.int64)  # of each piece: tokens of A, of B (-1: its bytes differ), groups
        self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the groups of each piece

    def _encoded(self, strings: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B, and how many each string has. Strings lack the space that stands before them."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in strings], add_special_tokens=False)]
        b = self.b.encode(strings, num_threads=1)
        n = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        return [np.fromiter(chain.from_iterable(x), np.int64, int(k.sum())) for x, k in zip((a, b), n, strict=True)], n

    def _whole(self, flat: list[np.ndarray], n: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each string join to its bytes, by A and by B."""
        size, text = np.fromiter(map(len, raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), np.uint8)
        same, first = np.ones(len(raw), bool), np.cumsum(size) - size
        for k, (length, start, entries) in enumerate(self.bytes):
            of = np.repeat(np.arange(len(raw)), n[k])
            even = np.bincount(of, length[flat[k]], len(raw)).astype(np.int64) == size
            tokens = flat[k][even[of]]
            joined, wanted = gather(entries, start[tokens], length[tokens]), gather(text, first[even], size[even])
            same &= even
            if len(joined):
                wrong = np.add.reduceat((joined != wanted).astype(np.int64), np.cumsum(size[even]) - size[even])
                same[np.flatnonzero(even)[wrong > 0]] = False
        return same

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that end where texts can be cut go through the libraries many in one string, as they would stand in a text; the others alone."""
        joinable = [bool(_CUTTABLE.search(p)) and _SPACE not in p and not self.whole for p in pieces]
        easy, hard = ([k for k, j in enumerate(joinable) if j is want] for want in (True, False))
        strings, members, held, size = [], [], [], 0
        for k in easy:
            held.append(k)
            size += len(pieces[k])
            if size >= STRING:
                strings.append(" ".join(pieces[i] for i in held)), members.append(held)
                held, size = [], 0
        if held:
            strings.append(" ".join(pieces[i] for i in held)), members.append(held)
        strings += [pieces[k] for k in hard]
        members += [[k] for k in hard]
        again: list[int] = []
        for at in range(0, len(strings), AT_ONCE):
            again += self._learn_some(strings[at : at + AT_ONCE], members[at : at + AT_ONCE], pieces)
        for at in range(0, len(again), AT_ONCE):  # members of a string that did not come back whole
            part = again[at : at + AT_ONCE]
            self._learn_some([pieces[k] for k in part], [[k] for k in part], pieces)

    def _learn_some(self, strings: list[str], members: list[list[int]], pieces: list[str]) -> list[int]:
        flat, n = self._encoded(strings)
        same = self._whole(flat, n, [b" " + s.encode("utf-8", "surrogatepass") for s in strings])
        again = [k for ok, m in zip(same.tolist(), members, strict=True) if not ok and len(m) > 1 for k in m]
        order = np.array([k for ok, m in zip(same.tolist(), members, strict=True) if ok for k in m], np.int64)
        bad = [m[0] for ok, m in zip(same.tolist(), members, strict=True) if not ok and len(m) == 1]
        ids = [x[same[np.repeat(np.arange(len(strings)), k)]] for x, k in zip(flat, n, strict=True)]
        ends = [np.cumsum(length[x]) for x, (length, _, _) in zip(ids, self.bytes, strict=True)]
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        edge = [np.concatenate([[0], np.searchsorted(e, cuts) + 1]) for e in ends]
        groups = self._interned(ids, edge)
        # Pieces end at cuts: their groups, and their tokens by the edges of these.
        size = np.fromiter((len(pieces[k].encode("utf-8", "surrogatepass")) + 1 for k in order.tolist()), np.int64, len(order))
        own = np.searchsorted(cuts, np.cumsum(size), side="right")
        first = np.concatenate([[0], own[:-1]]) if len(own) else own
        self._extend(max([*order.tolist(), *bad, *again], default=-1) + 1 + self._base)
        at = order + self._base
        self.start[at], self.size[at, 2] = len(self.flat) + first, own - first
        for k in range(2):
            self.size[at, k] = edge[k][own] - edge[k][first]
        self.size[np.array(bad, np.int64) + self._base, 1] = -1
        self.flat = np.concatenate([self.flat, groups])
        said = [self.written[g] for g in groups.tolist()]
        for i, s, e in zip(at.tolist(), first.tolist(), own.tolist(), strict=True):
            self.names[i] = ";".join(said[s:e])
        return again

    def _extend(self, n: int) -> None:
        more = n - len(self.names)
        if more > 0:
            self.names += [""] * more
            self.start = np.concatenate([self.start, np.zeros(more, np.int64)])
            self.size = np.concatenate([self.size, np.zeros((more, 3), np.int64)])

    def _interned(self, ids: list[np.ndarray], edge: list[np.ndarray]) -> np.ndarray:
        """The number of each group."""
        n = [np.diff(e) for e in edge]
        groups, single = np.empty(len(n[0]), np.int64), (n[0] == 1) & (n[1] == 1)
        codes, of = np.unique(ids[0][edge[0][:-1][single]] << 16 | ids[1][edge[1][:-1][single]], return_inverse=True)
        known = np.empty(len(codes), np.int64)
        for k, code in enumerate(codes.tolist()):
            g = self.singles.get(code)
            if g is None:
                g = self.singles[code] = self._new((code >> 16,), (code & 65535,))
            known[k] = g
        groups[single] = known[of]
        raw = [x.astype("<u2").tobytes() for x in ids]
        many = np.flatnonzero(~single)
        spans = [[(2 * e[many]).tolist(), (2 * e[many + 1]).tolist()] for e in edge]
        for g, s, e, t, f in zip(many.tolist(), *spans[0], *spans[1], strict=True):
            key = (raw[0][s:e], raw[1][t:f])
            known_as = self.keys.get(key)
            if known_as is None:
                known_as = self.keys[key] = self._new(*(tuple(np.frombuffer(x, "<u2").tolist()) for x in key))
            groups[g] = known_as
        return groups

    def _new(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        self.ids.append((a, b))
        self.written.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        ua, ub = set(a), set(b)
        self.pairs.append(None if len(ua) * len(ub) > BIG else [x << 16 | y for x in ua for y in ub])
        return len(self.ids) - 1

    def of(self, texts: list[str]) -> list[np.ndarray | None]:
        """The pieces of texts by number; None for a text that has no tokens. New pieces of all of them are learnt together."""
        parts = [([t] if self.whole else _CUT.split(t)) if t else [] for t in texts]
        index = [np.fromiter(map(self.place.__getitem__, p), np.int64, len(p)) for p in parts]
        if self.place.new:
            self._base = len(self.place) - len(self.place.new)
            self._learn(self.place.new)
            self.place.new = []
        return [i if len(i) and not (self.size[i, 1] < 0).any() else None for i in index]

    def groups(self, index: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[index], self.size[index, 2])


@lru_cache(maxsize=1)
def _pieces(a_path: str, b_path: str) -> Pieces:
    return Pieces(a_path, b_path)


def links(a: tuple[int, ...], b: tuple[int, ...]):
    """The distinct linked pairs of a group and how often each occurs, in parts of at most one A id's where the group is big."""
    (ua, na), (ub, nb) = (np.unique(np.array(x, np.int64), return_counts=True) for x in (a, b))
    step = max(1, BIG // len(ub))
    for at in range(0, len(ua), step):
        yield (ua[at : at + step, None] << 16 | ub).ravel(), (na[at : at + step, None] * nb).ravel()


_ROWS = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, items binary, key binary, ids binary, at int, pair long, docs long"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_KINDS = [_TYPES[f.split()[1]] for f in _ROWS.split(", ")]
_DOC, _GROUP, _PAIR = 0, 1, 2


def _record(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _packed(a: tuple[int, ...], b: tuple[int, ...]) -> bytes:
    return np.array([len(a), len(b)], "<u4").tobytes() + np.array(a + b, "<u2").tobytes()


def unpacked(ids: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
    n = int(np.frombuffer(ids, "<u4", 1)[0])
    both = tuple(np.frombuffer(ids, "<u2", offset=8).tolist())
    return both[:n], both[n:]


def _big_pairs(groups: list[tuple[tuple[int, ...], tuple[int, ...]]]):
    """The distinct pairs of one document with big groups, A id by A id: never all at once."""
    of_a: dict[int, list[int]] = {}
    distinct_b = [np.unique(np.array(b, np.int64)) for _, b in groups]
    for g, (a, _) in enumerate(groups):
        for x in set(a):
            of_a.setdefault(x, []).append(g)
    held, size = [], 0
    for x, own in of_a.items():
        held.append(x << 16 | (distinct_b[own[0]] if len(own) == 1 else np.unique(np.concatenate([distinct_b[g] for g in own]))))
        size += len(held[-1])
        if size >= 1 << 18:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _block(block: int, docs: list[tuple[int | None, np.ndarray | None]], words: Pieces):
    """The rows of one block, batch by batch."""
    index = [i if i is not None else np.zeros(0, np.int64) for _, i in docs]
    count = np.fromiter(map(len, index), np.int64, len(index))
    flat, doc = np.concatenate(index), np.repeat(np.arange(len(docs)), count)
    size = words.size[flat]
    n_a, n_b, n_groups = (np.bincount(doc, size[:, k], len(docs)).astype(np.int64) for k in range(3))
    groups, group_doc = words.groups(flat), np.repeat(np.arange(len(docs)), n_groups)
    known, at = np.unique(groups, return_inverse=True)
    ids = [words.ids[g] for g in known.tolist()]
    lengths = np.array([(len(a), len(b)) for a, b in ids], np.int64).reshape(-1, 2)
    n_links = np.zeros(len(docs), np.int64)
    np.add.at(n_links, group_doc, (lengths[:, 0] * lengths[:, 1])[at])
    sha = [hashlib.sha256(";".join(map(words.names.__getitem__, i.tolist())).encode()).hexdigest() if len(i) else "" for i in index]
    # Distinct groups of each document and how often each occurs.
    code, times = np.unique(group_doc * max(1, len(known)) + at, return_counts=True)
    code_doc, code_at = np.divmod(code, max(1, len(known)))
    edges = np.searchsorted(code_doc, np.arange(len(docs) + 1)).tolist()
    both = np.stack([code_at, times], 1).astype("<u4")
    items = [both[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]
    yield _record(len(docs), kind=np.full(len(docs), _DOC), block=np.full(len(docs), block), doc_id=[i for i, _ in docs], n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=sha, items=items)
    raw = [_packed(a, b) for a, b in ids]
    key = [r if len(r) <= SHORT else hashlib.sha256(r).digest() + b"\0" for r in raw]
    for s in range(0, len(raw), 1 << 14):
        part = slice(s, s + (1 << 14))
        yield _record(len(raw[part]), kind=np.full(len(raw[part]), _GROUP), block=np.full(len(raw[part]), block), key=key[part], ids=[None if len(r) <= SHORT else r for r in raw[part]], at=np.arange(s, s + len(raw[part])))
    # How many documents hold each pair.
    big = np.fromiter((words.pairs[g] is None for g in known.tolist()), bool, len(ids))
    slow = np.unique(code_doc[big[code_at]])
    for d in slow.tolist():
        for pairs in _big_pairs([ids[g] for g in code_at[code_doc == d].tolist()]):
            yield _record(len(pairs), kind=np.full(len(pairs), _PAIR), pair=pairs, docs=np.ones(len(pairs), np.int64))
    own = [words.pairs[g] or [] for g in known.tolist()]
    n_own = np.fromiter(map(len, own), np.int64, len(own))
    pair, pair_at = np.unique(np.fromiter(chain.from_iterable(own), np.int64, int(n_own.sum())), return_inverse=True)
    fast = ~np.isin(code_doc, slow)
    d, g = code_doc[fast], code_at[fast]
    start, held = np.cumsum(n_own) - n_own, np.zeros(len(pair), np.int64)
    # Some documents at a time: a pair counts once for each.
    for s, e in _stretches(d, n_own[g], 1 << 20):
        p = gather(pair_at, start[g[s:e]], n_own[g[s:e]])
        seen = np.unique(np.repeat(d[s:e], n_own[g[s:e]]) * max(1, len(pair)) + p) % max(1, len(pair))
        held += np.bincount(seen, minlength=len(pair))
    some = np.flatnonzero(held)
    yield _record(len(some), kind=np.full(len(some), _PAIR), pair=pair[some], docs=held[some])


def _stretches(doc: np.ndarray, weight: np.ndarray, most: int):
    """Ranges of rows of whole documents, each of about `most` in weight."""
    if not len(doc):
        return
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    total, start, at = np.cumsum(weight), 0, 0
    while start < len(doc):
        base = int(total[start - 1]) if start else 0
        at = max(int(np.searchsorted(total[ends - 1], base + most, side="right")), at + 1)
        end = int(ends[min(at, len(ends)) - 1])
        yield start, end
        start = end


def _portions(batch: pa.RecordBatch):
    """Ids and texts of some rows at a time: of TEXTS rows, and of about CHARS characters, at most."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
        t = t.as_py()
        ids.append(i), texts.append(t)
        size += len(t)
        if len(ids) >= TEXTS or size >= CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _blocks(a_path: str, b_path: str, block_groups: int):
    def run(batches):
        words, block = _pieces(a_path, b_path), TaskContext.get().partitionId() << 32
        docs, held = [], 0
        for b in batches:
            for rows in _portions(b):
                for i, index in zip(rows[0], words.of(rows[1]), strict=True):
                    docs.append((i, index))
                    held += 1 + (0 if index is None else int(words.size[index, 2].sum()))
                    if held >= block_groups:
                        yield from _block(block, docs, words)
                        docs, held, block = [], 0, block + 1
                # Numbers of pieces must not outlive the pieces.
                if len(words.place) > words.cached:
                    if docs:
                        yield from _block(block, docs, words)
                        docs, held, block = [], 0, block + 1
                    words.forget()
        if docs:
            yield from _block(block, docs, words)
        words.forget()

    return run


_LINKS = "key binary, a int, pair long, times long"


def _expanded(batches):
    """The links of each distinct group."""
    for b in batches:
        held, size = [[] for _ in range(3)], 0
        for key, ids in zip(b["key"].to_pylist(), b["ids"].to_pylist(), strict=True):
            for pair, times in links(*unpacked(key if ids is None else ids)):
                held[0] += [key] * len(pair)
                held[1].append(pair)
                held[2].append(times)
                size += len(pair)
                if size >= 1 << 16:
                    yield _links_batch(*held)
                    held, size = [[] for _ in range(3)], 0
        if size:
            yield _links_batch(*held)


def _links_batch(keys, pairs, times) -> pa.RecordBatch:
    pair = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pair >> 16, pa.int32()), pa.array(pair), pa.array(np.concatenate(times))], ["key", "a", "pair", "times"])


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _back(docs: pa.Table, figures: pa.Table) -> pa.Table:
    """One block's documents with the figures of its groups."""
    at = figures["at"].to_numpy()
    value = np.zeros((int(at.max(initial=-1)) + 1, 2), np.int64)
    value[at, 0], value[at, 1] = figures["best"].to_numpy(), figures["sum"].to_numpy()
    items = docs["items"].to_pylist()
    n = np.fromiter((len(i) // 8 for i in items), np.int64, len(items))
    both = np.frombuffer(b"".join(items), "<u4").reshape(-1, 2).astype(np.int64)
    out, of = np.zeros((len(items), 2), np.int64), np.repeat(np.arange(len(items)), n)
    np.add.at(out, of, value[both[:, 0]] * both[:, 1:])
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(out[:, 0]), "count_sum": pa.array(out[:, 1]), "groups_sha256": docs["groups_sha256"]}
    return pa.table(columns)


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_groups: int = BLOCK_GROUPS) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row for each row of docs (doc_id, text), and the linked pairs a, b with docs (how many rows hold the pair) and best (the most of any pair of that a).

    The first has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256
    (see op11_alignment). A text that is null or empty, or whose tokens do not join to a
    space and the text again, has zeros and no groups. Every row is a document, so that
    repeated rows count as often as they occur; a null doc_id stays null. An empty table
    gives empty results; other columns are ignored. A task holds one block and the pieces
    that it knows; a group of very many ids is expanded in parts.
    """
    path = lambda p, name: p or public_tokenizers.path(name)
    work = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = small_batches(only(docs, "doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows = saved(rows.mapInArrow(_blocks(path(a_path, A_FILE), path(b_path, B_FILE), block_groups), _ROWS), f"{work}/blocks")
    pairs = rows.where(F.col("kind") == _PAIR).groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 16).cast("int"))
    # An A id has at most as many pairs as B has entries.
    pairs = saved(pairs.withColumn("best", F.max("docs").over(Window.partitionBy("a"))), f"{work}/pairs")
    groups = rows.where(F.col("kind") == _GROUP).select("block", "at", "key", "ids")
    distinct = groups.groupBy("key").agg(F.first("ids", ignorenulls=True).alias("ids"))
    each = distinct.mapInArrow(_expanded, _LINKS).join(pairs.select("pair", "docs", "best"), "pair")
    times = lambda c: F.sum(F.col("times") * c)
    figures = each.groupBy("key").agg(times(F.col("docs")).alias("sum"), times((F.col("docs") == F.col("best")).cast("long")).alias("best"))
    back = groups.select("block", "at", "key").join(figures, "key").select(F.col("block").alias("of"), "at", "best", "sum")
    own = rows.where(F.col("kind") == _DOC).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "items")
    out = own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_back, _OUT)
    return out, pairs.select("a", F.col("pair").bitwiseAND(65535).cast("int").alias("b"), "docs", "best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum (counts of all links), groups_sha256."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
