"""Packing of tokenised documents into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches
from .merges import Merges, Places, gather

LENGTH, END_ID, VOCABULARY = 4096, 2, "word_bpe_49k.json"
#: Tokens planned at once, and words whose ids a worker remembers.
PLAN_TOKENS, CACHED_WORDS = 1_000_000, 300_000
#: In tokens: the cost of a sequence, of a cut after a sentence, of a cut elsewhere; where a sentence
#: is longer than STRIDE, cuts are also allowed each STRIDE tokens.
SEQUENCE_COST, SENTENCE_COST, OTHER_COST, STRIDE = 8, 2, 32, 256

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words of these are cut into letters, which become lower case, and marks, just as the vocabulary's own rules cut them.
_CUT = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|([^\n]+))$", re.MULTILINE)


class WordTokenizer:
    """Token ids of texts. Blanks never take part in a token of this vocabulary, so ids are looked up word by word.

    Letters of new words are merged here, many words at once; whatever is not plain goes
    through the tokenizers library.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.cached = Tokenizer.from_file(path), cached
        with open(path, encoding="utf-8") as f:
            self.merges = Merges.of_file(json.load(f))
        vocabulary = self.model.get_vocab()
        stops = [i for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4] and not t[:-4].strip(".!?")]
        self.is_stop = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_stop[stops] = True
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # of word k: [ends[k], ends[k + 1])

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words, in the order of their places."""
        found = _CUT.findall(b"\n".join(words).decode("utf-8", "replace"))
        heads = {h: k for k, h in enumerate(dict.fromkeys(low.lower() for low, _, _ in found if low))}
        rest = {r: k + len(heads) for k, r in enumerate(dict.fromkeys(marks or other for _, marks, other in found if marks or other))}
        flat, size = self.merges.encode([h.encode() for h in heads])
        ids = [e.ids for e in self.model.encode_batch_fast(list(rest), add_special_tokens=False)]
        size = np.concatenate([size, np.fromiter(map(len, ids), np.int64, len(ids)), [0]])
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.int64, int(size[len(heads) :].sum()))])
        none, start = len(size) - 1, np.cumsum(size) - size
        part = np.fromiter((k for low, marks, other in found for k in ((heads[low.lower()], rest[marks] if marks else none) if low else (rest[other], none))), np.int64, 2 * len(found))
        new, own = gather(flat, start[part], size[part]), size[part].reshape(-1, 2).sum(1)
        n, total = len(self.place) - len(words), len(new)
        used = int(self.ends[n])
        while n + len(own) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.ends[n + 1 : n + 1 + len(own)] = used + np.cumsum(own)
        self.flat[used : used + total] = new

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, with END_ID after each text; the number of ids of each text."""
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.place) > self.cached:
            self.forget()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        first, size = self.ends[index], self.ends[index + 1] - self.ends[index]
        # END_ID comes after the last word of each text, as one more "word".
        sizes = np.insert(size, np.cumsum(counts), 1)
        total = np.cumsum(sizes)
        ids = np.full(int(total[-1]) if len(total) else 0, END_ID, np.uint32)
        slot = np.ones(len(ids), bool)
        ends = np.cumsum(counts + 1) - 1
        slot[total[ends] - 1] = False
        ids[slot] = gather(self.flat, first, size)
        return ids, np.diff(np.concatenate([[0], total[ends]]))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process; the words that it knows go when a task ends."""
    return WordTokenizer(path)


def cut_points(ids: np.ndarray, counts: np.ndarray, is_stop: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a sequence may end, and what a cut costs there: ends of documents (nothing), of sentences, and others in long sentences."""
    ends = np.cumsum(counts)
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[np.flatnonzero(is_stop[ids]) + 1] = SENTENCE_COST
    cost[np.concatenate([[0], ends])] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.flatnonzero(np.diff(at) > stride)
    for g in gaps:
        cost[at[g] + stride : at[g + 1] : stride] = OTHER_COST
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def plan(cuts: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest ends of sequences over cuts[0] .. cuts[-1], in order; neighbours lie at most `length` apart.

    A sequence of d tokens costs SEQUENCE_COST, its cut, and length - d of padding, or no
    padding when d is a power of two. The best start for a padded one minimises
    best[i] + cuts[i] over a sliding range: a queue of ever larger values holds it.
    Starts at a power of two before are looked up.
    """
    n, c = len(cuts), cuts.tolist()
    exact: list[list[int]] = [[] for _ in range(n)]
    p = 1
    while p <= length:
        i = np.searchsorted(cuts, cuts - p)
        hit = np.flatnonzero((cuts[np.minimum(i, n - 1)] == cuts - p) & (cuts - p >= cuts[0]))
        for j, k in zip(hit.tolist(), i[hit].tolist(), strict=True):
            exact[j].append(k)
        p *= 2
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(c[0], 0)])
    fee = (cost + SEQUENCE_COST).tolist()
    for j in range(1, n):
        here = c[j]
        low = here - length
        while c[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value -= low
        for k in exact[j]:
            if best[k] <= value:
                value, i = best[k], k
        value += fee[j]
        best[j], back[j] = value, i
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(c[j])
        j = back[j]
    return out[::-1]


def pieces(doc_ids: list, ids: np.ndarray, counts: np.ndarray, is_stop: np.ndarray, first_sequence: int, length: int = LENGTH):
    """The pieces of whole documents as columns, and the next free sequence number."""
    cuts, cost = cut_points(ids, counts, is_stop, min(STRIDE, length))
    ends = np.array(plan(cuts, cost, length), np.int64)
    doc_ends = np.cumsum(counts)
    edges = np.union1d(ends, doc_ends)
    starts = np.concatenate([[0], edges[:-1]])
    doc = np.searchsorted(doc_ends, starts, side="right")
    seq = np.searchsorted(ends, starts, side="right")
    doc_start, seq_start = (doc_ends - counts)[doc], np.concatenate([[0], ends])[seq]
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), edges.tolist(), strict=True)]
    columns = [[doc_ids[d] for d in doc.tolist()], starts - doc_start, edges - starts, crc, counts[doc], seq + first_sequence, starts - seq_start]
    return columns, first_sequence + len(ends)


def _pack(path: str, length: int, plan_tokens: int):
    def run(batches):
        words, number = tokenizer(path), TaskContext.get().partitionId() << 40
        docs, ids, counts, held = [], [], [], 0

        def flush():
            nonlocal docs, ids, counts, held, number
            cols, number = pieces(docs, np.concatenate(ids), np.concatenate(counts), words.is_stop, number, length)
            docs, ids, counts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in _PIECES.split(", ")])

        for b in batches:
            texts = b["text"]
            for at in range(0, len(texts), 1024):
                i, n = words.encode(texts.slice(at, 1024).to_pylist())
                docs += b["doc_id"].slice(at, 1024).to_pylist()
                ids.append(i), counts.append(n)
                held += len(i)
                if held >= plan_tokens:
                    yield flush()
        if docs:
            yield flush()
        words.forget()

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, plan_tokens: int = PLAN_TOKENS) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text); see op10_packing for the columns.

    Every input partition is packed on its own, in its order, without a shuffle: documents
    follow one another, and sequences end where dynamic programming puts the cheapest cuts
    (ends of documents or sentences, seldom elsewhere). Plans span about plan_tokens
    tokens and whole documents; a plan's end and a partition's end close a sequence, which
    pads at most length / plan_tokens (0.4 %) more. A marker of the vocabulary that stands
    in a text becomes its own id, as the library has it. A null or empty text is END_ID alone. A null doc_id stays
    null. Repeated rows are packed as often as they occur. An empty table gives an empty
    result; other columns are ignored. sequence_id holds the partition in its upper bits.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = small_batches(only(docs, "doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(_pack(path or public_tokenizers.path(VOCABULARY), length, plan_tokens), _PIECES)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, start (ids before the piece in its document), length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
