"""Ranked merges of byte-pair encodings over many words at once."""

from __future__ import annotations

import heapq

import numpy as np

#: Bytes from which a word is merged by a heap of its own, in n log n.
LONG = 256
NO_RANK = 1 << 20
ODD1, ODD2 = 0x9E3779B1, 0x85EBCA77


def rank_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id * 65536 + right id → rank of the piece that the two make."""
    pairs = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    return pairs


def cuckoo(pairs: dict[int, int]) -> tuple[list[int], int]:
    """A table in which a key (below 2^32, with a value below 2^16) lies in one of two slots; its half length."""
    half = 1 << max(4, len(pairs).bit_length())
    key = np.fromiter(pairs, np.int64, len(pairs))
    one, two = (key * ODD1 >> 13) & (half - 1), ((key * ODD2 >> 17) & (half - 1)) + half
    places, owner = list(zip(one.tolist(), two.tolist(), strict=True)), [-1] * (2 * half)
    for j in range(len(places)):
        x, side = j, 0
        for _ in range(500):
            slot = places[x][side]
            x, owner[slot] = owner[slot], x
            if x < 0:
                break
            side = 1 if places[x][0] == slot else 0
        else:
            raise RuntimeError("the pairs do not fit; take a larger table")
    values = list(pairs.values())
    return [int(key[j]) << 16 | values[j] if j >= 0 else -1 for j in owner], half


class Places(dict):
    """Numbers words in the order in which they first come; new: those that came since it was last emptied."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices [start, start + size) of flat, one after another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    return flat[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)]


class Merges:
    """Ranked merges of a tokenizer file, carried out for many words at once, one merge a word in each round."""

    def __init__(self, pairs: dict[int, int], merged: np.ndarray, inner: np.ndarray, last: np.ndarray):
        """pairs: left id * 65536 + right id → rank; merged: rank → id; inner and last: byte → id, inside a word and at its end."""
        slots, self.half = cuckoo(pairs)
        self.slots, self.merged, self.inner, self.last = np.array(slots, np.int64), merged, inner, last
        self.pairs = pairs

    @staticmethod
    def of_file(spec: dict) -> Merges:
        """Of a tokenizer file whose words end in a marked token."""
        vocabulary, rules = spec["model"]["vocab"], spec["model"]["merges"]
        pairs, merged = {}, np.zeros(len(rules), np.int64)
        for rank, m in enumerate(rules):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs[vocabulary[a] << 16 | vocabulary[b]] = rank
            merged[rank] = vocabulary[a + b]
        # Bytes that print stand for themselves in the file, the others for characters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {c: chr(c) for c in plain} | {c: chr(256 + n) for n, c in enumerate(c for c in range(256) if c not in set(plain))}
        tokens = lambda end: np.array([vocabulary[sign[c] + end] for c in range(256)], np.int64)
        return Merges(pairs, merged, tokens(""), tokens("</w>"))

    @staticmethod
    def of_ranks(ranks: dict[bytes, int]) -> Merges:
        """Of a file of ranks, in which a piece's rank is its id."""
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        return Merges(rank_pairs(ranks), np.arange(max(ranks.values()) + 1), single, single)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 16 | b
        one, two = self.slots[(k * ODD1 >> 13) & (self.half - 1)], self.slots[((k * ODD2 >> 17) & (self.half - 1)) + self.half]
        return np.where(one >> 16 == k, one & 65535, np.where(two >> 16 == k, two & 65535, NO_RANK))

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one word: a heap of ranked pairs over a linked list; stale entries are passed over."""
        raw = np.frombuffer(word, np.uint8)
        start = self.inner[raw]
        start[-1] = self.last[raw[-1]]
        n, ids, pairs, merged = len(raw), start.tolist(), self.pairs, self.merged
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = np.append(self._rank(start[:-1], start[1:]), NO_RANK).tolist()
        heap = [r * n + i for i, r in enumerate(rank) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:
                continue
            ids[i], gone = int(merged[r]), right[i]
            right[i], rank[gone], ids[gone] = right[gone], NO_RANK, -1
            if right[i] < n:
                left[right[i]] = i
            for j in (left[i], i):
                if j >= 0:
                    k = right[j]
                    rank[j] = pairs.get(ids[j] << 16 | ids[k], NO_RANK) if k < n else NO_RANK
                    if rank[j] < NO_RANK:
                        heapq.heappush(heap, rank[j] * n + j)
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (none empty) one after another, and their numbers.

        Words of less than LONG bytes take a round for each merge, all in step; longer ones
        a heap each, so that a word costs n log n steps however long it is.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        if (size >= LONG).any():
            flat, n = self.encode([w for w in words if len(w) < LONG])
            long = [self._long(w) for w in words if len(w) >= LONG]
            own = np.zeros(len(words), np.int64)
            own[size < LONG], own[size >= LONG] = n, [len(x) for x in long]
            out, is_long = np.empty(int(own.sum()), np.int64), np.repeat(size >= LONG, own)
            out[~is_long], out[is_long] = flat, np.concatenate(long)
            return out, own
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, ends = self.inner[raw], np.cumsum(size) - 1
        ids[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(ids), NO_RANK)
        if len(ids) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._rank(ids[:-1], ids[1:]), NO_RANK)
        done = []
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(ids)))
            live = np.repeat(least < NO_RANK, length)
            if not live.all():
                done.append((word[~live], ids[~live]))
                ids, word, rank = ids[live], word[live], rank[live]
                least, length = least[least < NO_RANK], length[least < NO_RANK]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            for left in (at[at > 0] - 1, at):
                right = np.minimum(left + 1, len(ids) - 1)
                near = (word[left] == word[right]) & (left != right)
                rank[left] = np.where(near, self._rank(ids[left], ids[right]), NO_RANK)
        if not done:
            return np.zeros(0, np.int64), size
        of, flat = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))
