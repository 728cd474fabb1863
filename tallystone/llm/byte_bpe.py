"""Byte-level BPE encoding and decoding.

Every distinct word is encoded once, by a fold of ranked merges: its bytes start as tokens,
and each step merges the leftmost pair of least rank, until no pair has a rank. The ranks
of pairs are a literal hash map (two arrays of slots). Decoding concatenates the pieces of
the ids. There are two forms with the same results:

* `encode` folds in numpy, all new words of a block of documents in step. Words whose ids
  a task knows are looked up; when it knows too many it starts anew.
* `encode_native` folds with Spark's higher-order functions, first the most frequent words
  of the corpus (a bounded memo), then other words where they stand. It is far slower;
  the README has figures.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, saved, shared_dir, small_batches
from .merges import NO_RANK, ODD1, ODD2, Merges, Places, cuckoo, gather, rank_pairs

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Slots of the memo: what the driver collects and every task holds, whatever the input.
MEMO = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _list(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


class Codec:
    """Columns that encode and decode by the ranks of one vocabulary file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        if len(ranks) >= 1 << 16 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks of all bytes and below 65536 are needed")
        slots, self.half = cuckoo(rank_pairs(ranks))
        self.slots = _list(slots, "long")
        self.bytes = _list([ranks[bytes([b])] for b in range(256)], "int")
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
        self.pieces = F.split(F.lit(",".join(pieces)), ",")
        self.little = F.split(F.lit(",".join(int(r).to_bytes(4, "little").hex() for r in range(len(pieces)))), ",")

    def _rank(self, slots: Column, a: Column, b: Column) -> Column:
        def by(k):
            first = F.get(slots, F.shiftright(k * ODD1, 13).bitwiseAND(self.half - 1).cast("int"))
            second = F.get(slots, (F.shiftright(k * ODD2, 17).bitwiseAND(self.half - 1) + self.half).cast("int"))
            rank = lambda e: e.bitwiseAND(65535).cast("int")
            return _let(first, lambda e: F.when(F.shiftright(e, 16) == k, rank(e)).otherwise(_let(second, lambda f: F.when(F.shiftright(f, 16) == k, rank(f)).otherwise(NO_RANK))))

        return _let(a.cast("long") * 65536 + b, by)

    def fold(self, word: Column, slots: Column, first: Column) -> Column:
        """The ids of one word (not empty)."""
        none = F.array().cast("array<int>")
        digits = F.hex(word.cast("binary"))
        n = F.length(word.cast("binary"))
        ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(first, F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))

        def start(tokens):
            ranks = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: self._rank(slots, F.get(tokens, i - 1), F.get(tokens, i)))).otherwise(none)
            return _let(ranks, lambda r: F.struct(tokens.alias("ids"), r.alias("ranks"), F.coalesce(F.array_min(r), F.lit(NO_RANK)).alias("least")))

        def step(s, _):
            i, r, m = s["ids"], s["ranks"], s["least"]

            def at(p):
                left = F.when(p > 1, F.array(self._rank(slots, F.get(i, p - 2), m))).otherwise(none)
                right = F.when(p < F.size(r), F.array(self._rank(slots, m, F.get(i, p + 1)))).otherwise(none)
                ranks = F.concat(F.slice(r, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(r, p + 2, F.size(r)))
                merged = F.concat(F.slice(i, F.lit(1), p - 1), F.array(m), F.slice(i, p + 2, F.size(i)))
                return _let(ranks, lambda x: F.struct(merged.alias("ids"), x.alias("ranks"), F.coalesce(F.array_min(x), F.lit(NO_RANK)).alias("least")))

            return F.when(m >= NO_RANK, s).otherwise(_let(F.array_position(r, m).cast("int"), at))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _let(ids, start), step)["ids"]

    def encoded(self, word: Column, slots: Column, first: Column, little: Column) -> Column:
        """A word's ids as hexadecimal digits, little-endian, 32 bits each."""
        return F.array_join(F.transform(self.fold(word, slots, first), lambda i: F.get(little, i)), "")

    def decoded(self, digits: Column, pieces: Column) -> Column:
        """The bytes, as hexadecimal digits, of ids in that form."""
        n = (F.length(digits) / 8).cast("int")
        at = lambda k: F.conv(F.concat(F.substring(digits, 8 * k + 3, F.lit(2)), F.substring(digits, 8 * k + 1, F.lit(2))), 16, 10).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(pieces, at(k))), "")).otherwise("")


def _words(text: Column, pattern: str) -> Column:
    # (?U): letters, digits and white space as Unicode has them, as the pattern means them.
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def _slot(word: Column, n: int) -> Column:
    return F.pmod(F.hash(word), F.lit(n))


def memo(texts: DataFrame, codec: Codec, pattern: str, n: int = MEMO) -> tuple[Column, Column, Column]:
    """Arrays of n words, of their ids, and of the bytes that the ids decode to: in each slot the most frequent word of all texts that falls there."""
    w = texts.select(F.explode(_words(F.col("text"), pattern)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    best = w.where(~F.contains("w", F.lit("\0"))).groupBy(_slot(F.col("w"), n).alias("slot")).agg(F.max(F.struct("c", "w")).alias("b"))
    best = saved(best.select("slot", F.col("b.w").alias("w")), shared_dir(texts.sparkSession) + "/memo").repartition(64)
    code = _let(codec.slots, lambda s: _let(codec.bytes, lambda f: _let(codec.little, lambda x: codec.encoded(F.col("w"), s, f, x))))
    words, ids, back = [""] * n, [""] * n, [""] * n
    text = _let(codec.pieces, lambda p: codec.decoded(F.col("ids"), p))
    for r in best.select("slot", "w", code.alias("ids")).select("*", text.alias("text")).collect():  # n rows at most
        words[r.slot], ids[r.slot], back[r.slot] = r.w, r.ids, r.text
    return F.split(F.lit("\0".join(words)), "\0"), F.split(F.lit(",".join(ids)), ","), F.split(F.lit(",".join(back)), ",")


def encode_native(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, memo_slots: int = MEMO) -> DataFrame:
    """encode with DataFrame functions only: doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    Each match of the pattern is encoded on its own, without special tokens. A null or
    empty text has no tokens and the hash of nothing. A null doc_id stays null; repeated
    rows give repeated rows; an empty table gives an empty result; other columns are
    ignored. A word of n bytes costs time in proportion to n squared.
    """
    codec = Codec(path or public_tokenizers.path(VOCABULARY))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, ids, back = memo(rows, codec, pattern, memo_slots)
    code = lambda i, t: F.struct(i.alias("ids"), t.alias("text"))

    def one(word, s, f, x, p, k, v, t):
        new = _let(codec.encoded(word, s, f, x), lambda i: code(i, codec.decoded(i, p)))
        return _let(_slot(word, memo_slots), lambda at: F.when(F.get(k, at) == word, code(F.get(v, at), F.get(t, at))).otherwise(new))

    def whole(*tables):
        codes = F.transform(_words(F.col("text"), pattern), lambda w: one(w, *tables))
        return _let(codes, lambda c: code(F.array_join(c.getField("ids"), ""), F.array_join(c.getField("text"), "")))

    def bind(columns, *bound):
        return _let(columns[0], lambda c: bind(columns[1:], *bound, c)) if columns else whole(*bound)

    out = rows.select("doc_id", bind([codec.slots, codec.bytes, codec.little, codec.pieces, known, ids, back]).alias("code"))
    n = (F.length("code.ids") / 8).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2(F.unhex("code.ids"), 256).alias("ids_sha256"), F.sha2(F.unhex("code.text"), 256).alias("decoded_sha256"))


#: White space as the pattern means it (the property White_Space), and words that a task remembers.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHED_WORDS = 400_000


class Encoder:
    def __init__(self, path: str, pattern: str, cached: int = CACHED_WORDS):
        self.ranks, self.cached = read_ranks(path), cached
        self.merges = Merges.of_ranks(self.ranks)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.piece_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.piece_start, self.piece_bytes = np.cumsum(self.piece_size) - self.piece_size, np.frombuffer(b"".join(pieces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.place, self.start, self.size, self.flat = Places(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int64, len(raw))
        cut = np.flatnonzero(whole < 0)
        flat, size = self.merges.encode([raw[i] for i in cut])
        sizes = np.ones(len(raw), np.int64)
        sizes[cut] = size
        ids = np.repeat(whole, sizes)
        ids[ids < 0] = flat
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.place) > self.cached:
            self.forget()
        words = [self.pattern.findall(t) for t in texts]
        places = [np.fromiter(map(self.place.__getitem__, w), np.int64, len(w)) for w in words]
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        return [gather(self.flat, self.start[p], self.size[p]) for p in places]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.piece_bytes, self.piece_start[ids], self.piece_size[ids]).tobytes()


def _hashes(path: str, pattern: str):
    def run(batches):
        enc = Encoder(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for at in range(0, b.num_rows, 1024):
                for ids in enc.encode(b["text"].slice(at, 1024).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    Each match of the pattern is encoded on its own, without special tokens. A null or
    empty text has no tokens and the hash of nothing. A null doc_id stays null; repeated
    rows give repeated rows; an empty table gives an empty result; other columns are
    ignored. No shuffle; a task holds a block of texts and the words that it knows. A word
    of n bytes takes n log n steps, be it as long as its text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = small_batches(only(docs, "doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(_hashes(path or public_tokenizers.path(VOCABULARY), pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
