"""Language-model scores by masked pseudo-likelihood.

A network predicts every token from two neighbours on either side. Its symbols are the
most frequent words of the whole corpus, counted exactly, and shape classes for all other
words; within its shape class a word has its share of the class's exact count, from a
table that grows with the corpus. P(symbol) is P(class of symbols) times P(member).

Training is the same however the input is split: texts go by their hash to shards of
about SHARD_TOKENS and, within a shard, stand in the order of the hash. In each of ROUNDS
rounds every shard trains a copy of the network on its part of the round, and the copies
and their step sizes are averaged by their numbers of tokens. Every token is learnt from
once. A document's score is the sum of its tokens' conditional log-probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, hash_words, only, saved, shared_dir, small_batches, words_of

#: Classes of symbols and members of a class; shape classes are the members of the last one. Hidden units.
CLASSES, MEMBERS, HIDDEN = 64, 64, 15
SYMBOLS, WORDS = CLASSES * MEMBERS, (CLASSES - 1) * MEMBERS
#: Tokens of a step, of a shard, and of texts that are turned into windows at once; rate; rounds; streams that sum copies.
STEP, SHARD_TOKENS, SPAN, RATE, ROUNDS, STREAMS = 8192, 2_000_000, 65_536, 0.2, 4, 4
OFFSETS = (-2, -1, 1, 2)


def shape_class(word: bytes) -> int:
    """Length, first letter's case and last byte, folded into one of the last class's members."""
    return WORDS + (min(len(word), 15) * 31 + (3 if word[:1].isupper() else 0) + word[-1] * 7) % MEMBERS


def shape_classes(words: pa.Array) -> np.ndarray:
    """shape_class of many words, from their lengths and their first and last bytes."""
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    first, last = data[at[:-1]], data[at[1:] - 1].astype(np.int64)
    return WORDS + (np.minimum(np.diff(at), 15) * 31 + 3 * ((first >= 65) & (first <= 90)) + last * 7) % MEMBERS


@dataclass
class Network:
    """P(token) = P(class) P(member of class); both are softmaxes of a tanh layer over the context's embeddings."""

    embed: np.ndarray  # offset, symbol (the last: beyond the text), hidden
    top: np.ndarray  # hidden + 1, class
    low: np.ndarray  # class, hidden + 1, member

    @staticmethod
    def start(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return Network(draw(len(OFFSETS), SYMBOLS + 1, HIDDEN), draw(HIDDEN + 1, CLASSES), draw(CLASSES, HIDDEN + 1, MEMBERS))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.embed, self.top, self.low

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(vector: np.ndarray) -> Network:
        n, at, out = Network.start(), 0, []
        for p in n.parts():
            out.append(vector[at : at + p.size].astype(np.float32).reshape(p.shape))
            at += p.size
        return Network(*out)

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.ones((context.shape[1], HIDDEN + 1), self.top.dtype)
        z = self.embed[0].take(context[0], 0)
        for k in range(1, len(OFFSETS)):
            z += self.embed[k].take(context[k], 0)
        np.tanh(z, out=h[:, :HIDDEN])
        return h

    def _by_class(self, target: np.ndarray, context: np.ndarray):
        """Order of the targets by class, both in that order, and where each class begins."""
        cls = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))]).tolist()
        return order, target[order], context[:, order], edges

    def _small(self) -> bool:
        """Whether no logit can be too large for exp: hidden units lie between -1 and 1."""
        return (HIDDEN + 1) * max(np.abs(self.top).max(), np.abs(self.low).max()) < 80

    def log_probs(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of each target symbol, given its context (offset, token)."""
        out, small = np.empty(len(target)), self._small()
        for lo in range(0, len(target), 16384):
            part = slice(lo, lo + 16384)
            order, t, c, edges = self._by_class(target[part], context[:, part])
            h, rows, m = self._hidden(c), np.arange(len(t)), t % MEMBERS
            z = h @ self.top
            chosen = z[rows, t // MEMBERS] - _log_sum(z, small)
            for k in range(CLASSES):
                a, b = edges[k], edges[k + 1]
                if a < b:
                    y = h[a:b] @ self.low[k]
                    chosen[a:b] += y[rows[: b - a], m[a:b]] - _log_sum(y, small)
            out[lo + order] = chosen
        return out

    def gradient(self, target: np.ndarray, context: np.ndarray):
        """Of the mean loss: (symbols, rows) for each offset, the top layer's, and {class: array} of the low ones."""
        n, rows = len(target), np.arange(len(target))
        _, t, c, edges = self._by_class(target, context)
        h, m, small = self._hidden(c), t % MEMBERS, self._small()
        one = np.float32(1 / n) if h.dtype == np.float32 else 1 / n
        d = _softmax(h @ self.top, small, one)
        d[rows, t // MEMBERS] -= one
        g_top, g_h, g_low = h.T @ d, d @ self.top.T, {}
        for k in range(CLASSES):
            a, b = edges[k], edges[k + 1]
            if a < b:
                e = _softmax(h[a:b] @ self.low[k], small, one)
                e[rows[: b - a], m[a:b]] -= one
                g_low[k] = h[a:b].T @ e
                g_h[a:b] += e @ self.low[k].T
        back = g_h[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
        g_embed = []
        for k in range(len(OFFSETS)):
            by = np.argsort(c[k].astype(np.uint16), kind="stable")
            symbol = c[k][by]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            g_embed.append((symbol[first], np.add.reduceat(back.take(by, 0), first)))
        return g_embed, g_top, g_low

    def learn(self, target: np.ndarray, context: np.ndarray, state: Network) -> None:
        """One step of Adagrad on the mean loss of a batch; state has the sums of squares."""
        g_embed, g_top, g_low = self.gradient(target, context)
        for k, (symbol, g) in enumerate(g_embed):
            s = state.embed[k][symbol] + g * g
            state.embed[k][symbol] = s
            self.embed[k][symbol] -= RATE * g / np.sqrt(s)
        state.top += g_top * g_top
        self.top -= RATE * g_top / np.sqrt(state.top)
        for c, g in g_low.items():
            state.low[c] += g * g
            self.low[c] -= RATE * g / np.sqrt(state.low[c])


def _log_sum(z: np.ndarray, small: bool) -> np.ndarray:
    most = 0 if small else z.max(1)
    if not small:
        z -= most[:, None]
    return most + np.log(_row_sums(np.exp(z, out=z)))


def _row_sums(z: np.ndarray) -> np.ndarray:
    """As a product, which is faster than a sum over short rows."""
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray, small: bool, total: float) -> np.ndarray:
    """Scaled so that each row adds up to total."""
    if not small:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (total / _row_sums(z))[:, None]
    return z


def _one_thread() -> None:
    """Small products gain nothing from several threads, which would only wait for one another."""
    import ctypes
    import glob
    import os

    for lib in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "lib*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if f := getattr(ctypes.CDLL(lib), name, None):
                f(1)


def _words(text: str) -> Column:
    return F.explode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), f"{BLANK}+"))


def word_counts(docs: DataFrame) -> DataFrame:
    """w, n for every word of all texts."""
    return docs.select(_words("text").alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame) -> dict[bytes, int]:
    """The WORDS most frequent words (ties: by word), numbered so that each class has frequent and rarer ones."""
    top = counts.orderBy(F.desc("n"), "w").limit(WORDS).collect()
    return {r.w.encode("utf-8", "surrogatepass"): k % (CLASSES - 1) * MEMBERS + k // (CLASSES - 1) for k, r in enumerate(top)}


#: Words beyond the vocabulary that a task remembers.
MEMO = 500_000


class _Words(dict):
    """The symbol of each word of the vocabulary; numbers from SYMBOLS on, in order of appearance, for other words."""

    def __init__(self, words: dict):
        super().__init__(words)
        self.new: list[bytes] = []
        self.shapes, self.hashes = np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = SYMBOLS + len(self.shapes) + len(self.new)
        self.new.append(word)
        return at

    def looked_up(self) -> None:
        """Shape classes and hashes of the new words: once a word, not once an occurrence."""
        shapes = np.fromiter(map(shape_class, self.new), np.uint16, len(self.new))
        self.shapes = np.concatenate([self.shapes, shapes])
        self.hashes = np.concatenate([self.hashes, hash_words(self.new).view(np.int64)])
        self.new = []


_ENCODED = "at long, doc_id long, h long, n_tokens long, symbols binary, rare array<long>"


def _encode(words: dict):
    def run(batches):
        table = _Words(words)
        for b in batches:
            if len(table.shapes) > MEMO:
                table = _Words(words)
            ids = []
            for t in b["text"]:
                w = words_of(t.as_py())
                ids.append(np.fromiter(map(table.__getitem__, w), np.int32, len(w)))
            table.looked_up()
            n, symbols, rare = [], [], [np.zeros(0, np.int64)]
            for k in ids:
                beyond = k >= SYMBOLS
                own = k[beyond] - SYMBOLS
                s = k.astype(np.uint16)
                s[beyond] = table.shapes[own]
                n.append(len(k)), symbols.append(s.tobytes()), rare.append(table.hashes[own])
            ends = np.cumsum([len(r) for r in rare])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rare), pa.int64()))
            cols = [b["at"], b["doc_id"], b["h"], pa.array(n, pa.int64()), pa.array(symbols, pa.binary()), rare]
            yield pa.RecordBatch.from_arrays(cols, ["at", "doc_id", "h", "n_tokens", "symbols", "rare"])

    return run


def encoded(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """Each row's symbols and the 64-bit hashes of its words beyond the vocabulary. To be saved before it is used twice: at is a place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(_encode(words), _ENCODED)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some texts and their contexts; two marks of the edge stand on either side of a text."""
    edge = np.full(2, SYMBOLS, np.int32)
    flat = np.concatenate([edge, *(x for t in texts for x in (t, edge))])
    at = np.flatnonzero(flat != SYMBOLS)
    return flat[at], np.stack([flat[at + o] for o in OFFSETS])


def _start() -> np.ndarray:
    net = Network.start()
    return np.concatenate([net.vector(), np.full(net.vector().size, 1e-6, np.float32)])


def _train(vector: np.ndarray):
    """Sums over a task's shards of (weights, squares) times tokens."""
    half = len(vector) // 2

    def run(batches):
        _one_thread()
        seen, total, shard, held, size = 0, None, None, [], 0
        net = state = None
        tokens = 0

        def step():
            nonlocal held, size
            target, context = windows(held)
            for at in range(0, len(target), STEP):
                net.learn(target[at : at + STEP], context[:, at : at + STEP], state)
            held, size = [], 0

        def close():
            nonlocal seen, total
            if held:
                step()
            if tokens:
                part = np.concatenate([net.vector(), state.vector()]).astype(np.float64) * tokens
                seen, total = seen + tokens, part if total is None else total + part

        for b in batches:
            for s, raw in zip(b["shard"].to_pylist(), b["symbols"].to_pylist(), strict=True):
                if s != shard:
                    if net is not None:
                        close()
                    shard, held, size, tokens = s, [], 0, 0
                    net, state = Network.of(vector[:half]), Network.of(vector[half:])
                t = np.frombuffer(raw, np.uint16).astype(np.int32)
                held.append(t)
                size += len(t)
                tokens += len(t)
                if size >= SPAN:
                    step()
        if net is not None:
            close()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "w"])

    return run


def _sum(batches):
    n, total = 0, None
    for b in batches:
        for k, v in zip(b["n"].to_pylist(), b["w"].to_pylist(), strict=True):
            v = np.frombuffer(v, np.float64)
            n, total = n + k, v if total is None else total + v
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "w"])


def train(rows: DataFrame, work: str) -> Network:
    """The network learnt from rows of encoded()."""
    total = rows.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    vector = _start()
    if not total:
        return Network.start()
    shards = -(-total // SHARD_TOKENS)
    mixed = F.xxhash64("h")
    corpus = rows.where("n_tokens > 0").select("h", "symbols", F.pmod(mixed, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(mixed, 32), F.lit(ROUNDS)).alias("round"))
    corpus = corpus.repartitionByRange(min(shards, 10_000), "shard").sortWithinPartitions("round", "shard", "h")
    corpus.write.mode("overwrite").option("compression", "zstd").partitionBy("round").parquet(f"{work}/corpus")
    corpus = rows.sparkSession.read.schema("h long, symbols binary, shard long, round int").parquet(f"{work}/corpus")
    for k in range(ROUNDS):
        copies = corpus.where(F.col("round") == k).select("shard", "symbols").mapInArrow(_train(vector), "n long, w binary")
        sums = copies.repartition(STREAMS).mapInArrow(_sum, "n long, w binary").collect()  # STREAMS vectors at most
        if sums:
            vector = (sum(np.frombuffer(r.w, np.float64) for r in sums) / sum(r.n for r in sums)).astype(np.float32)
    return Network.of(vector[: len(vector) // 2])


@dataclass
class Model:
    words: dict[bytes, int]
    network: Network
    totals: dict[int, int]  # symbol of a shape class → tokens of the corpus there, beyond the vocabulary
    counts: DataFrame  # w, n of every word


def _shapes(batches):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b["n"], pa.array(shape_classes(b["w"]), pa.int32())], ["n", "shape"])


def _word_hashes(batches):
    for b in batches:
        h = hash_words(b["w"].cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), b["n"]], ["w", "n"])


def shape_totals(counts: DataFrame, words: dict[bytes, int]) -> dict[int, int]:
    """Tokens of each shape class (MEMBERS at most)."""
    known = [w.decode("utf-8", "surrogatepass") for w in words]
    rare = (counts.where(~F.col("w").isin(known)) if known else counts).mapInArrow(_shapes, "n long, shape int")
    return {r["shape"]: r["n"] for r in rare.groupBy("shape").agg(F.sum("n").alias("n")).collect()}


def _score(network: Network, totals: dict[int, int]):
    whole = np.zeros(SYMBOLS)
    for s, n in totals.items():
        whole[s] = np.log(n)

    def run(batches):
        _one_thread()
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 512):
                texts = [np.frombuffer(r, np.uint16).astype(np.int32) for r in b["symbols"].slice(lo, 512).to_pylist()]
                target, context = windows(texts)
                total = np.concatenate([[0.0], np.cumsum(network.log_probs(target, context) - whole[target])])
                ends = np.cumsum([len(t) for t in texts])
                out.append(total[ends] - total[ends - np.array([len(t) for t in texts])])
            yield pa.RecordBatch.from_arrays([b["at"], b["doc_id"], b["n_tokens"], pa.array(np.concatenate(out) if out else [], pa.float64())], ["at", "doc_id", "n_tokens", "log_prob"])

    return run


def score_rows(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of saved rows of encoded(). A word that the model's corpus lacks counts as one that occurs once."""
    out = rows.select("at", "doc_id", "n_tokens", "symbols").mapInArrow(_score(model.network, model.totals), "at long, doc_id long, n_tokens long, log_prob double")
    # Merged by key at every size: the table of words grows with the corpus. A word that occurs once adds log 1, which is nothing.
    hashed = model.counts.where("n > 1").mapInArrow(_word_hashes, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    rare = rows.select("at", F.explode("rare").alias("w")).hint("merge").join(hashed, "w")
    own = rare.groupBy("at").agg(F.sum(F.log(F.col("n").cast("double"))).alias("own"))
    out = out.hint("merge").join(own, "at", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("own", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.expr("try_divide(log_prob, n_tokens)").alias("mean_log_prob"))


def fit(docs: DataFrame, work: str) -> tuple[Model, DataFrame]:
    """The model of all texts, and their encoded rows."""
    counts = saved(word_counts(docs), f"{work}/counts")
    words = vocabulary(counts)
    rows = saved(encoded(docs, words), f"{work}/encoded")
    return Model(words, train(rows, work), shape_totals(counts, words), counts), rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """lm_scores of docs by a model of another corpus."""
    return score_rows(saved(encoded(only(docs, "doc_id", "text"), model.words), shared_dir(docs.sparkSession) + "/other"), model)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob for every row of docs (doc_id, text); whole texts, all tokens.

    Null and empty texts have no tokens, a log_prob of 0 and a null mean. A null doc_id
    stays null, repeated rows are scored alike, an empty table gives an empty result;
    other columns are ignored, whatever their names. The model depends on the texts alone,
    not on how the input is split or ordered.
    """
    model, rows = fit(only(docs, "doc_id", "text"), shared_dir(docs.sparkSession))
    return score_rows(rows, model)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
