"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, only, place, placed, small_batches, words_of

#: Hashed word features, rank of the interactions, most labelled rows that are learnt from
#: (those with the smallest hashes of doc_id), passes over them, score from which a row is good.
BUCKETS, RANK, MAX_ROWS, PASSES, THRESHOLD = 1 << 15, 6, 8000, 8, 0.7

STATISTICS = (
    "upper", "lower", "digit", "space", "other_ascii", "beyond_ascii", "bars", "shouts", "signs", "stops",
    "commas", "breaks", "mean_word", "long_words", "distinct", "top_word", "repeats", "shout_words", "caps_words",
    "capital_words", "sign_words", "log_words", "log_declared", "has_declared",
)


def statistics(text: bytes, words: list[bytes], hashes: np.ndarray, declared) -> np.ndarray:
    """Structure of a text and its metadata, each about 0 to 1 (STATISTICS names them)."""
    b = np.frombuffer(text, np.uint8)
    count = np.bincount(b, minlength=256)
    n, m = max(1, len(b)), max(1, len(words))
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    space = count[32] + count[9:14].sum()
    signs = count[[35, 36, 37, 38, 42]].sum()
    ascii_all = count[:128].sum()
    _, freq = np.unique(hashes, return_counts=True)
    ends = np.cumsum([len(w) + 1 for w in words]) - 2 if words else np.zeros(0, np.int64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.concatenate([[0], ends[:-1] + 2]) if words else ends
    last, head = joined[ends] if words else joined, joined[starts] if words else joined
    second = joined[np.minimum(starts + 1, ends)] if words else joined
    size = ends - starts + 1
    is_up = lambda c: (c >= 65) & (c <= 90)
    sign = np.isin(last, np.array([35, 36, 37, 38, 42], np.uint8))
    return np.array(
        [
            upper / n, lower / n, digit / n, space / n, (ascii_all - upper - lower - digit - space) / n, (n - ascii_all) / n if len(b) else 0,
            count[124] / m, count[33] / m, signs / m, count[46] / m, count[44] / m, count[10] / m,
            size.mean() / 10 if words else 0, (size > 15).mean() if words else 0, len(freq) / m, freq.max(initial=0) / m,
            (hashes[1:] == hashes[:-1]).mean() if len(hashes) > 1 else 0, (last == 33).mean() if words else 0,
            (is_up(head) & is_up(second) & (size > 1)).mean() if words else 0, is_up(head).mean() if words else 0, sign.mean() if words else 0,
            np.log1p(len(words)) / 10, np.log1p(max(0, declared or 0)) / 12, float(declared is not None),
        ],
        np.float32,
    )


def features(text: str | None, declared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values (a unit vector of damped counts), and the statistics of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(text)
    h = hash_words(words)
    bucket, count = np.unique((h % np.uint64(BUCKETS)).astype(np.int32), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    return bucket, value / max(1e-6, float(np.linalg.norm(value))), statistics(raw, words, h, declared)


@dataclass
class Machine:
    """score = sigmoid(bias + w x + half of sum over factors of (sum v x)^2 - sum (v x)^2)."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, feature numbers and values of many documents, as one sparse matrix."""
        size = np.array([len(p[0]) for p in parts], np.int64)
        k = len(self.mean)
        dense = (np.stack([p[2] for p in parts]) - self.mean) * self.scale
        row = np.concatenate([np.repeat(np.arange(len(parts)), size), np.repeat(np.arange(len(parts)), k)])
        col = np.concatenate([np.concatenate([p[0] for p in parts]), np.tile(np.arange(BUCKETS, BUCKETS + k), len(parts))])
        return row, col, np.concatenate([np.concatenate([p[1] for p in parts]), np.clip(dense, -6, 6).ravel()]).astype(np.float32)

    def logits(self, row, col, x, n: int) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[col] * x[:, None]
        s = np.stack([np.bincount(row, vx[:, f], n) for f in range(vx.shape[1])], 1)
        squares = np.bincount(row, (vx**2).sum(1), n)
        return self.bias + np.bincount(row, self.w[col] * x, n) + 0.5 * ((s**2).sum(1) - squares), s

    def gradients(self, parts: list, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean weighted logistic loss, by the bias, the weights and the factors."""
        row, col, x = self.rows(parts)
        z, s = self.logits(row, col, x, len(parts))
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(parts)).astype(np.float32)
        gx = g[row] * x
        inner = gx[:, None] * (s[row] - self.v[col] * x[:, None])
        n = len(self.w)
        return np.array([g.sum()]), np.bincount(col, gx, n), np.stack([np.bincount(col, inner[:, f], n) for f in range(self.v.shape[1])], 1)

    def scores(self, parts) -> np.ndarray:
        if not parts:
            return np.zeros(0)
        z, _ = self.logits(*self.rows(parts), len(parts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(parts: list, label: np.ndarray, rank: int = RANK, passes: int = PASSES, rate: float = 0.02, decay: float = 1e-5, seed: int = 11) -> Machine:
    """Logistic loss by Adam over batches of 128 rows; the two classes weigh the same in sum."""
    k = len(STATISTICS)
    dense = np.stack([p[2] for p in parts]) if parts else np.zeros((1, k), np.float32)
    rng = np.random.default_rng(seed)
    size = BUCKETS + k
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32), dense.mean(0), 1 / (dense.std(0) + 1e-3))
    if not parts or label.min() == label.max():
        m.bias = 0.0 if not parts else (4.0 if label[0] else -4.0)
        return m
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    theta = [np.zeros(1, np.float32), m.w, m.v]
    moment, square, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for epoch in range(passes):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            g, gw, gv = m.gradients([parts[i] for i in pick], label[pick], weight[pick])
            step += 1
            for j, grad in enumerate((g, gw + decay * m.w, gv + decay * m.v)):
                moment[j] += 0.1 * (grad - moment[j])
                square[j] += 0.001 * (grad**2 - square[j])
                theta[j] -= rate / (1 + epoch) * (moment[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-8)
            m.bias = float(theta[0][0])
    return m


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, declared of docs, whatever else it has."""
    has = any(c.lower() == "n_chars" for c in docs.columns)
    declared = F.col(place(docs, "n_chars")).cast("long") if has else F.lit(None).cast("long")
    return placed(docs).select(F.col(place(docs, "doc_id")).cast("long").alias("doc_id"), F.col(place(docs, "text")).cast("string").alias("text"), declared.alias("declared"))


def _gather(batches):
    for b in batches:
        parts = [features(t.as_py(), d) for t, d in zip(b["text"], b["declared"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b["quality"], *(pa.array([p[j].tobytes() for p in parts], pa.binary()) for j in range(3))], ["quality", "buckets", "values", "stats"]
        )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Learns from at most max_rows labelled rows outside the held-out quarter; a fixed bound, whatever the input.

    A doc_id that occurs in several rows of docs gives one of them (the least text), so that the bound is one of rows.
    """
    marks = only(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & ~F.coalesce(held_out(), F.lit(True)))
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = _rows(small_batches(docs)).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "declared", "quality")).alias("r")).select("r.*")
    got = rows.select("text", "declared", "quality").mapInArrow(_gather, "quality int, buckets binary, values binary, stats binary").toArrow()
    types = (np.int32, np.float32, np.float32)
    parts = [tuple(np.frombuffer(v, t) for v, t in zip(r, types, strict=True)) for r in zip(*(got[c].to_pylist() for c in ("buckets", "values", "stats")), strict=True)]
    order = sorted(range(len(parts)), key=lambda i: [p.tobytes() for p in parts[i]])  # whatever order tasks end in
    return fit([parts[i] for i in order], got["quality"].to_numpy()[order].astype(np.float64))


def _scores(machine: Machine):
    def run(batches):
        for b in batches:
            out, declared = [], b["declared"].to_pylist()
            for at in range(0, b.num_rows, 256):
                texts = b["text"].slice(at, 256)
                out.append(machine.scores([features(t.as_py(), d) for t, d in zip(texts, declared[at : at + 256], strict=True)]))
            score = np.concatenate(out) if out else np.zeros(0)
            keep = [c for c in b.schema.names if c not in ("text", "declared")]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(score, pa.float64())], [*keep, "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text, perhaps n_chars).

    Learns quality from labels (doc_id, quality), of rows that are not held out; rows
    labelled otherwise than 0 or 1, and labels of null or unknown doc_ids, teach nothing;
    of several labels of a doc_id the least counts. score is in 0 to 1; a null text is
    empty, and empty texts are scored as well. A null doc_id is not held out. Without
    labels every score is near a half. An empty table gives an empty result.
    """
    machine = train(docs, labels, max_rows)
    out = _rows(docs).mapInArrow(_scores(machine), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with their columns."""
    machine = train(docs, labels)
    rows = placed(docs).withColumns({"text": F.col(place(docs, "text")).cast("string"), "declared": F.col(place(docs, "n_chars")).cast("long") if any(c.lower() == "n_chars" for c in docs.columns) else F.lit(None).cast("long")})
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", score double"
    return rows.mapInArrow(_scores(machine), schema).where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
