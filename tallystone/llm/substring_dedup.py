"""Removal of repeated word windows by FM-indexes over shards of candidate segments.

1. Documents are read in blocks, long ones in pieces. Inside a block, only the first
   occurrence of a window stays open; later ones are settled there, so that a passage
   that a third of all documents share leaves each block once.
2. Every open window belongs to the smallest hash among its k-word grams (its anchor);
   equal windows have equal anchors. Only anchors that occur twice can hold a repeat.
3. The words of those windows go to the anchor's shard. Each shard builds a compressed
   FM-index (wavelet matrix) and streams its segments through it from right to left:
   backward search keeps the match at the threshold length and gives for each window the
   earliest equal one.
4. Anchors with very many segments are settled in rounds: in each, their
   segments are dealt to sub-shards at random, and what has no earlier equal in its
   sub-shard goes on. Segments of an anchor that does not shrink, because its windows
   differ, take anchors of their own, window by window.
5. Windows with an earlier equal one go back to their documents, as intervals of words.

In blocks, windows are equal when two unrelated 64-bit hashes of their words agree. In
shards words travel as 48-bit hashes: two windows of which all but one word are the same
are taken as equal with a chance of about 4e-15. Blocks follow the order in which an
input partition is read; that order must be the same when a lost partition is computed
again, as it is for file scans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, id_back, id_key, only, place, placed, saved, shared_dir, small_batches, words_of
from .wavelet import ContextIndex

WINDOW, GRAM = 20, 5
#: Words in a block, segments in a shard, longest run of windows in a segment.
BLOCK_WORDS, SHARD_SEGMENTS, MAX_RUN = 1_000_000, 8_000, 200
_BYTES = 6
#: Segments of an anchor from which it is settled in rounds of sub-shards of this size.
HOT = 2_000

_OPEN = "id long, tag long, anchor long, start long, stop long"
_SEGMENT = "anchor long, shard long, id long, tag long, start long, stop long, words binary"
_REMOVED = "id long, tag long, start long, stop long"
_ROUND = "anchor long, id long, tag long, start long, stop long, words binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """id, tag (tells rows of one doc_id with different texts apart), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return small_batches(only(docs, "doc_id", "text")).select(id_key().alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _runs(doc: np.ndarray, start: np.ndarray, value: np.ndarray, limit: int) -> np.ndarray:
    """Where runs of consecutive starts of one document and one value begin; at most limit long."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    if limit:
        since = np.arange(len(doc)) - first[np.cumsum(new) - 1]
        first = np.flatnonzero(since % limit == 0)
    return first


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        a, have = np.minimum(a[:-step], a[step:]), have + step
    return a


def _block(pieces: list[tuple[int, int, int, np.ndarray]], window: int, gram: int):
    """Settled intervals and open runs of one block of pieces (id, tag, place, hashes), as columns of _OPEN (anchor null: settled)."""
    pieces = sorted(pieces, key=lambda p: p[:3])
    doc, start, value, proof, anchor = [], [], [], [], []
    # Rows that repeat a document are the same document: an equal window at the same place is not earlier.
    same_as = np.zeros(len(pieces), np.int32)
    for d, (i, g, at, h) in enumerate(pieces):
        same_as[d] = same_as[d - 1] if d and (i, g) == pieces[d - 1][:2] else d
        if len(h) < window:
            continue
        value.append(gram_hashes(h, window, 0xD1342543DE82EF95))
        proof.append(gram_hashes(h, window, 0x2545F4914F6CDD1D))
        anchor.append(_sliding_min(gram_hashes(h, gram), window - gram + 1))
        doc.append(np.full(len(value[-1]), d, np.int32))
        start.append(np.arange(at, at + len(value[-1]), dtype=np.int64))
    if not doc:
        return None
    doc, start, value, proof, anchor = map(np.concatenate, (doc, start, value, proof, anchor))
    by = np.argsort(value, kind="stable").astype(np.int32)
    first = np.ones(len(by), bool)
    np.not_equal(value[by[1:]], value[by[:-1]], out=first[1:])
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by), dtype=np.int32), np.int32(0)))]
    later = np.zeros(len(by), bool)
    later[by] = ~first & (proof[by] == proof[head]) & ((same_as[doc[by]] != same_as[doc[head]]) | (start[by] != start[head]))
    del value, proof, by, head, first
    ids, tags = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    out = []
    i = np.flatnonzero(later)
    f = _runs(doc[i], start[i], np.zeros(len(i)), 0)
    n = np.diff(np.append(f, len(i)))
    d = doc[i][f]
    out.append((ids[d], tags[d], np.zeros(len(f), np.int64), start[i][f], start[i][f] + n + window - 1, np.zeros(len(f), bool)))
    i = np.flatnonzero(~later)
    f = _runs(doc[i], start[i], anchor[i], MAX_RUN)
    n = np.diff(np.append(f, len(i)))
    d = doc[i][f]
    out.append((ids[d], tags[d], anchor[i][f].view(np.int64), start[i][f], start[i][f] + n + window - 1, np.ones(len(f), bool)))
    a, b, c, s, e, is_open = map(np.concatenate, zip(*out, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64(), mask=~is_open), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
        ["id", "tag", "anchor", "start", "stop"],
    )


def _open_windows(window: int, gram: int, block_words: int):
    def run(batches):
        pieces, size = [], 0
        for b in batches:
            for i, g, t in zip(b["id"].to_pylist(), b["tag"].to_pylist(), b["text"], strict=True):
                h = hash_words(words_of(t.as_py()))
                # Pieces of a long document overlap, so that each window lies in one.
                for at in range(0, max(1, len(h) - window + 1), block_words):
                    part = h[at : at + block_words + window - 1]
                    pieces.append((i, g, at, part))
                    size += len(part)
                    if size >= block_words:
                        if (out := _block(pieces, window, gram)) is not None:
                            yield out
                        pieces, size = [], 0
        if size and (out := _block(pieces, window, gram)) is not None:
            yield out

    return run


def _merged(spans: list[dict], window: int) -> list[dict]:
    """The spans of one document, those of one anchor joined where their windows touch: a repeated row is cut otherwise in each block. At most MAX_RUN windows each."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["anchor"] is not None, s["anchor"] or 0, s["start"], s["stop"])):
        last = out[-1] if out else None
        if s["anchor"] is not None and last and last["anchor"] == s["anchor"] and s["start"] <= last["stop"] - window + 1 and s["stop"] - last["start"] < MAX_RUN + window:
            last["stop"] = max(last["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def _segments(shards: int, window: int):
    """Cuts the words of each open run out of its document; settled intervals pass."""

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for i, g, t, spans in zip(b["id"].to_pylist(), b["tag"].to_pylist(), b["text"], b["spans"].to_pylist(), strict=True):
                h = hash_words(words_of(t.as_py())).view(np.uint8).reshape(-1, 8)[:, :_BYTES]
                for s in _merged(spans, window):
                    settled = s["anchor"] is None
                    cols[0].append(s["anchor"])
                    cols[1].append((s["start"] * 7919 + i if settled else s["anchor"]) % shards)
                    cols[2].append(i), cols[3].append(g), cols[4].append(s["start"]), cols[5].append(s["stop"])
                    cols[6].append(None if settled else h[s["start"] : s["stop"]].tobytes())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["anchor", "shard", "id", "tag", "start", "stop", "words"])

    return run


def matched_windows(ids, tags, starts, words: list[bytes], window: int):
    """Of one shard's segments: (segment, first window, number) of runs of windows that have an earlier equal one."""
    order = np.lexsort((starts, tags, ids))
    lengths = np.array([len(words[k]) // _BYTES for k in order])
    raw = np.frombuffer(b"".join(words[k] + b"\0" * _BYTES for k in order), np.uint8).reshape(-1, _BYTES)
    value = np.zeros((len(raw), 8), np.uint8)
    value[:, :_BYTES] = raw
    ends = np.cumsum(lengths + 1) - 1  # the separators
    symbols = np.unique(value.view(np.uint64).ravel(), return_inverse=True)[1].astype(np.int64) + 1
    symbols[ends] = 0
    symbols = np.unique(symbols, return_inverse=True)[1]
    index = ContextIndex(symbols, window)
    at, earliest = index.earliest_matches(symbols, ends - 1, lengths - window + 1)
    seg = np.searchsorted(ends, at)
    first = ends - lengths
    other = np.searchsorted(ends, earliest)
    own = [np.asarray(x)[order] for x in (ids, tags, starts)]
    twin = (own[0][seg] == own[0][other]) & (own[1][seg] == own[1][other]) & (own[2][seg] + at - first[seg] == own[2][other] + earliest - first[other])
    hit = (earliest < at) & ~twin
    at, seg = at[hit], seg[hit]
    by = np.argsort(at)
    at, seg = at[by], seg[by]
    f = _runs(seg, at, np.zeros(len(seg)), 0)
    return order[seg[f]], at[f] - first[seg[f]], np.diff(np.append(f, len(seg)))


def _found(table: pa.Table, window: int):
    """matched_windows of a table of segments, with its columns."""
    ids, tags, starts = (table[c].to_numpy() for c in ("id", "tag", "start"))
    words = table["words"].to_pylist()
    return (ids, tags, starts, words), matched_windows(ids, tags, starts, words, window)


def _shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        names = ["id", "tag", "start", "stop"]
        settled = table.filter(pa.compute.is_null(table["words"])).select(names)
        t = table.filter(pa.compute.is_valid(table["words"]))
        if not t.num_rows:
            return settled
        (ids, tags, starts, _), (seg, first, n) = _found(t, window)
        s = starts[seg] + first
        found = pa.table([pa.array(c, pa.int64()) for c in (ids[seg], tags[seg], s, s + n + window - 1)], names)
        return pa.concat_tables([settled.cast(found.schema), found])

    return run


def _sub_shard(window: int):
    """Settled intervals (words null) and the runs of windows that go on, of one sub-shard of an anchor."""

    def run(table: pa.Table) -> pa.Table:
        (ids, tags, starts, words), (seg, first, n) = _found(table, window)
        anchor = table["anchor"][0].as_py() if table.num_rows else None
        rows = [(anchor, ids[k], tags[k], starts[k] + a, starts[k] + a + m + window - 1, None) for k, a, m in zip(seg, first, n, strict=True)]
        gone = {}
        for k, a, m in zip(seg.tolist(), first.tolist(), n.tolist(), strict=True):
            gone.setdefault(k, []).append((a, a + m))
        for k, w in enumerate(words):
            at = 0
            for a, z in [*sorted(gone.get(k, [])), (len(w) // _BYTES - window + 1, 0)]:
                if a > at:
                    rows.append((anchor, ids[k], tags[k], starts[k] + at, starts[k] + a + window - 1, w[_BYTES * at : _BYTES * (a + window - 1)]))
                at = z
        return pa.table([pa.array([r[c] for r in rows], pa.binary() if c == 5 else pa.int64()) for c in range(6)], _names(_ROUND))

    return run


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _single_windows(window: int):
    """Each window of the segments as a segment, with the hash of its words as its anchor."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for i, g, start, w in zip(*(b[c].to_pylist() for c in ("id", "tag", "start", "words")), strict=True):
                wide = np.zeros((len(w) // _BYTES, 8), np.uint8)
                wide[:, :_BYTES] = np.frombuffer(w, np.uint8).reshape(-1, _BYTES)
                for k, a in enumerate(gram_hashes(wide.view(np.uint64).ravel(), window).view(np.int64).tolist()):
                    for c, v in zip(out, (a, i, g, start + k, start + k + window, w[_BYTES * k : _BYTES * (k + window)]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(out)], _names(_ROUND))

    return run


def _settled_in_rounds(segments: DataFrame, window: int, hot: int, work: str) -> tuple[DataFrame, DataFrame]:
    """Settled intervals of hot anchors' segments, and what is left of them: at most `hot` for each anchor."""
    settled, k, single = None, 0, False
    live = saved(segments, f"{work}/hot")
    left = live.count()
    while True:
        sizes = saved(live.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), f"{work}/sizes{k}")
        if sizes.agg(F.max("n").alias("most")).first()["most"] <= hot:
            return settled, live
        before, k = left, k + 1
        deal = sizes.select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("subs"))
        dealt = live.join(_small(deal), "anchor").withColumn("sub", F.pmod(F.xxhash64("id", "tag", "start", F.lit(k)), "subs"))
        out = saved(dealt.select(*_names(_ROUND), "sub").groupBy("anchor", "sub").applyInArrow(_sub_shard(window), _ROUND), f"{work}/round{k}")
        done = out.where("words IS NULL").select(*_names(_REMOVED))
        settled = done if settled is None else settled.unionByName(done)
        live = out.where("words IS NOT NULL")
        left = live.count()
        if not single and 2 * left > before:
            live, single = saved(live.mapInArrow(_single_windows(window), _ROUND), f"{work}/single"), True
            left = live.count()
        elif single and left >= before:
            # Windows of one anchor are equal now, and of equal windows of different places only the earliest stays.
            raise RuntimeError(f"round {k} of hot anchors settled nothing: {left} windows")


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast as long as it has no more rows than `most`, joined by key otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS, shard_segments: int = SHARD_SEGMENTS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and id, tag, start, stop (word positions) of what a window covers that also starts earlier."""
    work = shared_dir(docs.sparkSession)
    keyed = _keyed(docs)
    # Rows of one id and text are one document: where there are any, their windows are told apart by place, and their text is cut once.
    twins = not keyed.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    opened = saved(keyed.mapInArrow(_open_windows(window, gram, block_words), _OPEN), f"{work}/opened")
    opened = opened.distinct() if twins else opened
    again = opened.where("anchor IS NOT NULL").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_rows = opened.join(again, "anchor").unionByName(opened.where("anchor IS NULL").withColumn("n", F.lit(0).cast("long")))
    open_rows = saved(open_rows.select("id", "tag", "anchor", "start", "stop", "n"), f"{work}/open")
    is_hot = F.col("anchor").isNotNull() & (F.col("n") > hot)
    total = open_rows.agg(F.count("anchor").alias("open"), F.count_if(is_hot).alias("hot")).first()

    def cut(rows: DataFrame, shards: int) -> DataFrame:
        spans = rows.groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("spans"))
        own = keyed.join(spans, ["id", "tag"]).select("id", "tag", "text", "spans")
        return (own.dropDuplicates(["id", "tag"]) if twins else own).mapInArrow(_segments(shards, window), _SEGMENT)

    shards = max(1, -(-total["open"] // shard_segments))
    segments = cut(open_rows.where(~is_hot), shards)
    if not total["hot"]:
        return keyed, segments.groupBy("shard").applyInArrow(_shard(window), _REMOVED)
    settled, left = _settled_in_rounds(cut(open_rows.where(is_hot), shards).drop("shard"), window, hot, work)
    left = left.select("anchor", F.pmod("anchor", F.lit(shards)).alias("shard"), *_names(_ROUND)[1:])
    return keyed, segments.unionByName(left).groupBy("shard").applyInArrow(_shard(window), _REMOVED).unionByName(settled)


def _kept_words(with_text: bool):
    def run(batches):
        for b in batches:
            n, gone, sha, kept_text = [], [], [], []
            for t, spans in zip(b["text"], b["spans"].to_pylist(), strict=True):
                words = words_of(t.as_py())
                n.append(len(words))
                if spans:
                    keep = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        keep[s["start"]] += 1
                        keep[s["stop"]] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(keep)[:-1] == 0)]
                gone.append(n[-1] - len(words))
                text = b" ".join(words)
                sha.append(hashlib.sha256(text).hexdigest())
                # A document that keeps all its words keeps its text as it is.
                kept_text.append((text.decode("utf-8", "surrogatepass") if gone[-1] else t.as_py()) if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["tag"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                ["id", "tag", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of docs (doc_id, text).

    A word goes when a window of `window` words that covers it also starts earlier: in a
    document of smaller doc_id, or earlier in its own. A null text has no words. A null
    doc_id comes before all others. Rows of one doc_id and text are the same document;
    rows of one doc_id and different texts come in an arbitrary, fixed order. Documents
    shorter than a window keep all words. An empty table gives an empty result; other
    columns are ignored.
    """
    keyed, removed = removed_spans(docs, window, **sizes)
    spans = removed.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = keyed.join(spans, ["id", "tag"], "left").select("id", "tag", "text", "spans")
    out = rows.mapInArrow(_kept_words(with_text), "id long, tag long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    cols = [id_back(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256"]
    return out.select(*cols, *(["tag", "kept_text"] if with_text else []))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the kept words as text, n_chars with it; rows that keep no word go, unless they had none."""
    text, names = place(docs, "text"), docs.columns
    own = placed(docs).withColumns({"k_id": id_key(place(docs, "doc_id")), "k_tag": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    new = substring_dedup(docs, with_text=True).where("n_removed < n_words OR n_words = 0")
    new = new.select(id_key().alias("k_id"), F.col("tag").alias("k_tag"), F.col("kept_text").alias("k_text")).dropDuplicates(["k_id", "k_tag"])
    rows = own.drop(text).join(new, ["k_id", "k_tag"]).withColumnRenamed("k_text", text)
    for k, c in enumerate(names):
        if c.lower() == "n_chars":
            rows = rows.withColumn(f"c{k}", F.length(text).cast(docs.dtypes[k][1]))
    return rows.select(*(f"c{k}" for k in range(len(names)))).toDF(*names)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
