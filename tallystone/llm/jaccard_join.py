"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification.

1. Documents with one set of shingles form a class; only its representative goes on.
2. Each tree of the forest is a table of labels (MinHash values of a representative, in
   order): the sorted form of a prefix trie, in which the labels below a prefix stand
   together. Whole labels and prefixes are matched together down to the depth at which the
   worst link's probability reaches the target recall, then ever shorter prefixes, until
   that of the links found so far does, by capture and recapture between the halves of the
   forest.
3. Below a prefix, every representative is compared exactly with the first one (a star,
   not all pairs). Members at similarity 0.6 or more belong to the first one's cluster: by
   the triangle inequality a link to a member linked to it cannot be further away. What
   is not linked to it is taken apart by a new first one, twice; only what is left then is
   joined to a cluster without a comparison.
4. The shingle sets of a cluster meet once, in blocks, and all its pairs are verified
   exactly by counting common shingles. Links are counted, not listed; per block only the
   edges of a spanning forest leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, id_back, id_key, mix, only, place, placed, saved, shared_dir, shingles, small_batches, words_of
from .components import components

#: Words in a shingle; the threshold as a fraction; trees, label length, target recall.
SHINGLE, NUM, DEN = 5, 4, 5
TREES, LABEL, RECALL = 16, 6, 0.9995
#: Representatives in a block of a large cluster, and in a task that verifies small ones.
BLOCK, TASK_ROWS = 256, 128
#: How often what is not linked to a prefix's first member is taken apart; members that share a copy of it.
PARTINGS, STAR = 2, 1024
#: Large clusters that are broadcast; more are joined by key.
LARGE = 100_000
#: Links that must be at hand before their measured recall counts.
MEASURED = 50

_SKETCH = "id long, tag long, d1 long, d2 long, size long, labels array<binary>"
_SETS = "bin string, cluster long, x int, y int, id long, weight long, block int, shingles binary"
_FOUND = "id long, links long, root long"
_EDGE = "u long, v long, shared long, either long, depths binary"


def chance(depth: int, trees: int, similarity: float) -> float:
    """That two sets of a similarity share a prefix of some depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def labels(sets: np.ndarray, trees: int, label: int) -> np.ndarray:
    """MinHash values of one set, a row for each tree (uint32)."""
    rng = np.random.default_rng(20240501)
    a = rng.integers(1, 2**31, trees * label, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, trees * label, dtype=np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(trees * label, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096, None] * a
        part += b
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(0), out=out)
    return out.reshape(trees, label)


def _sketches(trees: int, label: int):
    def run(batches):
        for b in batches:
            d1, d2, size, out = [], [], [], []
            for t in b["text"]:
                s = shingles(words_of(t.as_py()), SHINGLE)
                size.append(len(s))
                d1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                d2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0x9E37))).view(np.int64)) if len(s) else 0)
                # Big-endian, so that labels sort as their values do.
                out.append([r.tobytes() for r in labels(s, trees, label).astype(">u4")] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["tag"], pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.list_(pa.binary()))],
                ["id", "tag", "d1", "d2", "size", "labels"],
            )

    return run


def _member_sets(batches):
    for b in batches:
        raw = [shingles(words_of(t.as_py()), SHINGLE).tobytes() for t in b["text"]]
        yield pa.RecordBatch.from_arrays([b["node"], pa.array(raw, pa.binary()), b["labels"]], ["node", "shingles", "labels"])


def _compared(batches):
    """Common and all shingles of each pair, and the length of the common prefix in each tree."""
    for b in batches:
        shared, either, depths = [], [], []
        for one, two, la, lb in zip(b["one"], b["two"], b["labels_1"].to_pylist(), b["labels_2"].to_pylist(), strict=True):
            x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
            n = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(n), either.append(len(x) + len(y) - n)
            same = np.frombuffer(b"".join(la), np.uint32).reshape(len(la), -1) == np.frombuffer(b"".join(lb), np.uint32).reshape(len(lb), -1)
            depths.append(np.cumprod(same, 1).sum(1).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b["u"], b["v"], pa.array(shared, pa.int64()), pa.array(either, pa.int64()), pa.array(depths, pa.binary())], ["u", "v", "shared", "either", "depths"])


def _grouped(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """key, node, v: members (key, node) of the groups that hubs (key, v, n; a saved table) names, with the group's first one.

    Groups of more than BLOCK members, of which there is one for BLOCK members at most, are
    looked up where their members stand; small ones meet by key. So no key is hot.
    """
    large = hubs.where(F.col("n") > BLOCK).select("key", "v")
    if large.limit(LARGE + 1).count() > LARGE:
        return members.hint("merge").join(hubs.select("key", "v"), "key").select("key", "node", "v")
    near = members.join(F.broadcast(large), "key").select("key", "node", "v")
    rest = members.join(F.broadcast(large.select("key")), "key", "left_anti")
    return near.unionByName(rest.hint("merge").join(hubs.where(F.col("n") <= BLOCK).select("key", "v"), "key").select("key", "node", "v"))


def _stars(groups: DataFrame) -> DataFrame:
    """u, v: each member of a group with the group's first one."""
    return groups.where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) compared. The set of a v with many u is copied for each STAR of them."""
    copies = edges.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("copies"))
    e = edges.hint("merge").join(copies, "v").withColumn("copy", F.pmod(F.xxhash64("u"), "copies").cast("int"))
    hub = sets.hint("merge").join(copies.withColumnRenamed("v", "node"), "node").select(F.col("node").alias("v"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("two"), F.col("labels").alias("labels_2"))
    e = e.hint("merge").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("one"), F.col("labels").alias("labels_1")), "u")
    return e.hint("merge").join(hub, ["v", "copy"]).select("u", "v", "one", "two", "labels_1", "labels_2").mapInArrow(_compared, _EDGE)


def _linked(times: int = 1) -> str:
    """The condition of a link, or of a distance up to `times` that of the weakest link."""
    return f"{DEN} * shared >= {DEN - times * (DEN - NUM)} * either"


def forest_edges(keyed: DataFrame, reps: DataFrame, trees: int, label: int, recall: float, work: str) -> DataFrame:
    """Edges (u, v) between representatives (node, id, tag, labels) whose components hold every link whole."""
    forest = reps.select("node", F.posexplode("labels").alias("tree", "label"))
    # Sorted tables of labels are the tries; the parquet files keep the order.
    forest = saved(forest.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label"), f"{work}/forest")

    def below(*depths: int) -> DataFrame:
        """key, node, v of the prefixes of some depths that have two members or more."""
        prefixes = F.array(*(F.expr(f"concat(unhex(hex({d})), unhex(hex(tree)), substring(label, 1, {4 * d}))") for d in depths))
        g = forest.select(F.explode(prefixes).alias("key"), "node")
        hubs = g.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return _grouped(g, saved(hubs, f"{work}/hubs{depths[0]}"))

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        want = reps.hint("merge").join(nodes, "node", "left_semi").select("node", "id", "tag", "labels")
        # Merged by key at every size: members grow with the input, so that side is never broadcast.
        return saved(keyed.hint("merge").join(want, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("node", "text", "labels").mapInArrow(_member_sets, "node long, shingles binary, labels array<binary>"), f"{work}/{name}")

    least = label
    while least > 1 and chance(least, trees, NUM / DEN) < recall:
        least -= 1
    # The depths that the worst link needs in any case go together: they share their shuffles.
    groups = saved(below(*range(least, label + 1)), f"{work}/below{least}")
    sets = sets_of(groups.select("node").distinct(), "sets")
    known = saved(_verified(_stars(groups), sets), f"{work}/stars{least}")
    groups, depth = groups.where(f"substring(key, 1, 1) = unhex(hex({least}))"), least
    while depth > 1 and measured_recall(known, depth) < recall:
        depth -= 1
        groups = saved(below(depth), f"{work}/below{depth}")
        more = groups.select("node").distinct().hint("merge").join(sets.select("node"), "node", "left_anti")
        sets = sets.unionByName(sets_of(more, f"sets{depth}"))
        new = _stars(groups).hint("merge").join(known, ["u", "v"], "left_anti")
        known = known.unionByName(saved(_verified(new, sets), f"{work}/stars{depth}"))
    # What is not linked to a prefix's first member, where some of it is too far for its cluster.
    for k in range(PARTINGS):
        groups = saved(_left_over(groups, known, f"{work}/far{k}"), f"{work}/left{k}")
        if groups.isEmpty():
            break
        new = _stars(groups).hint("merge").join(known, ["u", "v"], "left_anti")
        known = known.unionByName(saved(_verified(new, sets), f"{work}/known{k}"))
    edges = known.where(_linked(2)).select("u", "v")
    rest = saved(_left_over(groups, known, f"{work}/far"), f"{work}/rest") if not groups.isEmpty() else groups
    return edges.unionByName(_stars(rest))


def measured_recall(known: DataFrame, depth: int) -> float:
    """The recall of a depth over the links among known pairs, by capture and recapture between even and odd trees; 1 where they are too few to tell."""
    at = lambda side: F.exists(F.sequence(F.lit(side), F.length("depths") - 1, F.lit(2)), lambda k: F.conv(F.hex(F.substring("depths", k + 1, F.lit(1))), 16, 10).cast("int") >= depth)
    links = known.where(_linked()).select(at(0).alias("one"), at(1).alias("two"))
    r = links.agg(F.count_if("one").alias("one"), F.count_if("two").alias("two"), F.count_if(F.col("one") & F.col("two")).alias("both"), F.count_if(F.col("one") | F.col("two")).alias("any")).first()
    return r["any"] * r["both"] / (r["one"] * r["two"]) if r["any"] >= MEASURED and r["both"] else 1.0


def _left_over(groups: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Of groups with a member beyond the first one's cluster: what is not linked to the first one, with a new first one."""
    g = groups.where("node <> v").withColumnRenamed("node", "u").hint("merge").join(known.select("u", "v", "shared", "either"), ["u", "v"]).where(f"NOT ({_linked()})")
    far = g.groupBy("key").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n"), F.bool_or(F.expr(f"NOT ({_linked(2)})")).alias("far")).where("n > 1 AND far")
    return _grouped(g.select("key", F.col("u").alias("node")), saved(far.select("key", "v", "n"), path))


def _sets(bins: int):
    """The shingle set of each candidate, for each pair of blocks that it takes part in; pairs of a large cluster are tasks of their own."""

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(8)]
            for t, i, cluster, weight, blocks in zip(b["text"], *(b[c].to_pylist() for c in ("node", "cluster", "weight", "blocks")), strict=True):
                raw = shingles(words_of(t.as_py()), SHINGLE).tobytes()
                own = int(mix(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(blocks))
                for other in range(blocks):
                    x, y = min(own, other), max(own, other)
                    where = f"{cluster}/{x}/{y}" if blocks > 1 else str(int(mix(np.array([cluster], np.int64).view(np.uint64))[0] % np.uint64(bins)))
                    for c, v in zip(cols, (where, cluster, x, y, i, weight, own, raw), strict=True):
                        c.append(v)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bin", "cluster", "x", "y", "id", "weight", "block", "shingles"])

    return run


def common_counts(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """For all pairs of sets, how many members they share."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    size = np.array([len(s) for s in sets])
    member, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = member[count > 1]
    if not len(shared):
        return out
    row, col = np.repeat(np.arange(n), size), np.concatenate(sets)
    at = np.minimum(np.searchsorted(shared, col), len(shared) - 1)
    hit = shared[at] == col
    row, at = row[hit], at[hit]
    by = np.argsort(at, kind="stable")
    row, at = row[by], at[by]
    edges = np.searchsorted(at, np.arange(0, len(shared) + width, width))
    for k in range(len(edges) - 1):
        r, c = row[edges[k] : edges[k + 1]], at[edges[k] : edges[k + 1]] - k * width
        used, r = np.unique(r, return_inverse=True)
        x = np.zeros((len(used), min(width, len(shared))), np.float32)
        x[r, c] = 1
        out[np.ix_(used, used)] += x @ x.T
    return out


def links_of(ids: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """id, weight of linked ones, root of its tree, for one block pair; pairs: which pairs belong to it."""
    size = np.array([len(s) for s in sets], np.float32)
    common = common_counts(sets)
    linked = ((NUM + DEN) * common >= NUM * (size[:, None] + size)) & pairs
    np.fill_diagonal(linked, False)
    links = linked @ weight
    root = np.arange(len(ids))
    while True:  # the smallest id of each component
        low = np.where(linked, ids[root][None, :], np.iinfo(np.int64).max).min(1)
        new = np.searchsorted(ids, np.minimum(low, ids[root]))
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(ids[k]), int(links[k]), int(ids[root[k]])) for k in np.flatnonzero(links)]


def _verify(table: pa.Table) -> pa.Table:
    found = []
    if table.num_rows:
        cols = {c: table[c].to_numpy() for c in ("cluster", "x", "y", "id", "weight", "block")}
        raw = table["shingles"]
        order = np.lexsort((cols["id"], cols["y"], cols["x"], cols["cluster"]))
        key = np.stack([cols[c][order] for c in ("cluster", "x", "y")])
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[a:z]
            sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in k]
            # Rows that repeat a representative are the same representative.
            new = [j == 0 or cols["id"][k[j]] != cols["id"][k[j - 1]] or not np.array_equal(sets[j], sets[j - 1]) for j in range(len(k))]
            k, sets = k[new], [s for s, keep in zip(sets, new, strict=True) if keep]
            block, one = cols["block"][k], cols["x"][k[0]] == cols["y"][k[0]]
            pairs = np.ones((len(k), len(k)), bool) if one else block[:, None] != block
            found += links_of(cols["id"][k], cols["weight"][k], sets, pairs)
    return pa.table([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["id", "links", "root"])


def _keyed(docs: DataFrame) -> DataFrame:
    """id, tag (tells rows of one doc_id with different texts apart), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return small_batches(only(docs, "doc_id", "text")).select(id_key().alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _classified(docs: DataFrame, trees: int, label: int, recall: float) -> DataFrame:
    """id, tag, rep (the representative's id), top (a number of the class, null without shingles), class_id, links for every row of docs."""
    work = shared_dir(docs.sparkSession)
    keyed = _keyed(docs)
    rows = saved(keyed.mapInArrow(_sketches(trees, label), _SKETCH), f"{work}/sketches")
    same = ["d1", "d2", "size"]
    reps = rows.where("size > 0").groupBy(*same).agg(F.min(F.struct("id", "tag")).alias("r"), F.count(F.lit(1)).alias("weight"), F.first("labels").alias("labels"))
    reps = saved(reps.select(F.monotonically_increasing_id().alias("node"), *same, F.col("r.id").alias("id"), F.col("r.tag").alias("tag"), "weight", "labels"), f"{work}/reps")
    clusters = saved(components(forest_edges(keyed, reps, trees, label, recall, work)).select("node", F.col("component").alias("cluster")), f"{work}/clusters")
    # Only clusters of several blocks need a look-up, one row for each BLOCK documents at most; small ones stay where they are.
    large = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    large = saved(large, f"{work}/large")
    few = large.limit(LARGE + 1).count() <= LARGE
    cand = clusters.join(F.broadcast(large) if few else large.hint("merge"), "cluster", "left").select("node", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    cand = saved(cand.hint("merge").join(reps.select("node", "id", "tag", "weight"), "node"), f"{work}/candidates")
    total = cand.agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("most")).first()
    bins = max(1, total["n"] // TASK_ROWS)
    sets = keyed.join(cand.hint("merge"), ["id", "tag"]).select("text", "node", "cluster", "weight", "blocks").mapInArrow(_sets(bins), _SETS)
    found = saved(sets.groupBy("bin").applyInArrow(_verify, _FOUND), f"{work}/found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if (total["most"] or 0) > 1:
        tops = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
        links = links.join(tops.select(F.col("node").alias("id"), F.col("component").alias("top")), "id").select("id", "links", F.col("top").alias("root"))
    per_class = reps.select(*same, "node", "id", "weight").join(links.withColumnRenamed("id", "node"), "node", "left")
    per_class = saved(per_class.select(*same, F.col("id").alias("rep"), F.coalesce("root", "node").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), f"{work}/classes")
    least = per_class.groupBy("top").agg(F.min("rep").alias("class_id"))
    return rows.select("id", "tag", *same).join(per_class.join(least, "top"), same, "left").select("id", "tag", "rep", "top", "class_id", "links")


def jaccard_join(docs: DataFrame, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, representative, n_links for every row of docs (doc_id, text).

    Two documents are linked when the Jaccard similarity of their sets of five-word
    shingles is 0.8 or more. n_links counts the other rows that a row is linked to, copies
    included; class_id is the smallest doc_id of the rows connected by links;
    representative is the smallest doc_id with the very same set. A text of one to four
    words is one shingle; null, empty and blank texts have none and are linked to nothing.
    A null doc_id sorts first. Rows are documents of their own, also where they repeat a
    doc_id. An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    return _classified(docs, trees, label, recall).select(
        id_back(F.col("id")).alias("doc_id"),
        id_back(F.coalesce("class_id", "id")).alias("class_id"),
        id_back(F.coalesce("rep", "id")).alias("representative"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, that of the smallest doc_id (of its texts, the one of least hash); rows without words all stay."""
    rows = _classified(docs, TREES, LABEL, RECALL)
    stay = rows.where("top IS NOT NULL").groupBy("top").agg(F.min(F.struct("id", "tag")).alias("r")).select(F.col("r.id").alias("k_id"), F.col("r.tag").alias("k_tag"))
    text = F.coalesce(F.col(place(docs, "text")).cast("string"), F.lit(""))
    own = placed(docs).withColumns({"k_id": id_key(place(docs, "doc_id")), "k_tag": F.xxhash64(text)})
    blank = ~text.rlike(BLANK.replace("[", "[^", 1))
    kept = own.where(~blank).join(stay, ["k_id", "k_tag"], "left_semi").dropDuplicates(["k_id", "k_tag"])
    return kept.unionByName(own.where(blank)).drop("k_id", "k_tag").toDF(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
