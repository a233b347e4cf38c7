"""Near-duplicate groups with an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. A document's set are its hashed five-word shingles. Equal sets become one class, so groups of copies, however large,
   cost one row from here on.
2. The forest: classes are sorted by several signature orders. Neighbours whose longest common prefix has DEPTH minima or
   more are candidates; the classes that share such a prefix are a region. There are as many orders as the similarity
   asked for needs, so that two classes at just that similarity have no region in common in MISSED of all cases at most:
   16 orders at 0.85, 23 at 0.8.
3. Where regions that share classes are small together (`block` shingles), they are one task, so that each text travels
   once. Larger clusters, such as chains of texts that are similar one to the next, are compared region by region.
4. Adaptive depth: a region over `block` shingles is too crowded for a task. Its classes are signed anew, at twice the
   depth and with as many more orders as keep the miss rate, and compared in their deeper regions.
5. Regions that are still crowded are cut into blocks. Each block is compared in itself and with the region's first class
   (its hub); then pairs of blocks are compared, but for those whose classes are all of one component by then. A family
   of near copies, however large, takes work in proportion to its size, and no candidate is left out.
6. In a task, all links are found exactly: shingles are ordered by how many members have them, and two sets that are
   similar enough (here 0.85) must share one of their rarest n - ceil(0.85 n) + 1 shingles; such pairs, if not connected
   yet, are compared on their whole sets.
7. Links join to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared, text as tx

WORDS = 5
#: Minima of a prefix, at first and in crowded regions.
DEPTH = 4
DEPTHS = (DEPTH, 2 * DEPTH)
MISSED = 7.5e-6
#: Products of shingles and minima at once.
PRODUCTS = 1 << 18


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending. A-Z count as a-z; fewer words than `words` are one shingle."""
    buf = tx.lower_ascii(buf)
    starts, ends, ptr = tx.words(buf, off)
    h = tx.word_hashes(buf, starts, ends)
    g = tx.grams(h, words, 61)
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(g[a : b - words + 1])
        elif b > a:
            yield tx.grams(h[a:b], b - a, 62 + b - a)
        else:
            yield np.zeros(0, tx.U64)


def orders(percent: int, depth: int = DEPTH) -> int:
    """So many orders that a pair at the similarity shares a prefix but for MISSED of all cases."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    apart = 1 - (percent / 100) ** depth
    return max(1, math.ceil(math.log(MISSED) / math.log(apart))) if apart else 1


def signature(s: np.ndarray, minima: np.ndarray) -> np.ndarray:
    low = np.full(len(minima), np.iinfo(np.uint64).max, tx.U64)
    step = max(16, PRODUCTS // len(minima))
    for i in range(0, len(s), step):
        np.minimum(low, (s[i : i + step, None] * minima).min(axis=0), out=low)
    return low


class Forest:
    """The hashed prefix of a set in each order."""

    def __init__(self, percent: int, depth: int):
        self.depth, self.count = depth, orders(percent, depth)
        self.minima, self.weights = tx.constants(self.count * depth, 47 + depth), tx.constants(depth, 71 + depth)

    def prefixes(self, s: np.ndarray) -> np.ndarray:
        values = signature(s, self.minima).reshape(self.count, self.depth)
        return tx.mix((values * self.weights).sum(axis=1, dtype=tx.U64)).view(np.int64)

    def lists(self, found: list[np.ndarray]) -> pa.ListArray:
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * self.count)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def _signed(percent: int):
    forest = Forest(percent, DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, prefixes = [], [], [], []
            for _, _, buf, off in tx.slices(b.column("text")):
                for s in shingle_sets(buf, off):
                    n.append(len(s))
                    d1.append(tx.mix(s ^ tx.U64(0x1234567)).sum(dtype=tx.U64))
                    d2.append(tx.mix(s + tx.U64(0x89ABCDE)).sum(dtype=tx.U64))
                    prefixes.append(forest.prefixes(s))
            digests = [pa.array(np.array(x, tx.U64).view(np.int64)) for x in (d1, d2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(n, pa.int64()), *digests, forest.lists(prefixes)], ["doc_id", "k1", "k2", "n", "d1", "d2", "prefixes"])

    return tx.trimmed(run)


def _signed_anew(percent: int, depth: int):
    forest = Forest(percent, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [forest.prefixes(s) for _, _, buf, off in tx.slices(b.column("text")) for s in shingle_sets(buf, off)]
            yield pa.RecordBatch.from_arrays([b.column("node"), forest.lists(found)], ["node", "prefixes"])

    return tx.trimmed(run)


def regions(classes: DataFrame) -> DataFrame:
    """(node, region key): the prefix of each order."""
    return classes.select("node", F.posexplode("prefixes").alias("t", "p")).select("node", F.xxhash64("t", "p").alias("key"))


def link_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of its component's first one: sets with 100 * common >= percent * union are linked."""
    n = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    if len(sets) < 2:
        return label
    members: dict[int, list[int]] = {}

    def join(a: int, b: int) -> None:
        if len(members.setdefault(a, [a])) < len(members.setdefault(b, [b])):
            a, b = b, a
        label[members[b]] = a
        members[a] += members.pop(b)

    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((where, count[where], owner))
    where, begin = where[order], np.cumsum(n) - n
    prefix = n - -(-percent * n // 100) + 1
    head = np.arange(len(where)) - np.repeat(begin, n) < np.repeat(prefix, n)
    head &= count[where] > 1
    # postings of prefix shingles, by shingle
    by = np.argsort(where[head], kind="stable")
    shingle, docs = where[head][by], owner[head][by]
    edge = np.searchsorted(shingle, np.arange(len(values) + 1))
    mark = np.zeros(len(values), bool)
    for i in np.argsort(n, kind="stable"):
        mine = where[begin[i] : begin[i] + min(prefix[i], n[i])]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        near = docs[tx.ragged(edge[mine], edge[mine + 1] - edge[mine])]
        near = np.unique(near[label[near] != label[i]])
        near = near[(n[near] < n[i]) | ((n[near] == n[i]) & (near < i))]
        near = near[100 * n[near] >= percent * n[i]]
        if not len(near):
            continue
        whole = where[begin[i] : begin[i] + n[i]]
        mark[whole] = True
        while len(near):
            take = max(1, int(np.searchsorted(np.cumsum(n[near]), 1 << 21)))
            part, near = near[:take], near[take:]
            at = tx.ragged(begin[part], n[part])
            common = np.add.reduceat(mark[where[at]].astype(np.int64), np.cumsum(n[part]) - n[part])
            for j in part[100 * common >= percent * (n[i] + n[part] - common)].tolist():
                if label[i] != label[j]:
                    join(int(label[i]), int(label[j]))
        mark[whole] = False
    return np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]


LINK = "d1 bigint, d2 bigint, r1 bigint, r2 bigint"


def _link(percent: int):
    def settle(sets: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = sorted(sets)
        roots = link_groups([sets[x] for x in names], percent)
        pick = np.flatnonzero(np.bincount(roots, minlength=len(names))[roots] > 1)
        if len(pick):
            a = np.array(names, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[pick, 0], a[pick, 1], a[roots[pick], 0], a[roots[pick], 1])], ["d1", "d2", "r1", "r2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sets = None, {}
        for b in batches:
            keys, names = (list(zip(*(b.column(c).to_pylist() for c in cols), strict=True)) for cols in (("t1", "t2"), ("d1", "d2")))
            for i, _, buf, off in tx.slices(b.column("text")):
                for k, s in enumerate(shingle_sets(buf, off), i):
                    if keys[k] != task:
                        if len(sets) > 1:
                            yield from settle(sets)
                        task, sets = keys[k], {}
                    sets[names[k]] = s
        if len(sets) > 1:
            yield from settle(sets)

    return tx.trimmed(run)


def compared(tasks: DataFrame, percent: int, name: str, files: int) -> DataFrame:
    """The links (d1, d2, r1, r2) of tasks (t1, t2, d1, d2, text): in each task, classes with their component's first."""
    work = tasks.select("t1", "t2", "d1", "d2", "text").repartition("t1", "t2").sortWithinPartitions("t1", "t2")
    return shared.materialise(work.mapInArrow(_link(percent), LINK), name, files)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("d1").alias("a"), F.col("r1").alias("b"))


def crowded_links(crowd: DataFrame, percent: int, block: int, files: int) -> DataFrame:
    """Edges (a, b) between the nodes of crowd (node, d1, d2, n, text), which is a stored table, by steps 3 to 5 above."""
    bodies, left, edges, wide = crowd.select("node", "d1", "d2", "text"), crowd.select("node", "n"), None, None
    for depth in DEPTHS:
        signed = left.select("node").join(bodies, "node").select("node", "text").mapInArrow(_signed_anew(percent, depth), "node bigint, prefixes array<bigint>")
        placed = shared.materialise(regions(signed).join(left, "node"), f"regions-{depth}")
        sizes = shared.materialise(placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.min("node").alias("hub")).where("n > 1"), f"sizes-{depth}", files)
        placed = shared.join_spread(placed.select("key", "node", F.col("n").alias("size")), sizes, ["key"], shared.hot_keys(sizes, ["key"]), "inner")
        narrow = placed.where(F.col("total") <= block).select(F.col("key").alias("t1"), F.lit(0).cast("bigint").alias("t2"), "node")
        found = _edges(compared(narrow.join(bodies, "node"), percent, f"links-{depth}", files))
        edges = found if edges is None else edges.unionByName(found)
        wide = shared.materialise(placed.where(F.col("total") > block), f"crowded-{depth}")
        if not wide.head(1):
            return edges
        left = shared.materialise(wide.select("node", F.col("size").alias("n")).distinct(), f"left-{depth}")
    half = F.lit(max(1, block // 2))  # two blocks are a task
    # each block in itself, and with the hub
    own = wide.withColumn("t2", F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / half)))
    hubs = own.groupBy("key", "t2").agg(F.min("hub").alias("node"))
    once = own.select(F.col("key").alias("t1"), "t2", "node").unionByName(hubs.select(F.col("key").alias("t1"), "t2", "node"))
    edges = edges.unionByName(_edges(compared(once.join(bodies, "node"), percent, "links-blocks", files)))
    known = graph.components(edges, files=files)
    # blocks anew: those of large components by themselves, all others pooled by component
    named = shared.materialise(wide.select("key", "node", "size").join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    large = named.groupBy("key", "root").agg(F.sum("size").alias("total"), F.count("*").alias("n")).where(F.col("total") >= half)
    large = shared.materialise(large, "large", files)
    joined = shared.join_spread(named, large.drop("n"), ["key", "root"], shared.hot_keys(large, ["key", "root"]))
    pools = joined.where("total IS NULL").groupBy("key").agg(F.ceil(F.sum("size") / half).alias("pools"))
    pooled = joined.where("total IS NULL").join(pools, "key").select("key", "node", F.lit(None).cast("bigint").alias("root"), F.pmod(F.xxhash64("root"), F.col("pools")).alias("part"))
    placed = shared.materialise(pooled.unionByName(joined.where("total IS NOT NULL").select("key", "node", "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / half)).alias("part"))), "blocks")
    others = placed.select("key", F.struct("root", "part").alias("other")).distinct().groupBy("key").agg(F.collect_list("other").alias("others"))
    pairs = placed.join(others, "key").select("key", "node", F.struct("root", "part").alias("mine"), F.explode("others").alias("other")).where("mine.root IS NULL OR other.root IS NULL OR mine.root <> other.root")
    tasks = pairs.select(F.col("key").alias("t1"), F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")).alias("t2"), "node")
    return edges.unionByName(_edges(compared(tasks.join(bodies, "node"), percent, "links-pairs", files)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, block: int = 4_000_000) -> DataFrame:
    """A row for each row of docs: doc_id, k1, k2 (key of its text), n_shingles, component_id, kept, group_key.

    Documents are linked where 100 * |common shingles| >= percent * |union|; a component is what links reach, named by
    its least doc_id. kept: doc_id is that (both null counts as equal). A text without words has n_shingles 0 and no
    links, nor has a null. Repeated rows are copies of one another. A component whose doc_ids are all null has a null
    component_id; group_key (null without words) names components too, and has no such gap. block: shingles in a task.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *shared.text_key(F.col(text)))
    signed = shared.materialise(rows.select("doc_id", "k1", "k2", "text").mapInArrow(_signed(percent), "doc_id bigint, k1 bigint, k2 bigint, n bigint, d1 bigint, d2 bigint, prefixes array<bigint>"), "signatures")
    each = signed.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("row"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefixes").alias("prefixes"), F.count("*").alias("copies"))
    classes = shared.materialise(each.withColumn("node", F.col("d1")), "classes")
    files = shared.parts(classes.count(), 100_000, least=6)  # of the tables below, whose rows are a few numbers each
    placed = regions(classes)
    hubs = placed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    clusters = graph.components(placed.join(hubs.drop("n"), "key").select(F.col("node").alias("a"), F.col("hub").alias("b")), files=files)
    members = clusters.join(classes.select("node", "d1", "d2", "row", "n", "copies"), "node")
    sizes = shared.materialise(members.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("n")), "clusters", files)
    members = shared.join_spread(members, sizes.drop("n"), ["root"], shared.hot_keys(sizes, ["root"]), "inner")
    wanted = members.select("root", "total", "node", "n", "d1", "d2", F.coalesce("row.doc_id", F.lit(0)).alias("i"), F.col("row.doc_id").isNull().alias("z"), F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2"))
    at = ["i", "z", *shared.KEY]
    keyed = lambda df: df.withColumn("i", F.coalesce("doc_id", F.lit(0))).withColumn("z", F.col("doc_id").isNull()).drop("doc_id")
    # the same row many times: dealt over tasks, then once
    hot = shared.hot_keys(keyed(signed.select("doc_id", *shared.KEY)).groupBy(*at).agg(F.count("*").alias("n")), at) if classes.where(F.col("copies") > shared.HOT_ROWS).head(1) else None
    bodies = shared.join_spread(keyed(rows), wanted, at, hot, "inner")
    if hot is not None:
        bodies = bodies.dropDuplicates(["root", "d1", "d2"])
    # most clusters are a task each
    links = compared(bodies.where(F.col("total") <= block).withColumn("t1", F.col("root")).withColumn("t2", F.lit(0).cast("bigint")), percent, "links", files)
    whole = links.select("d1", "d2", F.col("r1").alias("root"))
    if sizes.where(F.col("total") > block).head(1):
        crowd = shared.materialise(bodies.where(F.col("total") > block).select("node", "d1", "d2", "n", "text").dropDuplicates(["node"]), "crowd")
        roots = graph.components(crowded_links(crowd, percent, block, files), files=files)
        whole = whole.unionByName(roots.join(crowd.select("node", "d1", "d2"), "node").select("d1", "d2", "root"))
    linked = whole.join(classes.select("d1", "d2", "least"), ["d1", "d2"])
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root").select("d1", "d2", "component", "root")
    names = classes.select("d1", "d2", "least").join(named, ["d1", "d2"], "left").select("d1", "d2", F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component"), F.coalesce("root", "d1").alias("group_key"))
    copies = shared.hot_keys(classes.select("d1", "d2", F.col("copies").alias("n")), ["d1", "d2"])
    out = shared.join_spread(signed.select("doc_id", "k1", "k2", "n", "d1", "d2"), names, ["d1", "d2"], copies)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group_key")
