"""N-gram Jaccard join: count-vector R-tree over hashed groups of shingles.

Shingles are hashed into groups; the counts of its groups make a document a point, and the summed coordinate minima
of two points bound from above the overlap of their sets. That bound prunes a packed R-tree; pairs that survive are
verified on the sets themselves.

The tree is cut over the cluster at its top. Documents with equal sets are one class, of which one document goes on.
For a level of sizes at most D elements lie in the symmetric difference of two linked sets, so of D + 1 blocks of
groups at least one holds the same content in both: a box of the tree that fixes one block. Each class sends one key
(16 bytes) for each block of its own level and of the next; where D is 1, one for the set and one for the set without
each of its elements. Where up to PRUNED classes share a key, a tree of their count vectors tells which of them
may link; of more classes all are taken to. The connected components of that relation are the subtrees that go to a
task each, with their sets. In a subtree of more than `max_block` classes or MAX_BYTES of text every set is first held
against that of the smallest id, and only the sets that don't link with it are compared with all others, as pairs of
blocks: a template with small edits costs what it holds, not its square. Only texts that may link move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, broadcast_small, connected_components, groups, keyed, materialize, mix, partitions, shingle_hashes, unkeyed, word_hashes

#: Entries of a node; coordinates of a point at least and at most (a power of two, by the set's size).
FANOUT, LEAST, MOST = 16, 64, 1024
#: Classes and bytes of text in a block of a split subtree.
MAX_BLOCK, MAX_BYTES = 3000, 32 << 20
#: Parts of the keys to one of the usual shuffle partitions.
FINER = 4
#: Classes that share a key up to which their count vectors are compared.
PRUNED = 1000


def levels(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(level, blocks, spare blocks) in which a set of n elements looks for sets of its own size and larger or smaller.

    Blocks are one more than the differences that the level allows and spare ones, so that few sets leave so many
    empty that two may agree in those only; 0 where it allows one difference.
    """
    if n <= 0:
        return []
    step = -math.log(percent / 100) if percent < 100 else 1e-6
    own = math.floor(math.log(n) / step)
    out = []
    for level in (own, own + 1):
        largest = math.ceil(math.exp((level + 1) * step)) + 1
        differ = (100 - percent) * 2 * largest // (100 + percent)
        spare = differ // 4 + 2
        if differ:
            out.append((level, differ + 1 + spare, spare) if differ > 1 else (level, 0, 0))
    return out


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: hashes of the content of its blocks, on its two levels. shingles: distinct."""
    keys = []
    for level, blocks, spare in levels(len(shingles), percent):
        if not blocks:  # sets that differ in one element: one is the other without it
            content = mix(shingles + np.uint64(0x51ED270B))
            whole = content.sum(dtype=np.uint64)
            keys.append(mix(np.append(whole, whole - content) + mix(np.uint64(level) << np.uint64(32) | np.uint64(7))))
            continue
        block = (mix(shingles ^ np.uint64(level * 2 + 1)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        present, first = np.unique(block[order], return_index=True)
        content = np.add.reduceat(mix(shingles[order] + np.uint64(0x51ED270B)), first)
        tag = np.uint64(level) << np.uint64(32)
        keys.append(mix(content + mix(present.astype(np.uint64) + tag)))
        if blocks - len(present) > spare:  # two sets may then agree in empty blocks only
            empty = np.setdiff1d(np.arange(blocks), present).astype(np.uint64)
            keys.append(mix(mix(empty + tag) + np.uint64(99)))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def shingle_sets(texts, k: int) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield np.unique(shingle_hashes(words, k))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many of the distinct shingles fall into each of a power of two of groups; halves of it add up to a shorter one."""
    groups_ = LEAST
    while groups_ < MOST and groups_ * 12 < len(shingles):
        groups_ *= 2
    return np.bincount((mix(shingles) % np.uint64(groups_)).astype(np.int64), minlength=groups_).astype(np.uint16)


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors at the length of the shortest."""
    n = min(len(v) for v in vectors)
    return np.stack([v if len(v) == n else v.reshape(-1, n).sum(axis=0) for v in vectors]).astype(np.int32)


class CountTree:
    """A packed R-tree over count vectors: levels of upper corners (coordinate maxima) and smallest set sizes.

    An upper corner is all that an overlap bound needs: summed minima of a query and the corner are at least those
    of the query and any point below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:3] if len(points) > 1 else np.arange(1)
        self.order = np.lexsort((*[points[:, c] for c in spread], sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            corner, least = self.levels[-1]
            at = np.arange(0, len(corner), FANOUT)
            self.levels.append((np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(least, at)))

    def query(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices of points that may link with this one: the bound, not the sets, decides."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[at], point).sum(axis=1, dtype=np.int64)
            at = at[(100 + percent) * bound >= percent * (size + least[at])]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def may_link(points: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that span the components of the relation that the bound leaves."""
    parent = np.arange(len(points))
    tree = CountTree(points, sizes)
    out = []
    for i in range(len(points)):
        near = tree.query(points[i], sizes[i], percent)
        for c in np.unique(parent[near]).tolist():
            if c != parent[i]:
                out.append((i, int(near[parent[near] == c][0])))
                parent[parent == c] = parent[i]
    return out


def linked(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the sets; with left, of links between a left and another set only.

    A pair that is already connected is not verified again.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    points = folded([count_vector(s) for s in sets])
    tree = CountTree(points, sizes)
    parent = np.arange(len(sets))
    mark = np.zeros(len(vocabulary), bool)
    out = []
    for i in range(len(sets)):
        if left is not None and not left[i]:
            continue
        near = tree.query(points[i], sizes[i], percent)
        near = near[near > i] if left is None else near[~left[near]]
        near = near[parent[near] != parent[i]]
        if not len(near):
            continue
        mine = ids[edges[i] : edges[i + 1]]
        mark[mine] = True
        for j in near.tolist():
            if parent[j] == parent[i]:
                continue
            common = int(np.count_nonzero(mark[ids[edges[j] : edges[j + 1]]]))
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                parent[parent == parent[j]] = parent[i]
                out.append((i, j))
        mark[mine] = False
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, max_block: int = MAX_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that links reach.

    Two rows link when 100 * |A & B| >= percent * |A | B| over their sets of distinct k-word shingles (A-Z
    lower-cased, words of [^\\x20\\x09-\\x0D]+, by 64-bit hashes). Fewer than k words make one shingle of the whole;
    null or empty texts have no shingle and link with nothing. Rows with a null id keep a null component and link
    with nothing; rows that repeat an id link like any others. Of an empty table, no rows.
    """
    rows = keyed(docs, id_col, text=text_col)

    def sets_and_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, h1, h2, keys, counts = [], [], [], [], []
            for s in shingle_sets(batch["text"], k):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64).astype(np.int64)))
                keys.append(block_keys(s, percent))
                counts.append(count_vector(s).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "h1": h1, "h2": h2, "keys": keys, "counts": counts})

    schema = "doc_id long, n long, h1 long, h2 long, keys array<long>, counts binary"
    sets = materialize(rows.mapInPandas(sets_and_keys, schema), "jaccard-sets", "none")
    usable = sets.where(f"doc_id <> {NULL_ID} AND n > 0")
    classes = usable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = materialize(classes.drop("copies"), "jaccard-classes", "none")
    # the keys, most of what is held here, move once: of further copies only the ids go round, as long as they are few
    gone = materialize(usable.select("doc_id", "n", "h1", "h2").join(copies, ["n", "h1", "h2"]).where("doc_id <> class").select("doc_id", "h1", "h2").distinct(), "jaccard-copies", "none")
    alone = usable.join(broadcast_small(gone), ["doc_id", "h1", "h2"], "left_anti")
    exploded = alone.select(F.col("doc_id").alias("v"), F.explode("keys").alias("key"))
    # most keys are of one set, so sums before the shuffle would hold nearly all keys of a task and send twice the bytes;
    # in smaller parts than others, as each holds a row for each of its keys. A key comes once from each class at most
    dealt = exploded.repartition(FINER * partitions(docs.sparkSession), "key")
    # written before the join, so that the join alone is a stage and a frequent key can be split
    firsts = materialize(dealt.groupBy("key").agg(F.min("v").alias("u"), F.max("v").alias("most"), F.count(F.lit(1)).alias("members")).where("u <> most").drop("most"), "jaccard-firsts", "none")
    meeting = materialize(exploded.join(firsts, "key"), "jaccard-keys", "none")
    pruned = F.col("members") <= min(max_block, PRUNED)
    members = meeting.where(pruned).select("key", F.col("v").alias("doc_id")).distinct()
    many = meeting.where(~pruned & (F.col("u") != F.col("v"))).select("u", "v")
    vectors = alone.join(broadcast_small(materialize(members.select("doc_id").distinct(), "jaccard-members", "none")), "doc_id", "left_semi").select("doc_id", "n", "counts")
    shared = members.join(vectors, "doc_id").repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "doc_id")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u: list[int] = []
        v: list[int] = []
        for g in groups(batches, ["key"]):
            ids, sizes = g["doc_id"], g["n"].astype(np.int64)
            points = folded([np.frombuffer(c, np.uint16) for c in g["counts"]])
            if len(ids) == 2:
                bound = int(np.minimum(points[0], points[1]).sum())
                pairs = [(0, 1)] if (100 + percent) * bound >= percent * int(sizes.sum()) else []
            else:
                pairs = may_link(points, sizes, percent)
            u += [ids[a] for a, _ in pairs]
            v += [ids[b] for _, b in pairs]
            if len(u) >= 50_000:
                yield pd.DataFrame({"u": u, "v": v}).drop_duplicates()
                u, v = [], []
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)}).drop_duplicates()

    near = shared.mapInPandas(prune, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(many).distinct()
    subtree = materialize(connected_components(near, "jaccard-near"), "jaccard-subtrees", "none")
    links = verified_links(rows, subtree, k, percent, max_block)
    found = connected_components(links, "jaccard-links")
    named = (
        sets.select("doc_id", "n", "h1", "h2")
        .join(copies, ["n", "h1", "h2"], "left")
        .withColumn("class", F.when((F.col("n") > 0) & (F.col("doc_id") != NULL_ID), F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")))
        .join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    )
    known = F.when(F.col("doc_id") != NULL_ID, F.coalesce("component", "class"))
    return unkeyed(named.select("doc_id", F.col("n").alias("n_shingles"), known.alias("component_id")))


def verified_links(rows: DataFrame, subtree: DataFrame, k: int, percent: int, max_block: int = MAX_BLOCK) -> DataFrame:
    """Verified links (u, v) that span the components of each subtree (node, component) of rows (doc_id, text).

    subtree: a written table; component: its smallest node. Rows that repeat an id are sets of their own.
    """
    spark = rows.sparkSession
    keys = ["component", "i", "j"]
    nodes = broadcast_small(subtree)
    nodes = nodes.withColumnRenamed("node", "doc_id")
    rows = rows.where(F.col("doc_id") != NULL_ID)
    sizes = rows.select("doc_id", F.octet_length("text").alias("bytes")).join(nodes, "doc_id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / max_block, F.col("bytes") / MAX_BYTES)).cast("int")
    large = materialize(sizes.withColumn("blocks", blocks).where("blocks > 1").select("component", "blocks", "size"), "jaccard-large", "none")
    wanted = rows.join(nodes, "doc_id").join(broadcast_small(large), "component", "left").select("doc_id", "text", "component", "size", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["set"] = [s.tobytes() for s in shingle_sets(batch["text"], k)]
            yield batch.drop(columns="text")

    def dealt(plan: DataFrame) -> DataFrame:
        """(doc_id, component, left, set, i, j) of rows with tasks array<struct<i, j, left>>, the rows of a task together."""
        flat = plan.mapInPandas(to_sets, "doc_id long, component long, tasks array<struct<i:int,j:int,left:boolean>>, set binary")
        flat = flat.select("doc_id", "component", "set", F.explode("tasks").alias("t")).select("doc_id", "component", "set", "t.i", "t.j", "t.left")
        return flat.repartition(partitions(spark), *keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = [], []
        for g in groups(batches, keys):
            left = g["left"].astype(bool)
            if not left.any():
                continue
            left = None if left.all() else left
            for a, b in linked([np.frombuffer(s, np.uint64) for s in g["set"]], percent, left):
                u.append(min(g["doc_id"][a], g["doc_id"][b]))
                v.append(max(g["doc_id"][a], g["doc_id"][b]))
            if len(u) >= 10_000:
                yield pd.DataFrame({"u": u, "v": v})
                u, v = [], []
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row of a block beside the block's copy of the smallest id's set, which comes first."""
        task, first, size = None, np.empty(0, np.uint64), 0
        for batch in batches:
            links = []
            for doc_id, component, i, raw in zip(batch["doc_id"], batch["component"], batch["i"], batch["set"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                if (component, i) != task:
                    task, first, size = (component, i), s, len(s)
                common = len(np.intersect1d(first, s, assume_unique=True))
                links.append(100 * common >= percent * (size + len(s) - common))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "component": batch["component"], "near": links})

    def task(i, j, left):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"))

    yes, no = F.lit(True), F.lit(False)
    zero = F.lit(0)
    small = wanted.where("blocks = 1").select("doc_id", "text", "component", F.array(task(zero, zero, yes)).alias("tasks"))
    links = dealt(small).sortWithinPartitions(*keys, "doc_id").mapInPandas(compare, "u long, v long")
    if large.isEmpty():
        return links
    of_large = wanted.where("blocks > 1")
    every = F.sequence(zero, F.col("blocks") - 1)
    here = F.when(F.col("doc_id") == F.col("component"), F.transform(every, lambda b: task(b, zero, yes))).otherwise(F.array(task(own, zero, no)))
    held = dealt(of_large.select("doc_id", "text", "component", here.alias("tasks"))).sortWithinPartitions(*keys, F.col("left").desc(), "set")
    held = materialize(held.mapInPandas(hold, "doc_id long, component long, near boolean"), "jaccard-held", "none")
    links = links.union(held.where("near AND doc_id <> component").select(F.col("component").alias("u"), F.col("doc_id").alias("v")))
    apart = materialize(held.where("NOT near").select("doc_id", "component").distinct(), "jaccard-apart", "none")
    if apart.isEmpty():
        return links
    apart_sizes = broadcast_small(materialize(apart.groupBy("component").agg(F.count(F.lit(1)).alias("n_apart")), "jaccard-apart-sizes", "none"))
    rest = of_large.join(apart_sizes, "component").join(broadcast_small(apart.withColumn("apart", yes)), ["component", "doc_id"], "left")
    parts = F.ceil(F.col("blocks") * F.col("n_apart") / F.col("size")).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(1)), parts).cast("int")
    as_right = F.transform(F.sequence(zero, parts - 1), lambda p: task(p, own, no))
    as_left = F.when(F.col("apart"), F.transform(every, lambda b: task(mine, b, yes))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    plan = rest.select("doc_id", "text", "component", F.concat(as_left, as_right).alias("tasks"))
    return links.union(dealt(plan).sortWithinPartitions(*keys, "doc_id").mapInPandas(compare, "u long, v long"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that link to a document of a smaller id: of each component, the smallest id stays.

    Rows with a null id or without words all stay; of rows that repeat an id, all or none.
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    gone = broadcast_small(materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone", "none"))
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
