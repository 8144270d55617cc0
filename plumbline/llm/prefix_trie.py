"""Prefix trie of conversations: what their first turns have in common, and what keeping it once would save.

A turn is its role and text. Every prefix of a conversation has a 128-bit digest, a running combination of the digests of
its turns and their places, so texts never move after the first step. Equal prefixes are put together before anything is
gathered: copies of a conversation, however many, make one row a prefix. Those rows are partitioned by the digest of the
first turn, and a trie of pointers (dictionaries of digests) is built for each part inside applyInPandas and walked in
postorder without recursion. A first turn with more than MOST_NODES prefixes below it is partitioned again by the next
turn at which it branches, and again until each part fits; the prefixes above such a branch get what the parts below them
came to. Conversations that end at a prefix are digested in order, in blocks of ids joined beforehand.

Handling: rows without a conv_id belong to no conversation and are left out; null role or text is empty; null turns come
first; turns of the same number are ordered by their digest, and repeated rows are turns of their own. Without any
conversation there is no node. Further columns are not read, whatever their names. A part with no branch for more than
MOST_NODES turns (one conversation of that length) is cut every MOST_NODES turns. The turns of one conversation are
numbered by a window that sorts and spills, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, broadcast_small, materialize, partitions, pick, release

#: Prefixes of which a task builds tries at a time, about.
MOST_NODES = 50_000
#: Ids joined to one text before they move: those that agree but for so many low bits.
BLOCK_BITS = 12
#: Turns that a branch may take from the conversation it branches from.
LONGEST_HEAD = 8

_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "bytes", "ga", "gb", "up"]
_TRIE = "a long, b long, pa long, pb long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, n (place of the turn, from 1), key (digest of role and text) and bytes (of the text), written once."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = (
        pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
        .where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return materialize(rows.select("conv_id", F.row_number().over(order).cast("long").alias("n"), "key", "bytes"), "turns")


def plain(turns: DataFrame) -> DataFrame:
    """Every conversation as it is: rows (conv_id, place, key, bytes), with one of place 0 for each conversation."""
    return turns.select("conv_id", F.col("n").alias("place"), "key", "bytes").union(_starts(turns))


def branched(turns: DataFrame, every: int = 5) -> DataFrame:
    """Every conversation c as a branch: the first h turns of conversation c - c % every, then its own after its first h.

    h is crc32 of the decimal id, modulo LONGEST_HEAD + 1. A conversation has a row n = 1, so no list of ids is gathered.
    """
    head = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % (LONGEST_HEAD + 1)
    own = turns.where("n = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), head("conv_id").alias("h"))
    bases = turns.where((F.col("n") <= LONGEST_HEAD) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    heads = own.join(bases, "base").where("n <= h").select("conv_id", F.col("n").alias("place"), "key", "bytes")
    tails = turns.where(F.col("n") > head("conv_id")).select("conv_id", (F.col("n") + LONGEST_HEAD).alias("place"), "key", "bytes")
    return heads.union(tails).union(_starts(turns))


def _starts(turns: DataFrame) -> DataFrame:
    return turns.where("n = 1").select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("bytes"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Each prefix of each conversation: its digest (a, b), its parent's (pa, pb), that of its first turn (ga, gb), depth, bytes of its last turn, and whether the conversation ends there."""
    order = Window.partitionBy("conv_id").orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("depth", (F.row_number().over(order) - 1).cast("long"))
    lane = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "key")).otherwise(F.lit(0).cast("long"))
    lanes = numbered.withColumns({"x": lane(1), "y": lane(2)})
    first = lambda c: F.max(F.when(F.col("depth") == 1, F.col(c))).over(so_far)
    made = lanes.select(
        "conv_id", "depth", "bytes", "x", "y",
        F.bit_xor("x").over(so_far).alias("a"), F.bit_xor("y").over(so_far).alias("b"),
        first("x").alias("ga"), first("y").alias("gb"), F.lead("place").over(order).isNull().alias("ends"),
    )
    return made.select("conv_id", "depth", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "ga", "gb", "ends")


def _build(part: pd.DataFrame) -> pd.DataFrame:
    """The tries of some parts: pointers by digest, children by pointer, then a walk in postorder with a stack of its own.

    xc, xl, xs: children, leaves and savings that a prefix has below it in parts of their own.
    """
    part = part.sort_values("depth", kind="stable")
    pointer = {key: p for p, key in enumerate(zip(part["a"].tolist(), part["b"].tolist(), strict=True))}
    parent = [pointer.get(key, -1) for key in zip(part["pa"].tolist(), part["pb"].tolist(), strict=True)]
    children: list[list[int]] = [[] for _ in parent]
    tops = []
    for p, above in enumerate(parent):
        (children[above] if above >= 0 else tops).append(p)
    conv, up, below, leaves, saved = (part[c].tolist() for c in ("conv_id", "up", "xc", "xl", "xs"))
    own = ((part["n_convs"] - 1) * part["bytes"]).tolist()
    for top in tops:
        stack = [(top, False)]
        while stack:
            p, done = stack.pop()
            if not done:
                stack.append((p, True))
                stack.extend((c, False) for c in children[p])
                continue
            below[p] += len(children[p])
            leaves[p] = leaves[p] + sum(leaves[c] for c in children[p]) if below[p] else 1
            saved[p] += own[p] + sum(saved[c] for c in children[p])
    above = [conv[q] if q >= 0 else u for q, u in zip(parent, up, strict=True)]
    found = part[["a", "b", "pa", "pb", "conv_id", "depth"]].assign(parent_conv_id=above, n_convs=part["n_convs"], n_children=below, n_leaves=leaves, saved_tokens=saved)
    return found.assign(top=[q < 0 for q in parent])


def _tries(nodes: DataFrame, rows: int) -> DataFrame:
    """Results of nodes whose parts fit: several parts to a bucket, by the hash of their group, about MOST_NODES a bucket."""
    buckets = max(partitions(nodes.sparkSession), 2 * rows // MOST_NODES + 1)
    bucket = F.pmod(F.xxhash64("ga", "gb"), F.lit(buckets))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in nodes.columns else F.lit(0).cast("long") for c in ("xc", "xl", "xs")}
    return nodes.withColumns({"bucket": bucket, **zero}).groupBy("bucket").applyInPandas(_build, _TRIE)


def _split(pending: DataFrame, chained: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parts in `over` cut where they branch first: what lies above the cuts, and what lies below by its new part."""
    big = pending.join(over.select("ga", "gb", "least_depth"), ["ga", "gb"])
    levels = materialize(big.groupBy("ga", "gb", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("above"), F.min("least_depth").alias("k")), "levels")
    cuts = levels.groupBy("ga", "gb").agg(F.least(F.min(F.when(F.col("n") > 1, F.col("depth"))), F.min("k") + MOST_NODES).alias("cut"))
    cuts = materialize(cuts.join(levels.select("ga", "gb", (F.col("depth") + 1).alias("cut"), "above"), ["ga", "gb", "cut"]), "cuts")
    small = broadcast_small(cuts)
    met = pending.join(small, ["ga", "gb"])
    spine = materialize(met.where("depth < cut").select(*_NODE), "spine")
    deep = chained.join(broadcast_small(cuts.select("cut").distinct()), F.col("depth") == F.col("cut"), "left_semi").select("conv_id", F.col("depth").alias("cut"), F.col("a").alias("na"), F.col("b").alias("nb"))
    rest = met.where("depth >= cut").join(deep, ["conv_id", "cut"])
    parts = {"ga": F.col("na"), "gb": F.col("nb"), "up": F.when(F.col("depth") == F.col("cut"), F.col("above")).otherwise(F.lit(NULL_ID))}
    rest = materialize(rest.withColumns(parts).select(*_NODE), "rest")
    release(levels, cuts)
    return spine, rest


def _endings(chained: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the digest of the ids of the conversations that end at a prefix, ascending."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = chained.where("ends").groupBy("a", "b", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(joined.alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, so_far = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ids"], strict=True):
                if last == (a, b):
                    so_far.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, so_far.hexdigest()))
                last, so_far = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(*last, so_far.hexdigest())], columns=["a", "b", "ends_sha256"])

    return blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInPandas(digest, "a long, b long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row for each prefix of the conversations in rows (conv_id, place, key, bytes; one of place 0 for each of them).

    conv_id and parent_conv_id are the smallest ids of the conversations that begin with the prefix and its parent;
    n_leaves counts prefixes below (itself included) that nothing follows; saved_tokens sums bytes over them.
    """
    chained = materialize(prefixes(rows), "prefixes")
    of_all = chained.where("depth = 0").agg(F.count(F.lit(1)), F.min("conv_id")).first()
    total, smallest = of_all[0], NULL_ID if of_all[1] is None else of_all[1]
    made = {c: F.max(c).alias(c) for c in ("pa", "pb", "depth", "bytes", "ga", "gb")}
    nodes = chained.where("depth > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *made.values())
    pending = materialize(nodes.withColumn("up", F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.lit(NULL_ID))).select(*_NODE), "nodes")
    fitting, spines = [], []
    while True:
        sizes = pending.groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("nodes"), F.min("depth").alias("least_depth"))
        over = materialize(sizes.where(F.col("nodes") > MOST_NODES), "oversized")
        if over.isEmpty():
            fitting.append(pending)
            break
        over = broadcast_small(over)
        fitting.append(pending.join(over, ["ga", "gb"], "left_anti"))
        spine, pending = _split(pending, chained, over)
        spines.append(spine)
    whole = fitting[0]
    for more in fitting[1:]:
        whole = whole.unionByName(more)
    found = materialize(_tries(whole.select(*_NODE), whole.count()), "tries")
    for spine in reversed(spines):
        below = found.where("top").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("xc"), F.sum("n_leaves").alias("xl"), F.sum("saved_tokens").alias("xs"))
        upper = materialize(_tries(spine.join(below, ["a", "b"], "left"), spine.count()), "tries")
        found = found.unionByName(upper)
    below = found.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = below.where(F.lit(total > 0)).select(zero.alias("a"), zero.alias("b"), F.lit(smallest).alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    every = found.select(*root.columns).unionByName(root)
    ends: Column = F.coalesce(F.col("ends_sha256"), F.lit(_EMPTY)).alias("ends_sha256")
    return every.join(_endings(chained), ["a", "b"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
