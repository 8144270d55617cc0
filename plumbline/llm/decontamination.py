"""Benchmark decontamination: greedy string tiling of documents with test items.

Runs of k tokens are seeds. Those of the documents that pass a Bloom filter of the items' seeds are joined with them by
Spark. For each pair that shares enough seeds, running Karp-Rabin finds the longest common runs of
unmarked tokens, which are marked as tiles until none of k tokens is left; the share of the item's tokens that tiles
cover catches passages whose parts were moved about.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup
from plumbline.llm.common import NULL_ID, broadcast_small, groups, keyed, materialize, mix, partitions, pick, shingle_hashes, unkeyed, word_hashes

#: Tokens of the shortest tile, share of an item's tokens at which a document is contaminated.
SEED, COVERAGE = 5, 0.6
#: Pairs of equal windows that are looked at together.
PAIRS = 1 << 20
SCHEMA = "doc_id long, item_id long, coverage double, item_tokens int, tiles array<struct<item_start:int,doc_start:int,length:int>>"


def _windows(prefix: np.ndarray, power: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the windows of s free tokens."""
    n = len(free) - s + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[s:] == taken[:-s])
    return at, prefix[at + s] - prefix[at] * power[s]


def _prefix(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.ones(len(tokens) + 1, np.uint64)
    prefix = np.zeros(len(tokens) + 1, np.uint64)
    for i, t in enumerate(tokens):
        power[i + 1] = power[i] * base
        prefix[i + 1] = prefix[i] * base + t
    return prefix, power


def _starts(item, doc, free_i, free_d, at_i, h_i, at_d, h_d) -> Iterator[tuple[int, int]]:
    """Places (i, j) of equal windows that no free equal tokens precede: one for each run of matches on a diagonal."""
    order = np.argsort(h_i, kind="stable")
    low, high = (np.searchsorted(h_i[order], h_d, side=side) for side in ("left", "right"))
    n = high - low
    edges = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + PAIRS, side="right")) - 1)
        part = n[a:b]
        place = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        i, j = at_i[order[np.repeat(low[a:b], part) + place]], np.repeat(at_d[a:b], part)
        inner = (i > 0) & (j > 0) & free_i[i - 1] & free_d[j - 1] & (item[i - 1] == doc[j - 1])
        yield from zip(i[~inner].tolist(), j[~inner].tolist(), strict=True)
        a = b


def tiling(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling (Wise, 1993): (start in item, start in doc, length) of the tiles of at least `least` tokens."""
    with np.errstate(over="ignore"):
        (p_item, power_i), (p_doc, power_d) = _prefix(item), _prefix(doc)
        free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
        tiles = []
        s = max(least, min(len(item), len(doc), 20))
        while s >= least:
            at_i, h_i = _windows(p_item, power_i, free_i, s)
            at_d, h_d = _windows(p_doc, power_d, free_d, s)
            found, longest = [], 0
            for i, j in _starts(item, doc, free_i, free_d, at_i, h_i, at_d, h_d):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= s:
                    found.append((n, i, j))
                    longest = max(longest, n)
            if longest > 2 * s:
                s = longest
                continue
            # the longest first, of equally long ones that which begins first in the item, then in the document; what
            # tiles leave of a match is a match of its own length
            queue = [(-n, i, j) for n, i, j in found]
            heapq.heapify(queue)
            while queue:
                n, i, j = heapq.heappop(queue)
                both = free_i[i : i - n] & free_d[j : j - n]
                if both.all():
                    free_i[i : i - n] = False
                    free_d[j : j - n] = False
                    tiles.append((i, j, -n))
                    continue
                for a, b in np.flatnonzero(np.diff(np.concatenate([[False], both, [False]]).astype(np.int8))).reshape(-1, 2).tolist():
                    if b - a >= s:
                        heapq.heappush(queue, (a - b, i + a, j + a))
            if s == least:
                break
            s = max(least, s // 2)
        return tiles


def tiles_of(item: np.ndarray, runs: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """Tiles of an item in a document of which runs (place, tokens) hold all seeds of k tokens that may be the item's.

    Every tile lies on shared seeds, so runs are cut to the tokens of seeds that are the item's, with a break between them.
    """
    own = np.unique(shingle_hashes(item, k))
    parts, where, breaks = [], [], 0
    for at, words in runs:
        inside = np.zeros(len(words) + 1, bool)
        for j in np.flatnonzero(np.isin(shingle_hashes(words, k), own)).tolist():
            inside[j : j + k] = True
        for a, b in np.flatnonzero(np.diff(np.concatenate([[False], inside])) != 0).reshape(-1, 2):
            parts += [words[a:b], np.array([breaks], np.uint64)]
            where += [np.arange(at + a, at + b), [-1]]
            breaks += 1
    if not parts:
        return []
    place = np.concatenate(where)
    return sorted((i, int(place[j]), n) for i, j, n in tiling(item, np.concatenate(parts), k))


def _seeds(words: np.ndarray, k: int) -> np.ndarray:
    """Seeds of k tokens, one for each place, with k in the hash; none where there are fewer tokens."""
    if len(words) < k:
        return np.empty(0, np.int64)
    return mix(shingle_hashes(words, k) + np.uint64(k)).view(np.int64)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, item_tokens, tiles) for each row and item whose tiles cover enough of the item.

    Tokens are runs without white space or ASCII punctuation, A-Z lower-cased; tiles have at least `seed` tokens (an
    item of fewer: all of its tokens). Items without tokens match nothing, nor do null or empty documents. Rows and
    items with null ids are searched like others; repeated ones give a row each. Of equally long matches, that which
    begins first in the item, then in the document, becomes a tile. Very long texts are searched whole, by their shared
    runs. Empty tables give no rows. Further columns are not read.

    Documents are read once. Where they are read, a Bloom filter of the items' seeds (of bounded size, whatever the number
    of items) leaves the runs of tokens that may be shared; their seeds are joined with those of the items. Pairs with too
    few shared seeds to cover the item go before the runs are brought together with the item and tiled.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    tests = pick(items, item_id=item_id_col, text=item_text_col).where("text IS NOT NULL").withColumn("item", F.monotonically_increasing_id())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = list(word_hashes(batch["text"], punctuation=False))
            yield pd.DataFrame({"item": batch["item"], "n": [len(w) for w in words], "k": [min(seed, len(w)) for w in words], "words": [w.tobytes() for w in words]})

    ids = materialize(tests.select("item", F.col("item_id").cast("long"), "text"), "contamination-texts")
    tokens = materialize(ids.select("item", "text").mapInPandas(split, "item long, n int, k int, words binary").where("n > 0"), "contamination-items")

    def seeds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(_seeds(np.frombuffer(w, np.uint64), k)) for w, k in zip(batch["words"], batch["k"], strict=True)]
            n = [len(f) for f in found]
            yield pd.DataFrame({"seed": np.concatenate([np.empty(0, np.int64), *found]), **{c: np.repeat(batch[c].to_numpy(), n) for c in ("item", "k", "n")}})

    seeds = materialize(tokens.mapInPandas(seeds_of, "seed long, item long, k int, n int"), "contamination-seeds")
    bits, shared = exact_dedup.seen_filter(seeds.select("seed"), seeds.count())
    lengths = sorted(r[0] for r in tokens.select("k").distinct().collect())  # seed of them at most

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, words in zip(batch["row"], batch["doc_id"], word_hashes(batch["text"], punctuation=False), strict=True):
                for k in lengths:
                    mine = _seeds(words, k)
                    if not len(mine):
                        continue
                    hit = np.concatenate([[False], exact_dedup.passes(shared.value, bits, mine), [False]])
                    for a, b in np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2).tolist():
                        out.append((row, doc_id, k, a, words[a : b + k - 1].tobytes()))
            yield pd.DataFrame(out, columns=["row", "doc_id", "k", "at", "words"])

    runs = materialize(rows.mapInPandas(search, "row long, doc_id long, k int, at int, words binary"), "contamination-runs")

    def run_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_seeds(np.frombuffer(w, np.uint64), k) for w, k in zip(batch["words"], batch["k"], strict=True)]
            yield pd.DataFrame({"seed": np.concatenate([np.empty(0, np.int64), *found]), "row": np.repeat(batch["row"].to_numpy(), [len(f) for f in found])})

    # of a repeated seed in a document one row, with its count
    met = runs.mapInPandas(run_seeds, "seed long, row long").groupBy("row", "seed").agg(F.count(F.lit(1)).alias("times"))
    pairs = met.join(broadcast_small(seeds), "seed").groupBy("row", "item", "k", "n").agg(F.sum("times").alias("places"))
    # tiles lie on shared seeds, each of which covers k tokens
    pairs = materialize(pairs.where(F.col("places") * F.col("k") >= F.col("n") * coverage).select("row", "item", "k"), "contamination-pairs")
    few = broadcast_small(pairs)
    of_items = pairs.join(broadcast_small(tokens.select("item", "words"), words=1), "item").select("row", "item", "k", F.lit(NULL_ID).alias("doc_id"), F.lit(-1).alias("at"), "words")
    of_docs = runs.join(few, ["row", "k"]).select("row", "item", "k", "doc_id", "at", "words")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["row", "item"]):
            item = np.frombuffer(g["words"][0], np.uint64)  # at -1, before the runs
            found = tiles_of(item, [(int(a), np.frombuffer(w, np.uint64)) for a, w in zip(g["at"][1:], g["words"][1:], strict=True)], int(g["k"][0]))
            share = sum(n for _, _, n in found) / len(item)
            if share >= coverage:
                yield pd.DataFrame({"doc_id": [int(g["doc_id"][1])], "item": [int(g["item"][0])], "coverage": [share], "item_tokens": [len(item)], "tiles": [[{"item_start": a, "doc_start": b, "length": c} for a, b, c in found]]})

    schema = SCHEMA.replace("item_id long", "item long")
    both = of_items.union(of_docs).repartition(partitions(spark), "row", "item").sortWithinPartitions("row", "item", "at")
    found = both.mapInPandas(tile, schema).join(broadcast_small(ids.select("item", "item_id")), "item")
    return unkeyed(found.select("doc_id", "item_id", "coverage", "item_tokens", "tiles"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose text is contaminated, whatever their ids (id_col is not read); columns stay as they are.

    What is joined are 64-bit hashes of the contaminated texts, so the texts stay where they are as long as that list
    is small.
    """
    texts = docs.select(F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    gone = contaminated(texts, items, "version", "text", **how).select(F.col("doc_id").alias("version")).distinct()
    gone = broadcast_small(materialize(gone, "contaminated-texts"))
    return docs.join(gone, F.xxhash64(docs[text_col]) == gone["version"], "left_anti")
