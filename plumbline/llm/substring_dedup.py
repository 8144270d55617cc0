"""Substring dedup: collinear chaining of shared k-mer seeds, aligned to find exact and fuzzy repeated passages.

Seeds are the minimizers of runs of K words. Each occurrence of a seed is joined with the first one in the corpus
(smallest doc_id, then position), so a passage of many documents gives as many matches as it has occurrences, not
their square. The first of a chunk of documents is found where they are read, so that of a frequent seed one row for
each chunk meets in a task. Per document and earlier document, runs of matches on a diagonal become segments, and
a tree over the ends in the earlier one chains ordered segments with gap costs. The words around chains of two seeds
and more are fetched and aligned, if need be along finer seeds among them; stretches of at least `min_words` words and
`identity` are the result. Where all seeds of a stretch occur earlier,
whichever documents came first with each, and no passage covers it, every run of `min_words` words in it is hashed and
joined with its own first occurrence: a document that holds the run whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.common import NULL_ID, broadcast_small, give_back, groups, keyed, materialize, mix, partitions, shingle_hashes, word_hashes

#: Words of a seed, k-mers of which the least is a seed, words of a passage, share of equal words.
K, SPAN, MIN_WORDS, IDENTITY = 5, 8, 50, 0.8
#: Words that a chain may skip, cost of each, words fetched on each side of a chain.
MAX_GAP, GAP_COST, MARGIN = 64, 0.04, 50
#: Words of the finer seeds between fetched words, and how often one may occur there.
FINE, FINE_OFTEN = 2, 4
#: A seed's place is PLACE * its word + the words since the seed before it (SPAN at most).
PLACE = 16
#: Seeds of documents that are read together.
CHUNK = 1 << 18
#: Chains in one request to a document.
REQUEST = 2000
SCHEMA = "doc_id long, start int, end int, ref_doc_id long, ref_start int, ref_end int, identity double, version long"


def _of_runs(h: np.ndarray, n: int, take) -> np.ndarray:
    """take (minimum or maximum) over each run of n values, by doubling."""
    m = 1
    while m < n:
        step = min(m, n - m)
        h = take(h[:-step], h[step:])
        m += step
    return h


def minimizers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the k-mers that are least in some run of SPAN; of all, where there are fewer."""
    if len(words) < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = mix(shingle_hashes(words, K))
    if len(h) <= SPAN:
        at = np.array([int(np.argmin(h))])
    else:
        # a k-mer is the least of a run that it lies in, if the greatest of these runs' minima is its own hash
        least = _of_runs(h, SPAN, np.minimum)
        edge = np.zeros(SPAN - 1, np.uint64)
        at = np.flatnonzero(_of_runs(np.concatenate([edge, least, edge]), SPAN, np.maximum) == h)
    return h[at], at


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by doubling; none of fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h, m = mix(words + np.uint64(n)), 1
    while m < n:
        step = min(m, n - m)
        h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        m += step
    return h


def shared_areas(at: np.ndarray, gap: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) outside of which no run of min_words words has shared seeds only.

    at: places of a document's shared seeds in order; gap: words since the seed before it, shared or not (0: none).
    """
    before = at - gap
    a = np.where((gap > 0) & np.isin(before, at), before, at)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(at[order])
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    a, b = np.maximum(a[first] - (SPAN - 1), 0), b[np.append(first[1:], len(b)) - 1] + K + SPAN - 1
    return [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y - x >= min_words]


def uncovered(areas: list[tuple[int, int]], spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Ranges of the runs of min_words words in areas that have a word outside of all spans."""
    if not len(spans):
        return areas
    out = []
    for a, b in areas:
        free = np.ones(b - a, bool)
        for x, y in spans:
            free[max(x - a, 0) : max(y - a, 0)] = False
        count = np.concatenate([[0], np.cumsum(free)])
        starts = np.flatnonzero(count[min_words:] > count[: len(count) - min_words])
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            if len(part):
                out.append((a + int(part[0]), a + int(part[-1]) + min_words))
    return out


def covering(at: np.ndarray, n: int) -> list[int]:
    """Indices of some runs of n words from the places at (in order) on, which together hold every word of all of them."""
    out, i = [], 0
    while i < len(at):
        out.append(i)
        j = int(np.searchsorted(at, at[i] + n, side="right")) - 1
        i = j if at[j] > at[i] else j + 1
    return out


class Maxima:
    """Maxima of (score, item) over ranges of n places, under updates: a binary tree in an array."""

    NONE = (-1e18, -1)

    def __init__(self, n: int):
        self.size = max(1, n)
        self.best = [self.NONE] * (2 * self.size)

    def put(self, i: int, value: tuple[float, int]) -> None:
        """Raise place i to value."""
        i += self.size
        while i and self.best[i] < value:
            self.best[i] = value
            i //= 2

    def clear(self, i: int) -> None:
        """Place i holds nothing any more."""
        i += self.size
        self.best[i] = self.NONE
        while i := i // 2:
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def between(self, i: int, j: int) -> tuple[float, int]:
        """The greatest value of places i to j, j excluded."""
        out = self.NONE
        i, j = i + self.size, j + self.size
        while i < j:
            if i & 1:
                out = max(out, self.best[i])
                i += 1
            if j & 1:
                j -= 1
                out = max(out, self.best[j])
            i, j = i // 2, j // 2
        return out

    def upto(self, i: int) -> tuple[float, int]:
        return self.between(0, i)


#: The name that the tests of prefix maxima know.
Fenwick = Maxima


def segments(p: np.ndarray, r: np.ndarray, k: int | None = None) -> np.ndarray:
    """Rows (start, end, ref start, ref end) of runs of matches of k (K) words on one diagonal with gaps of at most MAX_GAP."""
    k = k or K
    order = np.lexsort((p, p - r))
    p, r = p[order], r[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p - r) != 0) | (np.diff(p) > MAX_GAP)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    out = np.column_stack([p[first], p[last] + k, r[first], r[last] + k])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def chains(seg: np.ndarray) -> list[np.ndarray]:
    """Chains of segments in order in both texts, best first, each segment in one of them.

    The score of a chain is its words less GAP_COST for each word skipped in either text.
    """
    if len(seg) == 1:
        return [seg]
    by_ref = np.argsort(seg[:, 3], kind="stable")
    ends = seg[by_ref, 3]
    place = np.empty(len(seg), np.int64)
    place[by_ref] = np.arange(len(seg))
    tree = Maxima(len(seg))
    by_end = np.argsort(seg[:, 1], kind="stable")
    score, before, done, gone = [0.0] * len(seg), [-1] * len(seg), 0, 0
    # only segments that end at most MAX_GAP before this one in both texts can come before it
    low, high = np.searchsorted(ends, seg[:, 2] - MAX_GAP), np.searchsorted(ends, seg[:, 2], side="right")
    for i, (a, b, c, _) in enumerate(seg.tolist()):
        while done < len(seg) and seg[by_end[done], 1] <= a:
            j = int(by_end[done])
            tree.put(int(place[j]), (score[j] + GAP_COST * float(seg[j, 1] + seg[j, 3]), j))
            done += 1
        while gone < done and seg[by_end[gone], 1] < a - MAX_GAP:
            tree.clear(int(place[by_end[gone]]))
            gone += 1
        best, j = tree.between(int(low[i]), int(high[i]))
        best -= GAP_COST * (a + c)
        score[i] = float(b - a)
        if j >= 0 and best > 0:
            score[i] += best
            before[i] = j
    used, out = [False] * len(seg), []
    for i in sorted(range(len(seg)), key=lambda i: (-score[i], i)):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(seg[own[::-1]])
    return out


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, v = (1 << len(x)) - 1, (1 << len(x)) - 1
    for w in y.tolist():
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(x) - v.bit_count()


def longest(equal: np.ndarray, least: int, identity: float) -> tuple[int, int] | None:
    """The longest [a, b) of at least `least` columns and `identity` that begins and ends with equal ones, or nothing."""
    total = np.concatenate([[0.0], np.cumsum(equal - identity)])
    starts = np.flatnonzero(equal)
    ends = starts + 1
    if not len(starts):
        return None
    # only a start with a smaller total than all before it can be that of the longest stretch to some end
    low = np.minimum.accumulate(total[starts])
    lows = np.flatnonzero(np.append(True, total[starts][1:] < low[:-1]))
    firsts = starts[lows]
    # totals at these starts fall, so the first of at most an end's total is found by bisection
    at = np.searchsorted(-total[firsts], -(total[ends] + 1e-9), side="left")
    known = at < len(firsts)
    sizes = np.where(known, ends - firsts[np.minimum(at, len(firsts) - 1)], 0)
    best = int(np.argmax(sizes))
    return (int(ends[best] - sizes[best]), int(ends[best])) if sizes[best] >= least else None


def stretches(equal: np.ndarray, least: int, identity: float = IDENTITY) -> Iterator[tuple[int, int]]:
    """Disjoint [a, b) of at least `least` columns and `identity`.

    Those with the greatest sums of +1 for an equal and -3 for another column, which end where equality ends; where the
    greatest is too short (changed words near its ends cut it), the longest stretch of that identity.
    """
    todo = [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        total = np.concatenate([[0], np.cumsum(np.where(equal[a:b], 1, -3))])
        low = np.minimum.accumulate(total)
        j = int(np.argmax(total - low))
        i = int(np.flatnonzero(total[: j + 1] == low[j])[-1])
        if j - i < least or equal[a + i : a + j].mean() < identity:
            found = longest(equal[a:b], least, identity)
            if found is None:
                continue
            i, j = found
        yield a + i, a + j
        todo += [(a, a + i), (a + j, b)]


def align(chain: np.ndarray, x: np.ndarray, x_at: int, y: np.ndarray, y_at: int, min_words: int, identity: float) -> Iterator[tuple]:
    """Passages (start, end, ref start, ref end, identity) along a chain; x and y: words from x_at and y_at on.

    Segments are compared word by word on their diagonals, gaps by their longest common subsequence; the first and
    the last diagonal go on into the margins.
    """
    seg = chain.copy()
    back = min(seg[0, 0] - x_at, seg[0, 2] - y_at)
    seg[0, [0, 2]] -= back
    on = min(x_at + len(x) - seg[-1, 1], y_at + len(y) - seg[-1, 3])
    seg[-1, [1, 3]] += on
    columns = []
    for n, (a, b, c, d) in enumerate(seg.tolist()):
        if n:
            a0, c0 = seg[n - 1, 1], seg[n - 1, 3]
            g, h = a - a0, c - c0
            if size := max(g, h):
                i = np.arange(size)
                same = common_words(x[a0 - x_at : a - x_at], y[c0 - y_at : c - y_at]) if g and h else 0
                columns.append((a0 + np.minimum(i, g), c0 + np.minimum(i, h), i < same))
        columns.append((np.arange(a, b), np.arange(c, d), x[a - x_at : b - x_at] == y[c - y_at : d - y_at]))
    p, r, equal = (np.concatenate([c[i] for c in columns]) for i in range(3))
    for i, j in stretches(equal, min_words, identity):
        share = float(equal[i:j].mean())
        if share >= identity and p[j - 1] + 1 - p[i] >= min_words:
            yield int(p[i]), int(p[j - 1]) + 1, int(r[i]), int(r[j - 1]) + 1, share


def finer(x: np.ndarray, x_at: int, y: np.ndarray, y_at: int, least: int) -> Iterator[np.ndarray]:
    """Chains of at least `least` words along the runs of FINE words that x and y share; none where they share too few words."""
    if len(np.intersect1d(x, y)) < least // 2 or np.isin(x, y).sum() < least:
        return
    hx, hy = (shingle_hashes(w.astype(np.uint64), FINE) for w in (x, y))
    values, ix = np.unique(hx, return_inverse=True)
    often = np.bincount(ix)
    order = np.argsort(hy, kind="stable")
    low, high = np.searchsorted(hy[order], values), np.searchsorted(hy[order], values, side="right")
    good = (often <= FINE_OFTEN) & (high - low <= FINE_OFTEN) & (high > low)
    p = np.flatnonzero(good[ix])
    n = (high - low)[ix[p]]
    if not len(p):
        return
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    r = order[np.repeat(low[ix[p]], n) + place]
    for c in chains(segments(np.repeat(p, n) + x_at, r + y_at, FINE)):
        if c[-1, 1] - c[0, 0] >= least // 2:
            yield c


def of_several(found: DataFrame, key: str) -> DataFrame:
    """The rows (key, doc_id, at, ...) whose key several documents hold, with the smallest of these as ref."""
    least = materialize(found.groupBy(key).agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("most")).where("ref <> most").drop("most"), "passage-least")
    return found.join(broadcast_small(least), key)


def with_first(shared: DataFrame, key: str) -> DataFrame:
    """(doc_id, ref, at, ref_at) of the rows of of_several() outside ref; ref_at: the first place of the key there."""
    first = shared.where("doc_id = ref").groupBy(key).agg(F.min("at").alias("ref_at"))
    return shared.where("doc_id <> ref").join(first, key).select("doc_id", "ref", "at", "ref_at")


def aligned(rows: DataFrame, matches: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Passages (SCHEMA) along the chains of matches (doc_id, ref, at, ref_at), each of K words, of rows (doc_id, text)."""
    spark = rows.sparkSession

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        doc, n = None, 0
        for g in groups(batches, ["doc_id", "ref"]):
            doc_id, ref = int(g["doc_id"][0]), int(g["ref"][0])
            n = n if doc_id == doc else 0
            doc = doc_id
            if len(g["at"]) < 2:
                continue
            for c in chains(segments(g["at"].astype(np.int64), g["ref_at"].astype(np.int64))):
                if len(c) > 1 or c[0, 1] - c[0, 0] > K:
                    out.append((doc_id, n, ref, c.astype("<i4").tobytes(), int(c[0, 0]), int(c[-1, 1]), int(c[0, 2]), int(c[-1, 3])))
                    n += 1
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    columns = ["doc_id", "n", "ref", "segments", "a", "b", "c", "d"]
    found = matches.repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ref", "at").mapInPandas(chain, "doc_id long, n int, ref long, segments binary, a int, b int, c int, d int")
    found = materialize(found, "passage-chains")

    # the words of both sides of each chain, cut from the texts where they are read
    sides = found.select(
        F.explode(
            F.array(
                F.struct(F.col("doc_id").alias("owner"), "doc_id", "n", F.lit(0).alias("side"), F.col("a").alias("from"), F.col("b").alias("to"), "segments"),
                F.struct(F.col("ref").alias("owner"), "doc_id", "n", F.lit(1).alias("side"), F.col("c").alias("from"), F.col("d").alias("to"), F.lit(b"").alias("segments")),
            )
        ).alias("s")
    ).select("s.*")
    many = sides.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / REQUEST).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("doc_id", "n"), F.coalesce("parts", F.lit(1)))
    wanted = (
        sides.join(many, "owner", "left")
        .groupBy("owner", part.alias("part"))
        .agg(F.collect_list(F.struct("doc_id", "n", "side", "from", "to", "segments")).alias("wanted"))
        .drop("part")
    )
    size = found.agg(F.coalesce(F.sum(F.octet_length("segments") + 2 * 80), F.lit(0))).first()[0]
    joined = rows.withColumn("version", F.xxhash64("text")).join(F.broadcast(wanted) if size <= common.BROADCAST_BYTES else wanted, F.col("doc_id") == F.col("owner")).select("text", "version", "owner", "wanted")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            give_back()
            for words, version, owner, wanted in zip(word_hashes(batch["text"]), batch["version"], batch["owner"], batch["wanted"], strict=True):
                short = (words >> np.uint64(32)).astype("<u4")
                for w in wanted:
                    a = max(0, w["from"] - MARGIN)
                    out.append((w["doc_id"], w["n"], w["side"], version, owner, a, short[a : w["to"] + MARGIN].tobytes(), w["segments"]))
                    if len(out) >= 5000:
                        yield pd.DataFrame(out, columns=cut_columns)
                        out = []
            yield pd.DataFrame(out, columns=cut_columns)

    cut_columns = ["doc_id", "n", "side", "version", "owner", "at", "words", "segments"]
    keys = ["doc_id", "n"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in groups(batches, keys):
            # the first of each side: of rows that repeat an id, the least version
            j = int(np.searchsorted(g["side"], 1))
            if j in (0, len(g["side"])):
                continue
            doc_id, version, owner = int(g["doc_id"][0]), int(g["version"][0]), int(g["owner"][j])
            c = np.frombuffer(g["segments"][0], "<i4").reshape(-1, 4).astype(np.int64)
            x, y = np.frombuffer(g["words"][0], "<u4"), np.frombuffer(g["words"][j], "<u4")
            x_at, y_at = int(g["at"][0]), int(g["at"][j])
            if c[-1, 1] > x_at + len(x) or c[-1, 3] > y_at + len(y):
                continue  # of another text with the same id
            passages = list(align(c, x, x_at, y, y_at, min_words, identity))
            if not passages:
                for f in finer(x, x_at, y, y_at, math.ceil(identity * min_words)):
                    passages += align(f, x, x_at, y, y_at, min_words, identity)
            out += [(doc_id, a, b, owner, p, q, share, version) for a, b, p, q, share in passages]
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=result)
                out = []
        if out:
            yield pd.DataFrame(out, columns=result)

    result = ["doc_id", "start", "end", "ref_doc_id", "ref_start", "ref_end", "identity", "version"]
    slices = joined.mapInPandas(cut, "doc_id long, n int, side int, version long, owner long, at int, words binary, segments binary")
    return slices.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "side", "version").mapInPandas(verify, SCHEMA)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages that repeat one of an earlier document: one row (doc_id, start, end, ref_doc_id, ref_start, ref_end, identity, version).

    Repeats within one document are none. Positions count words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased), ends excluded. ref_doc_id is a smaller doc_id that
    holds the passage; version is xxhash64 of the document's text. A passage with parts in several earlier documents
    has a row for each. Rows with a null id, null or short texts have no passages; rows that repeat an id are one
    document, and of their different texts the least by version stands. Of min_words >= K + SPAN - 1, every run of
    min_words words that an earlier document holds is covered by passages: all its seeds occur earlier, so the run
    itself is looked up where those of its seeds don't cover it. Passages with changed words are found through the first occurrences of their seeds only.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text=text_col).where(F.col("doc_id") != NULL_ID)

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, words in zip(batch["doc_id"], word_hashes(batch["text"]), strict=True):
                h, at = minimizers(words)
                held.append((doc_id, h, at))
                size += len(h)
                if size >= CHUNK:
                    yield from first_of_chunk(held)
                    held, size = [], 0
                    give_back()
        if held:
            yield from first_of_chunk(held)

    def first_of_chunk(held: list[tuple]) -> Iterator[pd.DataFrame]:
        """All seeds, those of documents after the first with the same seed joined with that."""
        held.sort(key=lambda x: x[0])
        seed = np.concatenate([h for _, h, _ in held]).view(np.int64)
        doc = np.repeat(np.array([d for d, _, _ in held], np.int64), [len(h) for _, h, _ in held])
        place = np.concatenate([at * PLACE + np.diff(at, prepend=at[:1]) for _, _, at in held])
        order = np.argsort(seed, kind="stable")
        seed, doc, place = seed[order], doc[order], place[order]
        new = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        ref, ref_place = doc[first], place[first]
        ref_place[ref == doc] = -1
        for a in range(0, len(seed), 20_000):
            part = slice(a, a + 20_000)
            yield pd.DataFrame({"seed": seed[part], "doc_id": doc[part], "place": place[part], "ref": ref[part], "ref_place": ref_place[part]})

    # the firsts of all chunks meet; rows that have a partner in their chunk are dealt evenly, and take over its partner
    found = F.col("ref_place") >= 0
    alone = F.when(found, F.xxhash64("doc_id", "place")).otherwise(F.lit(None))
    by_seed = Window.partitionBy("seed", alone).orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.mapInPandas(seeds, "seed long, doc_id long, place long, ref long, ref_place long").withColumn("first", F.first(F.struct("doc_id", "place")).over(by_seed))
    met = met.where(found | (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.place") != F.col("place")))
    met = met.select("seed", "doc_id", "place", F.when(found, F.col("ref")).otherwise(F.col("first.doc_id")).alias("ref"), F.when(found, F.col("ref_place")).otherwise(F.col("first.place")).alias("ref_place"), found.alias("within"))
    met = materialize(met, "passage-met")
    over = met.where("NOT within AND ref <> doc_id").select("seed", F.col("doc_id").alias("ref"), F.col("place").alias("ref_place"), F.col("ref").alias("least"), F.col("ref_place").alias("least_place")).distinct()
    within = met.where("within").join(over, ["seed", "ref", "ref_place"], "left")
    again = met.where("NOT within").drop("within").union(within.select("seed", "doc_id", "place", F.coalesce("least", "ref"), F.coalesce("least_place", "ref_place")))
    word, gap = (lambda c: F.shiftright(c, 4).cast("int")), (lambda c: (F.col(c) % PLACE).cast("int"))
    again = again.select("seed", "doc_id", word("place").alias("at"), gap("place").alias("gap"), "ref", word("ref_place").alias("ref_at"), gap("ref_place").alias("ref_gap"))
    again = materialize(again, "passage-seeds")
    later = again.where("doc_id <> ref")
    found = materialize(aligned(rows, later.select("doc_id", "ref", "at", "ref_at"), min_words, identity), "passages-of-seeds")

    ranges = "array<struct<a:int,b:int>>"

    def areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in groups(batches, ["doc_id"]):
            if found := shared_areas(g["at"].astype(np.int64), g["gap"].astype(np.int64), min_words):
                out.append((int(g["doc_id"][0]), found))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["owner", "areas"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["owner", "areas"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes, at = [], [], []
            for doc_id, words, found in zip(batch["doc_id"], word_hashes(batch["text"]), batch["areas"], strict=True):
                for x in found:
                    h = run_hashes(words[x["a"] : x["b"]], min_words)
                    ids.append(np.full(len(h), doc_id, np.int64))
                    hashes.append(h)
                    at.append(np.arange(x["a"], x["a"] + len(h), dtype=np.int32))
            if ids:
                yield pd.DataFrame({"run": np.concatenate(hashes).view(np.int64), "doc_id": np.concatenate(ids), "at": np.concatenate(at)})

    def areas_of(seeds: DataFrame) -> DataFrame:
        by_doc = seeds.select("doc_id", "at", "gap").repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "at")
        return by_doc.mapInPandas(areas, f"owner long, areas {ranges}")

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [uncovered([(x["a"], x["b"]) for x in a], [] if s is None else [(x["start"], x["end"]) for x in s], min_words) for a, s in zip(batch["areas"], batch["spans"], strict=True)]
            yield pd.DataFrame([(o, f) for o, f in zip(batch["owner"], found, strict=True) if f], columns=["owner", "areas"])

    # runs that no passage covers, though each of their seeds occurs earlier; and whichever documents hold their seeds
    spans = found.groupBy(F.col("doc_id").alias("owner")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    # written in between: Python functions one upon another in a stage take a worker each, and executors keep them all
    shared = materialize(areas_of(later), "passage-shared")
    left = shared.join(spans, "owner", "left").select("owner", "areas", "spans").mapInPandas(outside, f"owner long, areas {ranges}")
    left = materialize(left, "passage-left")
    if left.isEmpty():
        return found
    few = broadcast_small(left, areas=16)
    inside = F.exists("areas", lambda x: (F.col("at") >= x["a"]) & (F.col("at") < x["b"]))
    # written before the join, so that the join alone is a stage and a frequent seed can be split
    wanted = materialize(later.join(few, F.col("doc_id") == F.col("owner")).where(inside).select("seed").distinct(), "passage-wanted")
    held = again.select("seed", "doc_id", "at", "gap").union(later.select("seed", "ref", "ref_at", "ref_gap").distinct()).join(broadcast_small(wanted), "seed", "left_semi")
    holders = materialize(areas_of(held), "passage-areas")
    many = broadcast_small(holders, areas=16)
    run_rows = materialize(rows.join(many, F.col("doc_id") == F.col("owner")).select("doc_id", "text", "areas").mapInPandas(runs, "run long, doc_id long, at int"), "passage-runs")
    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["doc_id"]):
            some = covering(g["at"].astype(np.int64), min_words)
            yield pd.DataFrame({c: v[some] for c, v in g.items()})

    whole = with_first(of_several(run_rows, "run"), "run").join(few, F.col("doc_id") == F.col("owner")).where(F.exists("areas", lambda x: (F.col("at") >= x["a"]) & (F.col("at") + min_words <= x["b"])))
    whole = whole.select("doc_id", "ref", "at", "ref_at").repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "at", "ref_at")
    whole = materialize(whole.mapInPandas(cover, "doc_id long, ref long, at int, ref_at int"), "passage-whole")
    ends = F.explode(F.sequence(F.lit(0), F.lit(max(min_words - K, 0)), F.lit(max(1, min(min_words - K, MAX_GAP // 2))))).alias("more")
    ends = whole.select("doc_id", "ref", "at", "ref_at", ends).union(whole.select("doc_id", "ref", "at", "ref_at", F.lit(max(min_words - K, 0)))).distinct()
    whole = ends.select("doc_id", "ref", (F.col("at") + F.col("more")).alias("at"), (F.col("ref_at") + F.col("more")).alias("ref_at"))
    return found.union(aligned(rows, whole, min_words, identity))


_WORD = r"[^\x20\x09-\x0d]+"


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, each with the white space after it."""
    words = list(re.finditer(_WORD, text))
    keep = np.ones(len(words), bool)
    for a, b in spans:
        keep[a:b] = False
    out, at = [], 0
    for i, m in enumerate(words):
        if not keep[i]:
            out.append(text[at : m.start()])
            at = words[i + 1].start() if i + 1 < len(words) else len(text)
    out.append(text[at:])
    return "".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the passages that repeat one of an earlier document; documents that lose all their words go.

    The first occurrence stays. Columns are those of docs; n_chars, where there is one, is counted anew.
    """
    found = materialize(repeated_passages(docs, id_col, text_col, **how), "passages")
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    spans = broadcast_small(materialize(spans, "passage-spans"), __spans=16)
    joined = docs.join(spans, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__version")), "left")

    @F.pandas_udf("string")
    def shorten(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)])

    # else the filter behind it would run it a second time, in workers of its own
    shorten = shorten.asNondeterministic()
    changed = F.col("__spans").isNotNull()
    short = joined.where(changed).withColumn(text_col, shorten(F.col(text_col), F.col("__spans"))).where(F.length(F.trim(F.regexp_replace(text_col, r"[\t-\r]", " "))) > 0)
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return joined.where(~changed).select(*docs.columns).union(short.select(*docs.columns))
