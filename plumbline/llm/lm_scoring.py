"""LM scoring: masked pseudo-likelihood of a bidirectional window network that is trained in numpy.

The network predicts every token from the SIDE tokens before and after it: h = tanh(sum of their embeddings + b); a
token's number is PLACES * class + place, and its log-probability log P(class | h) + log P(place | h, class), both
softmaxes. A document's score is the sum over its tokens. Words are the most frequent ones of the whole corpus, the
others share hashed buckets, to whose probability comes that of the word's cell in its bucket: its share of the
bucket's tokens in the whole corpus, over as many cells as the corpus has words (MOST_CELLS at most). Every document trains: partitions train copies of the network, which are averaged by
tokens in two rounds, a quarter of the documents first and the others from that average on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keyed, materialize, release, unkeyed, word_hashes

#: Classes and places in a class; numbers of them all, of which the last BUCKETS are hashed; embedding width; tokens each side.
CLASSES, PLACES, BUCKETS, WIDTH, SIDE = 32, 32, 128, 16, 2
VOCABULARY = CLASSES * PLACES
PAD = VOCABULARY
#: Cells of words without a number of their own, at most: 16 MB; with more words, some share a cell.
MOST_CELLS = 1 << 22
#: Tokens of a training step, step size, tokens scored at a time, values in a row of a written network.
STEP, RATE, SCORED, ROW = 4096, 0.15, 65_536, 4096
_SHAPES = {"e": (2 * SIDE, VOCABULARY + 1, WIDTH), "b": (WIDTH,), "w1": (WIDTH, CLASSES), "b1": (CLASSES,), "w2": (CLASSES, WIDTH, PLACES), "b2": (CLASSES, PLACES)}


def fresh() -> dict[str, np.ndarray]:
    """The network before training, the same on each machine."""
    rng = np.random.Generator(np.random.PCG64(3))
    return {k: (rng.normal(0, 0.1, s) if k in ("e", "w1", "w2") else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in _SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        size = int(np.prod(s))
        out[k] = values[at : at + size].reshape(s).astype(np.float32)
        at += size
    return out


def numbers(words: np.ndarray, sorted_hashes: np.ndarray, number_of: np.ndarray) -> np.ndarray:
    """Token numbers of word hashes: of a frequent word its own, of another that of a bucket."""
    bucket = (VOCABULARY - BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64)).astype(np.int32)
    if not len(sorted_hashes):
        return bucket
    at = np.minimum(np.searchsorted(sorted_hashes, words), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == words, number_of[at], bucket)


def stream(docs: list[np.ndarray]) -> np.ndarray:
    """Documents in one array, SIDE pads before, between and after."""
    pad = np.full(SIDE, PAD, np.int32)
    return np.concatenate([pad, *[x for d in docs for x in (d, pad)]])


def _hidden(net: dict[str, np.ndarray], t: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = net["b"] + net["e"][0][t[at - SIDE]]
    for i, d in enumerate([*range(-SIDE + 1, 0), *range(1, SIDE + 1)], 1):
        z += net["e"][i][t[at + d]]
    return np.tanh(z, out=z)


def _softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log-probability of each target)."""
    logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1, keepdims=True)
    logits /= total
    return logits, own - np.log(total[:, 0])


def log_probabilities(net: dict[str, np.ndarray], t: np.ndarray, at: np.ndarray, gradient: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Log-probability of each token t[at], given those around it; with gradient, that of their negated sum is put there."""
    order = at[np.argsort((t[at] // PLACES).astype(np.uint8), kind="stable")]
    target = t[order]
    cls, place = target // PLACES, target % PLACES
    h = _hidden(net, t, order)
    p, logp = _softmax(h @ net["w1"] + net["b1"], cls)
    if gradient is not None:
        p[np.arange(len(cls)), cls] -= 1
        gradient["w1"] = h.T @ p
        gradient["b1"] = p.sum(axis=0)
        dh = p @ net["w1"].T
        gradient["w2"], gradient["b2"] = np.zeros_like(net["w2"]), np.zeros_like(net["b2"])
    edges = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        a, b = edges[c], edges[c + 1]
        if a == b:
            continue
        q, more = _softmax(h[a:b] @ net["w2"][c] + net["b2"][c], place[a:b])
        logp[a:b] += more
        if gradient is not None:
            q[np.arange(b - a), place[a:b]] -= 1
            gradient["w2"][c] = h[a:b].T @ q
            gradient["b2"][c] = q.sum(axis=0)
            dh[a:b] += q @ net["w2"][c].T
    if gradient is not None:
        dz = dh * (1 - h * h)
        gradient["b"] = dz.sum(axis=0)
        gradient["e"] = np.zeros_like(net["e"])
        full = np.zeros((len(t), WIDTH), np.float32)
        full[order] = dz
        # the token at j is context i of the token at j - d: one sort of the tokens serves all contexts
        inner = np.arange(SIDE, len(t) - SIDE)
        by = inner[np.argsort(t[inner].astype(np.uint16), kind="stable")]
        present, first = np.unique(t[by], return_index=True)
        for i, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            gradient["e"][i][present] = np.add.reduceat(full[by - d], first, axis=0)
    out = np.empty(len(at), np.float32)
    back = np.empty(len(t), np.float32)
    back[order] = logp
    out[:] = back[at]
    return out


def train(net: dict[str, np.ndarray], streams: Iterator[np.ndarray]) -> int:
    """Train net in place (Adagrad) on every token of the streams; returns how many there were."""
    squares = {k: np.full_like(v, 1e-3) for k, v in net.items()}
    seen = 0
    for t in streams:
        for a in range(SIDE, len(t) - SIDE, STEP):
            part = t[a - SIDE : min(a + STEP, len(t) - SIDE) + SIDE]
            at = np.arange(SIDE, len(part) - SIDE)
            at = at[part[at] != PAD]
            if not len(at):
                continue
            g: dict[str, np.ndarray] = {}
            log_probabilities(net, part, at, g)
            for k, v in g.items():
                v /= len(at)
                squares[k] += v * v
                net[k] -= RATE * v / np.sqrt(squares[k])
            seen += len(at)
    return seen


class Scorer:
    """The network and its words (under 1 MB), and the log-probabilities of cells in their buckets (4 bytes each)."""

    def __init__(self, values: np.ndarray, hashes: np.ndarray, cells: np.ndarray | None = None):
        self.values, self.cells = values, np.zeros(BUCKETS, np.float32) if cells is None else cells
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int32)

    def tokens(self, texts) -> Iterator[np.ndarray]:
        for words in word_hashes(texts, punctuation=False):
            yield numbers(words, self.hashes, self.number)


def cell_sums(texts, hashes: np.ndarray, number: np.ndarray, cells: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Numbers of each text's tokens, and the sum of the log-probabilities of its words' cells in their buckets."""
    for words in word_hashes(texts, punctuation=False):
        n = numbers(words, hashes, number)
        yield n, float(cells[(words[n >= VOCABULARY - BUCKETS] % np.uint64(len(cells))).astype(np.int64)].sum(dtype=np.float64))


def _chunks(docs: Iterator[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): hash and number of occurrences of every word of all rows (doc_id, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _chunks((w for batch in batches for w in word_hashes(batch["text"], punctuation=False)), 4_000_000):
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"word": hashes.view(np.int64), "n": n})

    return rows.mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, most frequent first; ties by hash."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - BUCKETS).collect()
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


def cell_shares(counts: DataFrame, frequent: np.ndarray, most: int = MOST_CELLS) -> np.ndarray:
    """Log-probability of each cell (hash of a word mod the number of cells) in its bucket, one occurrence added to each.

    There are as many cells as words, rounded up to a power of two of BUCKETS at least and `most` at most. A word
    that the corpus doesn't hold has the share of its cell, which is that of no occurrence where the cell is empty.
    """
    spark = counts.sparkSession
    n = max(BUCKETS, min(most, 1 << max(0, counts.count() - 1).bit_length()))
    known = spark.createDataFrame([(int(w),) for w in frequent.view(np.int64)], "word long")
    cell = F.col("word").bitwiseAND(n - 1).cast("int").alias("cell")
    found = counts.join(F.broadcast(known), "word", "left_anti").groupBy(cell).agg(F.sum("n").alias("n")).toArrow()
    seen = np.ones(n)
    seen[found["cell"].to_numpy()] += found["n"].to_numpy()
    bucket = seen.reshape(-1, BUCKETS).sum(axis=0)
    return (np.log(seen) - np.log(np.tile(bucket, n // BUCKETS))).astype(np.float32)


def train_round(rows: DataFrame, scorer: Scorer) -> np.ndarray:
    """The average, by tokens, of the networks that partitions have trained from scorer's on; scorer's own of no tokens.

    Written networks are summed in two steps, 64 partitions at a time, each row of the network on its own.
    """

    start = Scorer(scorer.values, np.empty(0, np.uint64))  # without the cells
    start.hashes, start.number = scorer.hashes, scorer.number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shaped(start.values)
        seen = train(net, (stream(held) for held in _chunks((d for batch in batches for d in start.tokens(batch["text"])), SCORED)))
        if seen:
            values = flat(net).astype(np.float64) * seen
            part = TaskContext.get().partitionId() // 64
            parts = [values[a : a + ROW] for a in range(0, len(values), ROW)]
            yield pd.DataFrame({"part": part, "row": range(len(parts)), "seen": seen, "sums": parts})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "row": [g["row"].iat[0]], "seen": [g["seen"].sum()], "sums": [np.sum(np.stack(g["sums"]), axis=0)]})

    schema = "part long, row int, seen long, sums array<double>"
    sums = rows.mapInPandas(run, schema).groupBy("part", "row").applyInPandas(add, schema).groupBy("row").applyInPandas(add, schema)
    found = sorted(sums.collect(), key=lambda r: r["row"])
    if not found:
        return scorer.values
    return (np.concatenate([r["sums"] for r in found]) / found[0]["seen"]).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer trained on all rows; null texts are empty, and of an empty table it is untrained."""
    rows = keyed(docs, id_col, text=text_col)
    counts = materialize(word_counts(rows), "word-counts")
    frequent = frequent_words(counts)
    scorer = Scorer(flat(fresh()), frequent, cell_shares(counts, frequent))
    release(counts)
    first = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    for part in (first, ~first):
        scorer.values = train_round(rows.where(part), scorer)
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, pseudo_log_likelihood, per_token) of every row's whole text.

    Texts without words have 0 tokens, a sum of 0 and no mean; null and repeated ids are scored like any.
    """
    held_cells = docs.sparkSession.sparkContext.broadcast(scorer.cells)
    values, hashes, number = scorer.values, scorer.hashes, scorer.number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shaped(values)
        for batch in batches:
            n, total, cells = [], [], []

            def tokens(texts, cells=cells):
                for d, more in cell_sums(texts, hashes, number, held_cells.value):
                    cells.append(more)
                    yield d

            for held in _chunks(tokens(batch["text"]), SCORED):
                t = stream(held)
                at = np.flatnonzero(t != PAD)
                logp = np.concatenate([log_probabilities(net, t, at[a : a + SCORED]) for a in range(0, len(at), SCORED)] or [np.empty(0)]).astype(np.float64)
                edges = np.concatenate([[0], np.cumsum([len(d) for d in held])])
                sums = np.concatenate([[0], np.cumsum(logp)])
                n += np.diff(edges).tolist()
                total += (sums[edges[1:]] - sums[edges[:-1]]).tolist()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "pseudo_log_likelihood": np.array(total) + np.array(cells)})

    out = keyed(docs, id_col, text=text_col).mapInPandas(run, "doc_id long, n_tokens long, pseudo_log_likelihood double")
    return unkeyed(out).withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))
