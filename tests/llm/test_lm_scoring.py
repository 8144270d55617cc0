from collections import Counter

import numpy as np

from plumbline.llm import lm_scoring as lm
from tests.llm.cases import empty_documents, odd_documents


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    net = lm.fresh()
    t = lm.stream([rng.integers(0, lm.VOCABULARY, 7).astype(np.int32)])
    total = 0
    for w in range(lm.VOCABULARY):
        u = t.copy()
        u[5] = w
        total += np.exp(lm.log_probabilities(net, u, np.array([5])).astype(float))
    assert abs(total - 1) < 1e-3


def test_gradient():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in lm.fresh().items()}
    t = lm.stream([rng.integers(0, 40, 30).astype(np.int32), rng.integers(0, 40, 9).astype(np.int32)])
    at = np.flatnonzero(t != lm.PAD)
    loss = lambda: -lm.log_probabilities(net, t, at).astype(float).sum()
    g = {}
    lm.log_probabilities(net, t, at, g)
    for k, v in net.items():
        for i in rng.choice(np.flatnonzero(np.abs(g[k]).ravel() > 1e-4), 5):
            old = v.ravel()[i]
            v.ravel()[i] = old + 1e-3
            up = loss()
            v.ravel()[i] = old - 1e-3
            down = loss()
            v.ravel()[i] = old
            assert abs((up - down) / 2e-3 - g[k].ravel()[i]) < 0.02 * abs(g[k].ravel()[i]) + 0.02


def test_learns_both_sides(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"a{x} b{x} c{x}" for x in rng.integers(0, 30, 120))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scorer = lm.fit(docs)
    mixed = [(i, " ".join(rng.permutation(t.split()))) for i, t in rows[:50]]
    real = lm.score(spark.createDataFrame(rows[:50], "doc_id long, text string"), scorer)
    fake = lm.score(spark.createDataFrame(mixed, "doc_id long, text string"), scorer)
    a, b = ({r["doc_id"]: r["per_token"] for r in f.collect()} for f in (real, fake))
    assert np.mean(list(a.values())) > np.mean(list(b.values())) + 1 and np.mean(list(a.values())) > -4


def plain_score(net, words, own, counts, n_cells):
    """The score of one text, a token at a time, without sorting by class."""
    number = [own.get(w, lm.VOCABULARY - lm.BUCKETS + w % lm.BUCKETS) for w in words]
    padded = [lm.PAD] * lm.SIDE + number + [lm.PAD] * lm.SIDE
    total = 0.0
    for i, (w, x) in enumerate(zip(words, number, strict=True)):
        around = padded[i : i + lm.SIDE] + padded[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1]
        h = np.tanh(net["b"] + sum(net["e"][j][y] for j, y in enumerate(around)))
        c, p = divmod(x, lm.PLACES)
        for logits, at in ((h @ net["w1"] + net["b1"], c), (h @ net["w2"][c] + net["b2"][c], p)):
            total += logits[at] - np.log(np.exp(logits).sum())
        if w not in own:
            cell, bucket = w % n_cells, w % lm.BUCKETS
            others = [n for v, n in counts.items() if v not in own and v % lm.BUCKETS == bucket]
            total += np.log(1 + sum(n for v, n in counts.items() if v not in own and v % n_cells == cell)) - np.log(sum(others) + n_cells // lm.BUCKETS)
    return total


def test_against_plain_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = lm.fit(docs)
    net = lm.shaped(scorer.values)
    got = {r["doc_id"]: r for r in lm.score(docs, scorer).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    words = {r["doc_id"]: w.tolist() for r, w in zip(rows, lm.word_hashes([r["text"] for r in rows], punctuation=False), strict=True)}
    counts = Counter(w for d in words.values() for w in d)
    own = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], np.uint64(x[0]).view(np.int64)))[: lm.VOCABULARY - lm.BUCKETS])}
    n_cells = 1 << (len(counts) - 1).bit_length()
    assert len(scorer.cells) == n_cells and abs(np.exp(scorer.cells.astype(float)).sum() - lm.BUCKETS) < 1e-2
    for d in sorted(words, key=lambda d: len(words[d]))[::20][:12]:
        assert abs(got[d]["pseudo_log_likelihood"] - plain_score(net, words[d], own, counts, n_cells)) < 1e-3 * max(1, len(words[d])), d


def test_cells_grow_with_the_corpus(spark):
    counts = spark.createDataFrame([(int(w), 1 + w % 3) for w in range(1000)], "word long, n long")
    few, many = (lm.cell_shares(counts, np.arange(5).astype(np.uint64), most) for most in (256, 1 << 22))
    assert len(few) == 256 and len(many) == 1024
    for c in (few, many):
        assert np.allclose(np.exp(c.astype(float)).reshape(-1, lm.BUCKETS).sum(axis=0), 1)


def test_odd_rows(spark):
    scorer = lm.fit(odd_documents(spark))
    rows = lm.score(odd_documents(spark), scorer).collect()
    assert len(rows) == 13 and all((r["n_tokens"] > 0) == (r["per_token"] is not None) for r in rows)
    assert sum(r["n_tokens"] == 0 for r in rows) == 4 and all(np.isfinite(r["pseudo_log_likelihood"]) for r in rows)
    assert lm.score(empty_documents(spark), lm.fit(empty_documents(spark))).count() == 0
