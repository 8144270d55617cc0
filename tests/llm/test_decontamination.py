import time
import random
import re

import numpy as np
import pytest

from plumbline.llm import common, exact_dedup
from plumbline.llm import decontamination as dc
from plumbline.llm import queries
from tests.llm.cases import empty_documents, odd_documents


def brute_tiling(item, doc, least):
    """Coverage by greedy string tiling, longest first, without hashes."""
    free_i, free_d = [True] * len(item), [True] * len(doc)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        for d in range(n):
            free_i[i + d] = free_d[j + d] = False
        total += n


def tokens(text):
    return re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", b" ", (text or "").encode()).lower().split()


def brute(docs, items, seed=5, coverage=0.6):
    out = []
    for d, text in docs:
        w = tokens(text)
        grams = {}
        for k in range(1, seed + 1):
            grams[k] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, item in items:
            t = tokens(item)
            k = min(seed, len(t))
            if t and any(tuple(t[a : a + k]) in grams[k] for a in range(len(t) - k + 1)):
                share = brute_tiling(t, w, k) / len(t)
                if share >= coverage:
                    out.append((d, i, round(share, 9)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in df.collect()), key=str)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert result(queries.op9_decontamination(spark, sf)) == brute(docs, items) != []


@pytest.fixture(scope="module")
def moved():
    """Documents with items whose parts were reordered, cut, or changed."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 6, 12, 25, 40])))) for i in range(12)] + [(12, None), (13, "?!"), (None, "a b c d e f g"), (5, "x y z")]
    docs = []
    for n in range(60):
        words = (items[rng.randrange(12)][1]).split()
        parts = [words[i : i + 8] for i in range(0, len(words), 8)]
        rng.shuffle(parts)
        if n % 3 == 0:
            parts = parts[: len(parts) // 2]
        text = [word() for _ in range(rng.randrange(10))]
        for p in parts:
            text += [w.upper() + rng.choice(["", ",", "."]) for w in p] + [word() for _ in range(rng.randrange(3))]
        docs.append((n, " ".join(text)))
    docs += [(None, "A b, c d e f g"), (61, "x (y) z")]
    return docs, items


def test_moved_parts(spark, moved):
    docs, items = moved
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got, want = dict(((a, b), c) for a, b, c in result(dc.contaminated(*frames))), dict(((a, b), c) for a, b, c in brute(docs, items))
    assert got == want
    assert (None, None) in got and (61, 5) in got


def test_ways_of_joining(spark, moved, monkeypatch):
    """Nothing broadcast, and a filter that lets all seeds pass: the same result."""
    docs, items = moved
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = result(dc.contaminated(*frames))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 8)
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1 << 8)
    assert result(dc.contaminated(*frames)) == whole


def test_a_frequent_seed(spark):
    """A run of tokens that many documents and items share makes pairs only where it could cover the item."""
    hot = "one two three four five six"
    items = [(i, f"{hot} " + " ".join(f"i{i}w{j}" for j in range(30))) for i in range(40)] + [(99, hot)]
    docs = [(d, f"{hot} " + " ".join(f"d{d}w{j}" for j in range(50))) for d in range(200)] + [(500, items[7][1])]
    got = result(dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((a, b) for a, b, _ in got) == sorted([(d, 99) for d, _ in docs] + [(500, 7)])


def test_equal_tokens_take_no_cubic_time():
    began = time.time()
    tiles = dc.tiling(np.ones(400, np.uint64), np.ones(3000, np.uint64), 5)
    assert sum(n for *_, n in tiles) == 400 and time.time() - began < 10


def test_tiling():
    rng = np.random.default_rng(0)
    for _ in range(40):
        item, doc = rng.integers(0, 12, 25).astype(np.uint64), rng.integers(0, 12, 60).astype(np.uint64)
        doc[10:22] = item[5:17]
        tiles = dc.tiling(item, doc, 3)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles) == len({x for _, j, n in tiles for x in range(j, j + n)})
        assert all((item[i : i + n] == doc[j : j + n]).all() and n >= 3 for i, j, n in tiles)
        assert max(n for *_, n in tiles) >= 12


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "t", 1)], "item_id long, text string, tiles string, doc_id int")
    assert [r["doc_id"] for r in dc.contaminated(odd_documents(spark), items).collect()] == [1, 1]
    kept = dc.without_contaminated(odd_documents(spark), items)
    assert kept.columns == odd_documents(spark).columns and kept.count() == 11
    from_null = dc.without_contaminated(odd_documents(spark), spark.createDataFrame([(1, "no id here but words enough")], "item_id long, text string"))
    assert from_null.count() == 12 and from_null.where("doc_id IS NULL").count() == 1
    assert dc.contaminated(empty_documents(spark), items).count() == 0
    assert dc.contaminated(odd_documents(spark), items.limit(0)).count() == 0
