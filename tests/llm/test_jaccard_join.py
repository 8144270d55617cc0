import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import common, jaccard_join, queries
from plumbline.llm.common import connected_components, find, word_hashes
from tests.llm.cases import empty_documents, odd_documents


def brute(rows, k=3, percent=90):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & sets[j])
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(parent, i)] = min(doc_id, least.get(find(parent, i), doc_id))
    return sorted(((d, len(s), None if d is None else least[find(parent, i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def copies():
    """Chains of near copies of every size, on both sides of the threshold."""
    rng = random.Random(3)
    rows = []
    for size in (3, 8, 11, 15, 22, 40, 60, 130, 400, 900):
        for _ in range(4):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for _ in range(6):
                rows.append((len(rows), " ".join(base)))
                base = edited(base, rng.randrange(0, max(2, size // 40)), rng)
                base = base[rng.randrange(2) :] + ["tail"] * rng.randrange(2)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, copies, k, percent):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert result(jaccard_join.jaccard_components(docs, k=k, percent=percent)) == brute(copies, k, percent)


def test_split_subtrees(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert result(jaccard_join.jaccard_components(docs, max_block=2)) == brute(copies)


@pytest.mark.parametrize("unlike", [0, 3])
def test_template_with_small_edits(spark, unlike, monkeypatch):
    """A group of near copies in many blocks; some of them link with the first through others only. Nothing is broadcast."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(unlike)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(base, 1, rng))) for i in range(40)]
    for n in range(unlike):
        base = edited(base, 3, rng)
        rows += [(40 + 10 * n + i, " ".join(edited(base, 1, rng))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_join.jaccard_components(docs, max_block=7)) == brute(rows)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op4_jaccard_join(spark, sf)) == brute(rows)


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()]
    assert result(jaccard_join.jaccard_components(odd_documents(spark))) == brute(rows)
    assert jaccard_join.jaccard_components(empty_documents(spark)).count() == 0
    kept = jaccard_join.one_of_each(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 1, 2, 3, None, None, 4, 6, 7, 8, 9, 10], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=4, max_size=300), st.lists(st.integers(0, 10**6), max_size=8), st.integers(70, 99))
def test_linked_sets_share_a_key(items, changes, percent):
    a = np.unique(np.array(items, np.uint64))
    b = a.copy()
    for c in changes:
        b[c % len(b)] = c + 1000
    b = np.unique(b)
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
        assert set(jaccard_join.block_keys(a, percent)) & set(jaccard_join.block_keys(b, percent))


def test_vectors_fold():
    sets = [np.unique(np.random.default_rng(i).integers(0, 10**9, n, dtype=np.uint64)) for i, n in enumerate((5, 700, 5000, 40_000))]
    vectors = [jaccard_join.count_vector(s) for s in sets]
    assert [len(v) for v in vectors] == [64, 64, 512, 1024] and [v.sum() for v in vectors] == [len(s) for s in sets]
    both = jaccard_join.folded(vectors)
    assert both.shape == (4, 64) and (both[2] == np.bincount((jaccard_join.mix(sets[2]) % np.uint64(64)).astype(int), minlength=64)).all()


def test_tree_loses_no_overlap():
    rng = np.random.default_rng(5)
    points = rng.poisson(2, (500, jaccard_join.LEAST)).astype(np.int32)
    points[250:] = points[:250]
    points[250:, 3] += 1
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, sizes)
    for i in range(0, 500, 17):
        bound = np.minimum(points, points[i]).sum(axis=1)
        assert set(tree.query(points[i], sizes[i], 90)) == set(np.flatnonzero(190 * bound >= 90 * (sizes + sizes[i])))


def test_word_hashes():
    long = " ".join(f"w{i}" for i in range(400_000))
    one, two, three, four = word_hashes(["Aa b\x0bc", "aa B C", None, long])
    assert (one == two).all() and len(three) == 0 and len(np.unique(four)) == 400_000
    assert (next(word_hashes(["x w399999"]))[1] == four[-1]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = list(range(2000))
    for u, v in edges:
        if u is not None:
            a, b = find(parent, u), find(parent, v)
            parent[max(a, b)] = min(a, b)
    want = {(x, find(parent, x)) for u, v in edges if u is not None and u != v for x in (u, v)}
    assert {tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def test_hashes_are_not_compressed(spark, tmp_path, monkeypatch):
    """By zstandard, these tables took near_copies of the pipeline hundreds of MB outside of the heap."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[::-1])), (4, None)], "doc_id long, text string")
    found = sorted(map(tuple, jaccard_join.jaccard_components(docs, k=3, percent=90).select("doc_id", "component_id").collect()))
    assert found == [(1, 1), (2, 1), (3, 3), (4, 4)]
    for table in ("sets", "firsts", "keys"):
        files = list(tmp_path.glob(f"plumbline/jaccard-{table}-*/part-*"))
        assert files
        for f in files:
            about = pq.ParquetFile(f).metadata
            assert all(about.row_group(g).column(c).compression == "UNCOMPRESSED" for g in range(about.num_row_groups) for c in range(about.num_columns))
