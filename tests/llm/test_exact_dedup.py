import hashlib
import random
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest

from plumbline.llm import exact_dedup
from tests.llm.cases import empty_documents, odd_documents

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def plain(rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        at = ids.index(keep)
        out += [(d, keep, len(ids), n == at, hashlib.sha256(text.encode()).hexdigest()) for n, d in enumerate(ids)]
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_and_empty(spark):
    docs = odd_documents(spark)
    assert result(exact_dedup.copies(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert result(exact_dedup.copies(empty_documents(spark))) == []
    assert exact_dedup.without_copies(empty_documents(spark)).collect() == []


def test_columns_of_the_same_names(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "text AS digest", "doc_id AS row", "doc_id AS keep_id", "true AS maybe", "1 AS c0", "2 AS best")
    assert result(exact_dedup.copies(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text_sha256 for r in exact_dedup.copies(docs).where("kept").collect()) == sorted(hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest() for r in kept.collect())


@pytest.mark.parametrize("bits", [1 << 17, 1 << 10])
def test_hot_groups_and_a_full_filter(spark, monkeypatch, bits):
    """A third of the rows is one text; a filter too small for its rows lets more pass and changes nothing."""
    monkeypatch.setattr(exact_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(exact_dedup, "SEGMENT", min(bits, 1 << 12))
    monkeypatch.setattr(exact_dedup, "MOST_HOT", 3)
    rng = random.Random(5)
    rows = [(i, "SAME text" if i % 3 == 0 else f"Text {rng.randrange(4000)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(exact_dedup.copies(docs)) == plain(rows)
    kept = [tuple(r) for r in exact_dedup.without_copies(docs).collect()]
    assert sorted(kept) == sorted((d, dict(rows)[d]) for d, _, _, k, _ in plain(rows) if k)


def test_only_rows_that_may_repeat_pass(spark):
    """Every repeated hash passes the filter, and few others do."""
    hashes = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 30_000)
    twice = hashes[:2000]
    df = spark.createDataFrame([(int(h),) for h in np.r_[hashes, twice]], "h long").repartition(9)
    passed = [r.h for r in df.where(exact_dedup.repeated_filter(df, 32_000)("h")).collect()]
    assert set(twice.tolist()) <= set(passed)
    assert len(passed) - 4000 < 0.01 * 30_000

