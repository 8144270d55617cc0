import hashlib
import random

import numpy as np

from plumbline.llm import fingerprints as fp
from plumbline.llm import queries
from tests.llm.cases import empty_documents, odd_documents
from tests.llm.test_jaccard_join import brute, edited


def want(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        prints = [fp.fingerprint(s) for s in (t, new, after)]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), prints[0], prints[1], fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2])))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = result(queries.op5_fingerprints(spark, sf))
    assert got == want(rows)
    assert np.mean([r[5] for r in got]) > 0.5 and np.mean([r[6] for r in got]) < 0.1


def test_odd_rows(spark):
    assert result(fp.edited_fingerprints(odd_documents(spark))) == want([(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()])
    assert fp.edited_fingerprints(empty_documents(spark)).count() == 0
    one = odd_documents(spark).where("doc_id = 10")
    assert result(fp.edited_fingerprints(one)) == want([(10, "you are an idiot")])


def real(a, b):
    sets = [{x.lower()[i : i + 7] for i in range(max(1, len(x) - 6))} for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_likeness_estimates_jaccard():
    """Of texts of all sizes and their edits: no length at which the shingles change."""
    rng = random.Random(1)
    for n in (2, 5, 20, *range(50, 101, 5), 1000):
        a = " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
        for share in (4, 10):
            b = a[: len(a) - len(a) // share] + "x" * (len(a) // share)
            assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - real(a, b)) < 0.15
            assert fp.edited_pair(a, b, len(a) - len(a) // share) == (fp.fingerprint(a), fp.fingerprint(b))
    assert fp.likeness(fp.fingerprint("aB"), fp.fingerprint("Ab")) == 1 and fp.fingerprint("") == "" and fp.likeness("", fp.fingerprint("a")) == 0


def test_near_copies(spark):
    rng = random.Random(9)
    rows = []
    for size in (30, 100, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(5):
                rows.append((len(rows), " ".join(base)))
                base = edited(base, size // 60, rng)
    got = {r["doc_id"]: r["component_id"] for r in fp.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got.get(d, d) for d, _ in rows} == {d: c for d, _, c in brute(rows, 5, 80)}
    assert fp.near_copies(empty_documents(spark)).count() == 0
    assert {r["doc_id"] for r in fp.near_copies(odd_documents(spark)).collect()} == {4, 5}
