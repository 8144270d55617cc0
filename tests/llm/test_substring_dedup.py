import random
import re

import numpy as np
import pytest

from plumbline.llm import substring_dedup as sd
from plumbline.llm.common import word_hashes
from tests.llm.cases import DOC_SCHEMA, empty_documents, odd_documents


def filler(rng, n):
    return [f"f{rng.randrange(10**9)}" for _ in range(n)]


def planted(seed=1):
    """(rows, {(doc_id, start, end, least share of it to be found)}, ids of clean documents)."""
    rng = random.Random(seed)
    rows, want = [], []
    for i in range(60):
        passage = filler(rng, rng.choice([51, 60, 90, 300]))
        kind = ["exact", "replaced", "inserted", "deleted", "short"][i % 5]
        other = list(passage)
        if kind == "replaced":
            for at in range(15, len(other), 20):
                other[at] = "changed"
        elif kind == "inserted":
            for at in range(len(other) - 17, 10, -25):
                other[at:at] = ["more", "words"]
        elif kind == "deleted":
            for at in range(len(other) - 18, 10, -30):
                del other[at : at + 2]
        elif kind == "short":
            passage = other = passage[:40]
        a, b = filler(rng, rng.randrange(40)), filler(rng, rng.randrange(200))
        n = len(rows)
        rows.append((n, " ".join(a + passage + filler(rng, 30))))
        rows.append((n + 1, " ".join(b + other + filler(rng, rng.randrange(50)))))
        if kind != "short" and not (kind == "deleted" and len(other) < 50):
            want.append((n + 1, len(b), len(b) + len(other), n, kind))
    return rows, want


def test_planted_passages(spark):
    rows, want = planted()
    found = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {w[0] for w in want}
    for doc_id, a, b, ref, kind in want:
        covered = set()
        for r in by_doc[doc_id]:
            assert r["ref_doc_id"] == ref and r["identity"] >= 0.8 and r["end"] - r["start"] >= 50
            covered |= set(range(r["start"], r["end"]))
        assert covered <= set(range(a, b)), kind
        assert len(covered) >= (b - a if kind == "exact" else 0.9 * (b - a) - 8), kind


def test_many_copies_and_common_line(spark):
    rng = random.Random(2)
    passage, line = filler(rng, 80), filler(rng, 13)
    rows = [(i, " ".join(filler(rng, 20) + line + filler(rng, 20) + (passage if i % 2 else [])) ) for i in range(400)]
    found = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["ref_doc_id"]) for r in found) == [(i, 53, 133, 1) for i in range(3, 400, 2)]


def test_against_exact_brute_force(spark, sf):
    """Every run of 50 words that an earlier document holds lies in a passage found, but for edges of a few words."""
    docs = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    seen, want = {}, {}
    for doc_id, w in docs:
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        want[doc_id] = {j for i, run in enumerate(runs) if run in seen for j in range(i, i + 50)}
        for run in runs:
            seen.setdefault(run, doc_id)
    got = {}
    for r in sd.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    for doc_id, places in want.items():
        assert not places - got.get(doc_id, set())


def test_pieces():
    words = next(word_hashes([" ".join(f"w{i}" for i in range(100))]))
    h, at = sd.minimizers(words)
    assert (np.diff(at) <= sd.SPAN).all() and at[0] < sd.SPAN
    assert len(sd.minimizers(words[: sd.K - 1])[0]) == 0 and len(sd.minimizers(words[: sd.K])[0]) == 1
    assert sd.common_words(np.array([1, 2, 3, 4, 2]), np.array([2, 3, 9, 2])) == 3
    assert list(sd.stretches(np.array([1] * 5 + [0] * 9 + [1] * 7, bool), 5)) == [(14, 21), (0, 5)]
    seg = np.array([[0, 20, 0, 20], [25, 60, 30, 65], [5, 12, 300, 307], [61, 80, 40, 59]])
    assert [c.tolist() for c in sd.chains(seg[np.lexsort((seg[:, 2], seg[:, 0]))])][0] == [[0, 20, 0, 20], [25, 60, 30, 65]]
    assert sd.without_spans("a b\nc d  e", [(1, 3)]) == "a d  e" and sd.without_spans("a b", [(0, 2)]) == "" and sd.without_spans("a b", [(1, 2)]) == "a "


def test_fenwick():
    rng = random.Random(4)
    tree, plain = sd.Fenwick(50), [(-1e18, -1)] * 50
    for n in range(300):
        i, v = rng.randrange(50), (rng.random(), n)
        tree.put(i, v)
        plain[i] = max(plain[i], v)
        j = rng.randrange(51)
        assert tree.upto(j) == max(plain[:j], default=(-1e18, -1))


def test_odd_rows_and_removal(spark):
    rng = random.Random(5)
    passage = filler(rng, 60)
    text = " ".join(passage)
    docs = odd_documents(spark).union(
        spark.createDataFrame([(d, t, "k", "c", 1, 2, 0.1) for d, t in [(20, text), (21, "mine before " + text + "\nmine after"), (22, text), (22, text), (23, text), (23, "x " + text), (None, text)]], DOC_SCHEMA)
    )
    found = sd.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} >= {(21, 20), (22, 20), (23, 20)} and {r["doc_id"] for r in found} == {21, 22, 23}
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns
    kept = {}
    for r in out.collect():
        kept.setdefault(r["doc_id"], []).append(r["text"])
    assert kept[20] == [text] and kept[21] == ["mine before mine after"] and 22 not in kept and text in kept[None]
    assert len(kept[1]) == 2 and kept[2] == [None] and kept[3] == [""]
    assert sd.repeated_passages(empty_documents(spark)).count() == 0 and sd.without_repeats(empty_documents(spark)).count() == 0


def test_parts_seen_first_in_other_documents(spark):
    """Two documents hold 60 words whose parts three earlier documents hold; a third one holds other runs of them twice."""
    rng = random.Random(6)
    w = filler(rng, 60)
    texts = [filler(rng, 30) + w[a:b] + filler(rng, 30) for a, b in [(0, 24), (24, 48), (48, 60), (0, 60), (0, 60)]]
    texts.append(w[:50] + filler(rng, 9) + w[10:60])
    found = sd.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["ref_doc_id"], r["ref_start"]) for r in found) == [(4, 30, 90, 3, 30), (5, 0, 50, 3, 30), (5, 59, 109, 3, 40)]


def test_areas_and_runs():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    for n in (1, 2, 15, 50, 64, 100, 300):
        h = sd.run_hashes(words, n)
        assert len(h) == 301 - n and h[-1] == sd.run_hashes(words[-n:], n)[0] and len(np.unique(h)) == len(h)
    assert len(sd.run_hashes(words, 301)) == 0
    _, at = sd.minimizers(words)
    gap = np.diff(at, prepend=at[:1])
    for a in range(0, 250, 7):  # the seeds of the run alone are shared
        _, own = sd.minimizers(words[a : a + 50])
        held = np.isin(at, own + a)
        areas = sd.shared_areas(at[held], gap[held], 50)
        assert all(x >= 0 and y - x >= 50 for x, y in areas)
        assert any(x <= a and y >= a + 50 for x, y in areas) and all(y - x < 90 for x, y in areas)


def test_far_chain_does_not_hide_a_near_one(spark):
    """A long shared passage, then one with a word inserted in its middle, in the same two documents."""
    seg = np.array([[0, 300, 0, 300], [500, 530, 500, 530], [531, 560, 530, 559]])
    assert sorted(len(c) for c in sd.chains(seg)) == [1, 2]
    rng = random.Random(8)
    long, w = filler(rng, 300), filler(rng, 60)
    texts = [long + filler(rng, 200) + w + filler(rng, 9), long + filler(rng, 200) + w[:30] + ["more"] + w[30:] + filler(rng, 9)]
    found = sd.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found) == [(1, 0, 300), (1, 500, 561)]


def test_chains_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, c, n = rng.integers(0, 400, 40), rng.integers(0, 400, 40), rng.integers(6, 30, 40)
        seg = np.column_stack([a, a + n, c, c + n])
        seg = seg[np.lexsort((seg[:, 2], seg[:, 0]))]
        score = np.zeros(len(seg))
        for i, (a0, b0, c0, _) in enumerate(seg.tolist()):
            gaps = [(score[j] - sd.GAP_COST * (a0 - s[1] + c0 - s[3])) for j, s in enumerate(seg.tolist()) if 0 <= a0 - s[1] <= sd.MAX_GAP and 0 <= c0 - s[3] <= sd.MAX_GAP]
            score[i] = b0 - a0 + max([0, *gaps])
        best = sd.chains(seg)[0]
        worth = sum(s[1] - s[0] for s in best.tolist()) - sd.GAP_COST * sum(y[0] - x[1] + y[2] - x[3] for x, y in zip(best.tolist(), best.tolist()[1:], strict=False))
        assert abs(worth - score.max()) < 1e-6


def test_uncovered():
    assert sd.shared_areas(np.array([2, 10, 20, 30]), np.array([0, 8, 10, 10]), 50) == []
    assert sd.uncovered([(0, 60)], [(0, 55)], 50) == [(6, 60)] and sd.uncovered([(10, 80)], [(0, 30), (30, 90)], 50) == []
    assert sd.uncovered([(10, 80)], [], 50) == [(10, 80)] and sd.uncovered([(10, 140)], [(62, 139)], 50) == [(10, 111), (90, 140)]
    assert sd.covering(np.array([3, 3, 4, 9, 53, 54, 200]), 50) == [0, 4, 5, 6]
    for at in (np.arange(5, 300), np.array([0, 60, 61, 150])):
        words = lambda starts: {w for x in starts.tolist() for w in range(x, x + 50)}
        assert words(at[sd.covering(at, 50)]) == words(at)


def plain_longest(equal, least, identity):
    best = None
    for a in range(len(equal)):
        for b in range(a + least, len(equal) + 1):
            if equal[a] and equal[b - 1] and equal[a:b].mean() >= identity - 1e-12 and (best is None or b - a > best[1] - best[0]):
                best = (a, b)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_longest_stretch(seed):
    rng = np.random.default_rng(seed)
    equal = rng.random(rng.integers(1, 60)) < rng.choice([0.3, 0.7, 0.9])
    least = int(rng.integers(1, 20))
    found, want = sd.longest(equal, least, 0.8), plain_longest(equal, least, 0.8)
    assert (found is None) == (want is None)
    if found:
        assert found[1] - found[0] == want[1] - want[0] and equal[found[0]] and equal[found[1] - 1] and equal[found[0] : found[1]].mean() >= 0.8 - 1e-9


def test_recall_of_fuzzy_passages(spark):
    """Passages with words replaced at random places, of identity 0.82 at least as a whole: of each length and share nine in ten are found."""
    rng = random.Random(11)
    pairs, rows, cells = 60, [], {}
    fresh = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    for length in (52, 60, 80, 120):
        for share in (0.05, 0.10, 0.15, 0.18):
            for _ in range(pairs):
                passage, first = fresh(length), len(rows)
                other = list(passage)
                for i in rng.sample(range(length), min(round(share * length), int(0.18 * length))):
                    other[i] = fresh(1)[0]
                rows += [(first, " ".join(fresh(60) + passage + fresh(60))), (first + 1, " ".join(fresh(45) + other + fresh(45)))]
                cells[first + 1] = (length, share)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id for r in sd.repeated_passages(docs).where("end - start >= 50").collect()}
    recall = {c: sum(d in found for d, x in cells.items() if x == c) / pairs for c in set(cells.values())}
    assert found <= set(cells) and min(recall.values()) >= 0.9, sorted(recall.items())


def python_functions_of_stages(plan):
    """How many Python functions each stage of a plan (Spark's tree of text) runs one upon another."""
    path, most = [], 0
    for line in plan.splitlines():
        at = re.search(r"[A-Za-z*(]", line)
        if not at:
            continue
        path = [p for p in path if p[0] < at.start()]
        name = line[at.start() :]
        below = 0 if "Exchange" in name.split("(")[0] else path[-1][1] if path else 0
        path.append((at.start(), below + bool(re.match(r"(\*\(\d+\) )?(\w+InPandas|\w+InArrow|\w*EvalPython)", name))))
        most = max(most, path[-1][1])
    return most


def test_a_stage_runs_one_python_function(spark, monkeypatch):
    """Each function that runs upon another takes a worker in each task, which the executor then keeps."""
    plans, write = {}, sd.materialize

    def noted(df, name, *how):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *how)

    monkeypatch.setattr(sd, "materialize", noted)
    rng = random.Random(3)
    passages = [filler(rng, 60) for _ in range(6)]
    # the runs of the last document are of one whose seeds others hold first
    rows = [(i, " ".join(filler(rng, 20) + p + filler(rng, 20))) for i, p in enumerate(passages)]
    rows += [(10, " ".join(w for p in passages for w in p)), (11, " ".join(w for p in passages for w in p))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sd.without_repeats(docs)
    plans["result"] = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6
    assert "passage-left" in plans
    assert {name: python_functions_of_stages(plan) for name, plan in plans.items() if python_functions_of_stages(plan) > 1} == {}
