import re

import numpy as np
import pytest

from plumbline.llm import queries, toxicity
from tests.llm.cases import empty_documents, odd_documents

LABELS = "doc_id long, toxic int, features string, text int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = (np.array([r["score"] for r in rows if r["toxic"] == y]) for y in (1, 0))
    auc = np.mean((toxic[:, None] > clean) + 0.5 * (toxic[:, None] == clean))
    assert auc > 0.97 and (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    share = np.mean([r["held_out"] for r in queries.op1_toxicity(spark, "/root/testdata/sf0.001").collect()])
    assert 0.1 < share < 0.3


def test_labels_alone_are_learned_from(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    none = spark.createDataFrame([], LABELS)
    scores = toxicity.fit(docs, none).score(odd_documents(spark)).collect()
    assert len(scores) == 13 and {r["score"] for r in scores} == {0.0}
    one = spark.createDataFrame([(i, 1, "x", 0) for i in range(20)] + [(None, 0, "", 0), (3, None, "", 0), (3, 0, "", 0)], LABELS)
    assert {r["score"] for r in toxicity.fit(docs, one).score(odd_documents(spark)).collect()} == {1.0}
    assert toxicity.fit(empty_documents(spark), one).score(empty_documents(spark)).count() == 0


def test_toxic_texts_go(spark):
    """By their own text, with null and repeated ids and columns of the same names as ours."""
    sf = "/root/testdata/sf0.01"
    model = queries.toxicity_model(spark, sf)
    bad = next(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").join(model.score(spark.read.parquet(f"{sf}/documents.parquet")).where("predicted = 1").select("doc_id"), "doc_id").take(1))
    rows = [(1, bad, 0, 0.0), (1, "a calm remark on the weather", 1, 0.0), (None, bad, 1, 0.0), (None, "another calm remark", 1, 0.0), (2, None, 1, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int, version double")
    assert sorted(map(tuple, model.without_toxic(docs).collect()), key=str) == sorted([r for r in rows if r[1] != bad], key=str)
    assert model.without_toxic(docs.limit(0)).count() == 0


@pytest.mark.parametrize("word,meant", [("1d10t", "idiot"), ("m0r0n!", "moron"), ("l.o.s.e.r", "loser"), ("$cum", "scum")])
def test_obfuscation(word, meant):
    assert toxicity.plain(word.strip("!")) == meant
    named = dict(zip(toxicity.FEATURES, toxicity.Lexicon({}, {}).features(f"you {word} go"), strict=True))
    assert named["fixed"] > 0 and named["obfuscated_hits"] > 0 and named["near"] > 0


def test_features():
    lexicon = toxicity.Lexicon({"grum": 4.0}, {"lowei": 5.0})
    named = dict(zip(toxicity.FEATURES, lexicon.features("YOU ALL Grum, loweian!! " + "x " * 20 + "idiot?"), strict=True))
    assert named["learned_max"] == 5.0 and named["beginnings"] > 0 and named["near"] == pytest.approx(np.log1p(2))
    assert named["caps_words"] > 0 and named["repeated"] > 0 and named["exclaim"] > 0
    assert len(lexicon.features("")) == len(toxicity.FEATURES) and not any(np.isnan(lexicon.features("")))


def plain_features(text, words, beginnings):
    """Each feature by its own definition, word by word."""
    raw = text.lower().split()
    n, size = max(1, len(raw)), max(1, len(text))
    fixed, learned, weights, begun, bad, second, odd, hidden = 0, 0, [], 0, [], [], 0, 0
    for i, r in enumerate(raw):
        word = r if r.isalpha() else r.strip(toxicity._EDGE)
        if not r.isalpha():
            odd += bool(not word.isalpha() and re.search(r"[^\W\d_]+[\d@$!|*.\-_]+[^\W\d_]", word))
            signs = set(r) & set("0123456789@$|")
            if (not word.isalpha() or signs) and word not in toxicity.INSULTS and word not in words:
                for bare in (toxicity.plain(word), toxicity.plain(r.strip(".,!?"))):
                    if bare in toxicity.INSULTS or bare in words:
                        word, hidden = bare, hidden + 1
                        break
        weight = words.get(word, 0.0)
        start = max([beginnings.get(word[:k], 0.0) for k in (4, 5, 6)]) if len(word) > 3 else 0.0
        fixed += word in toxicity.INSULTS
        learned += weight > 0
        begun += start > 0
        if max(weight, start) > 0:
            weights.append(max(weight, start))
        if word in toxicity.INSULTS or max(weight, start) > 0:
            bad.append(i)
        if word in toxicity.SECOND:
            second.append(i)
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in bad)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    marks = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    caps = len(re.findall(r"\b[A-ZÀ-Þ]{3,}\b", text)) if upper > 2 else 0
    repeated = len(re.findall(r"[!?.]{2,}|([^\w\s])\1", text)) if marks > 1 else 0
    log = np.log1p
    return dict(zip(toxicity.FEATURES, [log(len(raw)), log(len(text)), log(fixed), fixed / n, log(learned), learned / n, sum(weights) / n, max(weights, default=0.0), begun / n, log(near), near / n, len(second) / n, upper / max(1, upper + lower), caps / n, text.count("!") / size, text.count("?") / size, marks / size, repeated / n, sum("0" <= c <= "9" for c in text) / size, odd / n, log(hidden), len(set(raw)) / n], strict=True))


def test_features_of_all_documents(spark, sf):
    """Every feature of every text of the table, and of odd ones, against its definition."""
    lexicon = toxicity.Lexicon({"grum": 4.0, "the": 3.5, "clown": 3.0}, {"lowei": 5.0, "ther": 3.2})
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r["text"] or "" for r in odd_documents(spark).collect() if len(r["text"] or "") < 5000]
    texts += ["YOU 1d10t!!", "m0r0n... You're a cl0wn?", "$cum @ you", "you " * 12 + "grum", "A" * 50, "?!?!", "l.o.s.e.r ihr TÚ", "gr-um you"]
    for text in texts:
        got, want = dict(zip(toxicity.FEATURES, lexicon.features(text), strict=True)), plain_features(text, lexicon.words, lexicon.beginnings)
        assert all(got[k] == pytest.approx(want[k]) for k in want), (text[:80], {k: (got[k], want[k]) for k in want if got[k] != pytest.approx(want[k])})
