"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are rates: words of a fixed and of a learned lexicon, how near they are to a second person, capitals,
punctuation and obfuscation. The learned lexicon holds words and word beginnings that stand out in toxic documents.
The labelled rows are dealt in three by a hash: one for the lexicon, one for the trees, one for the calibration.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_small, keyed, materialize, unkeyed

#: Labelled rows that the model is fitted on, at most about; further ones are left out by a hash of doc_id.
MAX_LABELLED = 12_000
#: Entries of the learned lexicon at most, letters of a word beginning, least log odds.
MAX_ENTRIES, BEGINNINGS, LEAST_ODDS = 4000, (4, 5, 6), 3.0
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
TREES, DEPTH, STEP = 10, 4, 0.5

# Insults, and words of the second person in English, French, German and Spanish.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers pathetic scum trash worthless disgusting clown dumb fool garbage filth filthy pig ugly hate shut imbecile imbécile débile crétin connard idiote dumm dummkopf idioten abschaum arschloch tonto estúpido estupido imbécil basura asqueroso".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vos tú ti tus".split())
# Characters that stand for letters.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ["words", "chars", "fixed", "fixed_rate", "learned", "learned_rate", "learned_sum", "learned_max", "beginnings", "near", "near_rate", "second_rate", "upper", "caps_words", "exclaim", "question", "punctuation", "repeated", "digits", "obfuscated", "obfuscated_hits", "distinct"]
_SIGNS = frozenset("0123456789@$|")
_EDGE = ".,!?;:\"'()[]{}*#%&$-_…«»¡¿"
_ODD = re.compile(r"[^\W\d_]+[\d@$!|*.\-_]+[^\W\d_]")
_CAPS = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")
_REPEATED = re.compile(r"[!?.]{2,}|([^\w\s])\1")
#: Words kept with their weights in a worker.
KEPT = 100_000


def plain(word: str) -> str:
    """A lower-case word without obfuscation: stand-ins replaced, what else is no letter dropped."""
    return re.sub(r"[\W_]", "", word.translate(STANDS_FOR))


class Lexicon:
    """Weights of learned words and beginnings, with what is known of words met before."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.known: dict[str, tuple | None] = {}

    def look(self, raw: str) -> tuple | None:
        """(fixed, learned word, weight, beginning, obfuscated hit, second person, odd) of a lower-case word; mostly nothing."""
        word, hidden, odd = raw, False, False
        if not raw.isalpha():
            word = raw.strip(_EDGE)
            whole = word.isalpha()
            odd = not whole and _ODD.search(word) is not None
            if not (whole and _SIGNS.isdisjoint(raw)) and word not in INSULTS and word not in self.words:
                for bare in (plain(word), plain(raw.strip(".,!?"))):
                    if bare in INSULTS or bare in self.words:
                        word, hidden = bare, True
                        break
        weight = self.words.get(word, 0.0)
        b = self.beginnings
        start = max(b.get(word[:4], 0.0), b.get(word[:5], 0.0), b.get(word[:6], 0.0)) if b and len(word) > 3 else 0.0
        if weight or start or hidden or odd or word in INSULTS or word in SECOND:
            return word in INSULTS, weight > 0, max(weight, start), start > 0, hidden, word in SECOND, odd
        return None

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        if len(self.known) > KEPT:
            self.known.clear()
        known, distinct = self.known, {*words}
        for w in distinct:
            if w not in known:
                known[w] = self.look(w)
        hits = [(i, f) for i, w in enumerate(words) if (f := known[w]) is not None]
        n, size = max(1, len(words)), max(1, len(text))
        fixed = sum(f[0] for _, f in hits)
        learned = sum(f[1] for _, f in hits)
        begun = sum(f[3] for _, f in hits)
        weights = [f[2] for _, f in hits if f[2] > 0]
        second = [i for i, f in hits if f[5]]
        bad = [i for i, f in hits if f[0] or f[2] > 0]
        near = 0
        if second and bad:
            at = np.searchsorted(second, bad)
            s = np.array([-(10**9), *second, 10**9])
            near = int((np.minimum(np.abs(s[at] - bad), np.abs(s[at + 1] - bad)) <= NEAR).sum())
        counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
        marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
        odd = sum(f[6] for _, f in hits)
        caps = len(_CAPS.findall(text)) if upper > 2 else 0
        repeated = len(_REPEATED.findall(text)) if marks > 1 else 0
        return [
            math.log1p(len(words)), math.log1p(len(text)), math.log1p(fixed), fixed / n, math.log1p(learned), learned / n, sum(weights) / n, max(weights, default=0.0),
            begun / n, math.log1p(near), near / n, len(second) / n, upper / max(1, upper + lower), caps / n, counts[33] / size, counts[63] / size, marks / size,
            repeated / n, int(counts[48:58].sum()) / size, odd / n, math.log1p(sum(f[4] for _, f in hits)), len(distinct) / n,
        ]


class Model:
    """A lexicon, trees and calibration; without both kinds of labels, a constant."""

    def __init__(self, lexicon: Lexicon, trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, constant: float):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def _scored(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        rows = featured(rows, self.lexicon, keep)
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(self.constant))
        else:
            scored = self.calibration.transform(_raw(self.trees, rows)).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")))
        return scored.select("doc_id", *keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score, predicted) of every row, by its whole text; null is empty."""
        return unkeyed(self._scored(keyed(docs, id_col, text=text_col), []))

    def without_toxic(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs without the rows whose text is predicted as toxic, whatever their ids; columns stay as they are.

        What is joined are 64-bit hashes of the toxic texts, so the texts themselves stay where they are read as long
        as that list is small.
        """
        rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
        toxic = self._scored(rows, ["version"]).where("predicted = 1").select("version").distinct()
        toxic = broadcast_small(materialize(toxic, "toxic-texts"))
        return docs.join(toxic, F.xxhash64(docs[text_col]) == toxic["version"], "left_anti")


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows.withColumn("vector", array_to_vector("features"))).withColumn("raw", vector_to_array("probability")[1])


def featured(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) with an array of FEATURES in place of the text."""
    words, beginnings = lexicon.words, lexicon.beginnings
    names = ["doc_id", *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(words, beginnings)
        for batch in batches:
            out = batch[names].copy()
            out["features"] = [own.features(t if isinstance(t, str) else "") for t in batch["text"]]
            yield out

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", features array<double>")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and beginnings of rows (text, toxic) whose share of toxic documents stands out; counted once a document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = {s for w in {*(text or "").lower().split()} if (s := w.strip(_EDGE))}
                own = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}
                for k in own:
                    seen.setdefault(k, [0, 0])[toxic] += 1
            if len(seen) > 100_000:
                yield table(seen)
                seen.clear()
        yield table(seen)

    def table(seen: dict[str, list[int]]) -> pd.DataFrame:
        return pd.DataFrame([(k, a, b) for k, (a, b) in seen.items()], columns=["entry", "clean", "toxic"])

    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    bad, good = total[0], total[1] - total[0]
    least = max(3, math.ceil(0.015 * bad))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    found = (
        rows.select("text", "toxic")
        .mapInPandas(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= least)
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.col("odds").desc(), "entry")
        .limit(MAX_ENTRIES)
        .collect()
    )
    return Lexicon({r["entry"][1:]: r["odds"] for r in found if r["entry"][0] == "="}, {r["entry"][1:]: r["odds"] for r in found if r["entry"][0] == "^"})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the rows of docs that labels mark; labels (id, 0 or 1), of which null ones are left out.

    Ids labelled more than once are toxic if any label says so. At most about MAX_LABELLED labelled rows are used,
    chosen by a hash. Without both kinds of labels in each third, scores are the share of toxic labels (0 without any).
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > MAX_LABELLED:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1e6 * MAX_LABELLED / n))
    rows = keyed(docs, id_col, text=text_col).join(F.broadcast(marks), "doc_id")
    rows = materialize(rows.withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3))), "toxicity-labelled")
    lexicon = learn_lexicon(rows.where("third = 0"))
    train = materialize(featured(rows.where("third > 0"), lexicon, ["third", "toxic"]), "toxicity-features").coalesce(4).cache()
    counts = {(r["third"], r["toxic"]): r["count"] for r in train.groupBy("third", "toxic").count().collect()}
    if len(counts) < 4:
        share = rows.agg(F.avg("toxic")).first()[0]
        return Model(lexicon, None, None, float(share or 0.0))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, minInstancesPerNode=5, cacheNodeIds=False).fit(
        train.where("third = 1").select(array_to_vector("features").alias("vector"), F.col("toxic").cast("double").alias("label"))
    )
    held = _raw(trees, train.where("third = 2")).select("raw", F.col("toxic").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    train.unpersist()
    return Model(lexicon, trees, calibration, 0.0)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
