"""Document fingerprints: MinHash signatures by universal hashes in numpy; near copies by bands, verified by Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, connected_components, keyed, materialize, mix, partitions, shingle_hashes, unkeyed, word_hashes
from plumbline.llm.jaccard_join import verified_links

#: Hashes of a signature (16 bits of each are kept), characters of a fingerprint's shingle, words of a near copy's shingle.
HASHES, CHARACTERS, WORDS = 128, 7, 5
#: Rows of a band: sets of similarity 0.8 share one of the 25 bands with a probability of 0.99995.
BAND = 5
#: Shingles hashed in one go.
BLOCK = 512

_RNG = np.random.Generator(np.random.PCG64(11))
_A = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
#: Minima of no shingles.
NONE = np.full(HASHES, 2**32 - 1, np.uint32)


def minima(shingles: np.ndarray, least: np.ndarray = NONE) -> np.ndarray:
    """The least value of each of the HASHES functions (a * x + b mod 2^32, of the shingle's upper half) over shingles and `least`."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), BLOCK):
        values = np.multiply.outer(x[at : at + BLOCK], _A)
        values += _B
        least = np.minimum(least, values.min(axis=0))
    return least


def bits(least: np.ndarray) -> np.ndarray:
    """16 bits of each minimum."""
    return (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def signature(shingles: np.ndarray) -> np.ndarray:
    return bits(minima(shingles))


def text_shingles(text: str) -> np.ndarray:
    """Hashes of all runs of CHARACTERS code points (A-Z lower-cased); of a shorter text, of the whole; of none, nothing."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    return shingle_hashes(mix(points + np.uint64(1)), CHARACTERS)


def _hex(least: np.ndarray, text: str) -> str:
    return bits(least).astype(">u2").tobytes().hex() if text else ""


def fingerprint(text: str) -> str:
    """The signature in hexadecimal; of an empty text, empty."""
    return _hex(minima(text_shingles(text)), text)


def edited_pair(text: str, edited: str, kept: int) -> tuple[str, str]:
    """The fingerprints of two texts whose first `kept` characters are the same: the minima of those are taken once."""
    a, b = text_shingles(text), text_shingles(edited)
    both = max(0, kept - CHARACTERS + 1)
    same = minima(a[:both])
    return _hex(minima(a[both:], same), text), _hex(minima(b[both:], same), edited)


def likeness(a: str, b: str) -> float:
    """The share of equal minima of two fingerprints, an estimate of the Jaccard similarity; two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, extra, doc_id, text): rows dealt by ranges of doc_id; to each bucket also the first rows of the next.

    Sorted by extra, doc_id and text, the row after a bucket's last own row is the next document of the corpus; after
    the last document comes the first. What passes the driver is one id for each bucket.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    wanted = 4 * partitions(spark)
    cuts = rows.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    number = rows.withColumn("at", F.col("doc_id").cast("double"))
    if len(splits) < 3:
        dealt = number.withColumn("bucket", F.lit(0))
    else:
        dealt = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(number).withColumn("bucket", F.col("bucket").cast("int"))
    first = sorted((r["bucket"], r["least"]) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("least")).collect())
    after = [(least, first[i - 1][0]) for i, (_, least) in enumerate(first)]
    edges = spark.createDataFrame(after, "least long, before int")
    both = F.array(F.struct("bucket", F.lit(0).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra")))
    own = F.array(F.struct("bucket", F.lit(0).alias("extra")))
    joined = dealt.join(F.broadcast(edges), F.col("doc_id") == F.col("least"), "left")
    return joined.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), both).otherwise(own))).select("to.bucket", "to.extra", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row's text and of its edited text, whose last quarter of code points is the next text's first.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty; rows are taken in the order of (doc_id, text), null ids first, so repeated ids have a fixed next row; a
    single row is its own next. Of an empty table, no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(ids: list[int], texts: list[str], after: str) -> pd.DataFrame:
            chain = [*texts, after]
            kept = [len(t) - len(t) // 4 for t in texts]
            edited = [t[:k] + n[: len(t) - k] for t, n, k in zip(texts, chain[1:], kept, strict=True)]
            pairs = [edited_pair(t, e, k) for t, e, k in zip(texts, edited, kept, strict=True)]
            prints, changed = [*[p for p, _ in pairs], fingerprint(after)], [e for _, e in pairs]
            return pd.DataFrame(
                {
                    "doc_id": ids,
                    "n_chars": [len(t) for t in texts],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": prints[:-1],
                    "edited_fingerprint": changed,
                    "near_edited": [likeness(a, b) for a, b in zip(prints, changed, strict=False)],
                    "near_next": [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)],
                }
            )

        ids: list[int] = []
        texts: list[str] = []
        bucket, over = None, False
        for batch in batches:
            for b, extra, doc_id, text in batch.itertuples(index=False, name=None):
                if b != bucket:
                    bucket, over = b, False
                if over:
                    continue
                if extra:
                    if ids:
                        yield flush(ids, texts, text)
                    ids, texts, over = [], [], True
                    continue
                if len(ids) >= 500:
                    yield flush(ids, texts, text)
                    ids, texts = [], []
                ids.append(doc_id)
                texts.append(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = with_next(docs, id_col, text_col)
    return unkeyed(dealt.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text").mapInPandas(run, schema))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, component_id) of the documents that link: a shared band makes a candidate, the Jaccard of WORDS-word shingles decides.

    Documents that share a band are joined with the first of them; what hangs together is compared by verified_links,
    so no band's documents are paired with each other. Null ids and texts without words have no links.
    """
    rows = keyed(docs, id_col, text=text_col).where((F.col("doc_id") != NULL_ID) & F.col("text").isNotNull())

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, words in zip(batch["doc_id"], word_hashes(batch["text"]), strict=True):
                if len(words):
                    s = signature(shingle_hashes(words, WORDS)).astype(np.uint64)[: HASHES // BAND * BAND].reshape(-1, BAND)
                    at = np.arange(len(s), dtype=np.uint64)
                    for c in range(BAND):
                        at = mix(at * np.uint64(0x9E3779B97F4A7C15) + s[:, c])
                    ids.append(np.full(len(s), doc_id, np.int64))
                    keys.append(at.view(np.int64))
            yield pd.DataFrame({"doc_id": np.concatenate(ids or [np.empty(0, np.int64)]), "band": np.concatenate(keys or [np.empty(0, np.int64)])})

    dealt = materialize(rows.mapInPandas(bands, "doc_id long, band long"), "bands")
    first = dealt.groupBy("band").agg(F.min("doc_id").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = dealt.join(first, "band").select("u", F.col("doc_id").alias("v"))
    subtrees = materialize(connected_components(meeting, "band-meeting"), "band-groups")
    links = verified_links(rows, subtrees, WORDS, percent)
    return connected_components(links, "near-copies").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
