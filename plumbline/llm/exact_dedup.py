"""Exact dedup in two passes: a Bloom filter finds the digests that may occur twice, and only their rows are shuffled.

The first pass marks, task by task, which bits the digests of a task's rows set once and which twice. The bit arrays of
all tasks are united segment by segment; a bit of the united filter is set where two rows or more have set it. A text that
occurs twice has all its bits set there, so the second pass lets every other row straight through, without a shuffle. The
rows that are left (repeated ones, and a few false positives) are grouped by their SHA-256, which makes the result exact.

Null texts are empty texts, and those are equal to each other. Rows of null id stay only where no equal text has an id.
Of rows equal in text and id, one stays. An empty table gives an empty result. Further columns of the input are not read
by `copies`, whatever their names, and are passed on by `without_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, materialize, mix, pick, release

#: Bits of the filter for each row, at most, and bits that each row sets: about one row in 400 passes by chance.
BITS_PER_ROW, HASHES = 16, 4
#: Bits of the largest filter: 64 MB, held twice by a task of the first pass, broadcast in the second. Beyond
#: MOST_BITS / BITS_PER_ROW rows more rows pass by chance and are shuffled (48 bytes each); the result stays exact.
MOST_BITS = 1 << 29
#: Bits of the part of the filter that is united at a time.
SEGMENT = 1 << 17
#: Groups that are joined by broadcast: those of at least 1 / MOST_HOT of the rows that passed, MOST_HOT at most.
MOST_HOT = 1000


def digest(text: str | Column) -> Column:
    """SHA-256 of the text with A-Z in lower case, as binary."""
    column = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.translate(F.coalesce(column, F.lit("")), ascii_uppercase, ascii_lowercase), 256))


def bits_for(rows: int) -> int:
    """The size of the filter: a power of two of at least one segment."""
    return min(MOST_BITS, max(SEGMENT, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row of HASHES for each."""
    first = hashes.view(np.uint64)
    step = mix(first) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def _put(array: np.ndarray, places: np.ndarray) -> None:
    """Set bits at sorted, distinct places."""
    if len(places):
        byte = places >> np.uint64(3)
        starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        array[byte[starts]] |= np.bitwise_or.reduceat(np.uint8(1) << (places & np.uint64(7)).astype(np.uint8), starts)


def _is_set(array: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (array[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 != 0


_PARTS = pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _mark(bits: int):
    """Batches of hashes to the segments of a task's two bit arrays that hold any bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            places, times = np.unique(_places(batch.column(0).to_numpy(), bits), return_counts=True)
            _put(twice, places[(times > 1) | _is_set(once, places)])
            _put(once, places)
        size = SEGMENT // 8
        for i in range(bits // SEGMENT):
            a, b = once[i * size : (i + 1) * size], twice[i * size : (i + 1) * size]
            if a.any():
                yield pa.record_batch([[i], [a.tobytes()], [b.tobytes()]], schema=_PARTS)
        del once, twice
        give_back()

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by segment to one row for each segment; one segment is held at a time."""
    segment, once, twice = -1, np.empty(0, np.uint8), np.empty(0, np.uint8)
    whole = lambda: pa.record_batch([[segment], [once.tobytes()], [twice.tobytes()]], schema=_PARTS)
    for batch in batches:
        for i, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if i == segment:
                twice = twice | b | (once & a)
                once = once | a
            else:
                if segment >= 0:
                    yield whole()
                segment, once, twice = i, a, b
    if segment >= 0:
        yield whole()


def _filter(hashes: DataFrame, rows: int, which: str):
    """(bits, broadcast array) of the bits that are set once (or twice) by hashes: one column of longs, `rows` of them."""
    bits = bits_for(rows)
    parts = hashes.mapInArrow(_mark(bits), "segment long, once binary, twice binary")
    united = materialize(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_unite, "segment long, once binary, twice binary"), "bloom")
    array = np.zeros(bits // 8, np.uint8)
    for segment, part in united.select("segment", which).toLocalIterator():
        array[segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(part, np.uint8)
    release(united)
    return bits, hashes.sparkSession.sparkContext.broadcast(array.tobytes())


def passes(array: bytes, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes have all their bits set."""
    return _is_set(np.frombuffer(array, np.uint8), _places(hashes, bits)).all(axis=1)


def repeated_filter(hashes: DataFrame, rows: int):
    """A column function: whether a hash may be that of another row too. hashes: one column of longs, `rows` of them."""
    bits, shared = _filter(hashes, rows, "twice")

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, bits, h.to_numpy()))

    return maybe


def seen_filter(hashes: DataFrame, rows: int):
    """(bits, broadcast array) for passes(): whether a hash may be one of hashes. The array has MOST_BITS at most."""
    return _filter(hashes, rows, "once")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, keep_id (the largest id of its equal texts), group_size, kept and text_sha256."""
    keys = materialize(pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), digest("text").alias("digest")), "digests")
    maybe = repeated_filter(keys.select(F.xxhash64("digest")), keys.count())
    flagged = materialize(keys.withColumn("maybe", maybe(F.xxhash64("digest"))), "flagged")
    release(keys)
    rows = flagged.where("maybe").drop("maybe")
    groups = materialize(rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    bar = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("group_size") * MOST_HOT >= bar))
    found = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(groups.where(F.col("group_size") * MOST_HOT < bar), "digest"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    single = flagged.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return single.union(found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), sha))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, one row for each text, with all its columns: of equal texts, that of the largest id (of these, the largest text).

    Rows whose text occurs once pass without a shuffle. The others are reduced to one for each text before they move.
    """
    key = digest(docs[text_col])
    hashes = materialize(docs.select(F.xxhash64(key).alias("h")), "hashes")
    maybe = repeated_filter(hashes, hashes.count())
    release(hashes)
    named = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(*named, key.alias("digest"), maybe(F.xxhash64(key)).alias("maybe"))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    order = [F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col)]
    best = marked.where("maybe").groupBy("digest").agg(F.max_by(F.struct(*[f"c{i}" for i in range(len(named))]), F.struct(*order)).alias("best"))
    return marked.where("NOT maybe").select(*own).union(best.select("best.*").select(*own))
