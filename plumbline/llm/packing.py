"""Packing: sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each task packs the documents of its own partition as they come (nothing is shuffled). A document's full windows go
out at once; what is left of it is placed into the fill level that makes the sum of the squared counts of partially
filled windows least (Csirik et al., 2006), tracked in an array of counts by level. When a task ends, its partial
windows are joined by cutting and written as sequences of the window's size and, at the end, of powers of two, which
need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keyed, unkeyed
from plumbline.llm.tokens import KEPT, encoder, forget

WINDOW = 2048
#: Sequences in a partition, at most: the sequence number is partition * SPAN + count.
SPAN = 1 << 38
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Open windows by fill level. `place` says where an item goes; counts[h] is the number of open windows filled to h."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(number of the window, offset) of an item of 1 to window - 1 tokens; ties: the fullest level.

        Moving a window from level h to h + size changes the sum of squares by 2 * (n(h + size) - n(h)) + 2, without
        the first term where the window becomes full; opening one adds 2 * n(size) + 1.
        """
        n, w = self.counts, self.window
        levels = np.flatnonzero(n[1 : w - size + 1]) + 1
        best, level = 2 * int(n[size]) + 1, 0
        if len(levels):
            change = 2 * (n[levels + size] - n[levels]) + 2
            if levels[-1] == w - size:
                change[-1] = 1 - 2 * n[w - size]
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = int(levels[at])
        if level:
            number = self.open[level].pop()
            n[level] -= 1
        else:
            number = self.made
            self.made += 1
        if level + size < w:
            self.open[level + size].append(number)
            n[level + size] += 1
        return number, level


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kept: int = KEPT) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every document, ids with end_id last.

    ids: the piece's ids, little-endian unsigned 32-bit. Each id of each row lies in exactly one piece; the pieces of
    a sequence are gapless from 0. Null or empty texts are one piece of the end id; null and repeated doc_ids stay as
    they are. Sequences have `window` tokens (a power of two), but for the last of a task, which are powers of two.
    Memory: one batch, the ids of `kept` words, and the partial windows of a task, of which sum-of-squares keeps few of
    each level.
    """
    assert window & (window - 1) == 0
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path, kept)
        base = TaskContext.get().partitionId() * SPAN
        packer = SumOfSquares(window)
        partial: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encode(batch["text"], end_id), strict=True):
                n = len(ids)
                full = n - n % window
                for at in range(0, full, window):
                    rows.append((doc_id, at, window, n, base + packer.made, 0, ids[at : at + window].tobytes()))
                    packer.made += 1
                if n > full:
                    number, level = packer.place(n - full)
                    partial.setdefault(number, []).append((doc_id, full, n - full, n, base + number, level, ids[full:].tobytes()))
                    if level + n - full == window:
                        rows += partial.pop(number)
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        rows += _joined([r for number in sorted(partial) for r in partial[number]], base + packer.made, window)
        if rows:
            yield pd.DataFrame(rows, columns=columns)
        if kept < KEPT:  # where memory is short, the encoder goes with the task
            del encode
            forget(tokenizer_path)

    return unkeyed(keyed(docs, id_col, text=text_col).mapInPandas(run, SCHEMA))


def _joined(pieces: list[tuple], number: int, window: int) -> Iterator[tuple]:
    """The pieces anew in sequences of the window's size, then of the powers of two that the rest is made of."""
    left = sum(p[2] for p in pieces)
    room = used = 0
    for doc_id, start, length, total, _, _, ids in pieces:
        at = 0
        while at < length:
            if room == used:
                number += bool(room)
                room, used = min(window, 1 << (left.bit_length() - 1)), 0
            take = min(length - at, room - used)
            yield doc_id, start + at, take, total, number, used, ids[4 * at : 4 * (at + take)]
            at, used, left = at + take, used + take, left - take


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row (sequence_id, n_tokens, doc_ids, ids) for each sequence, its pieces in order; at most a window's tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"))
    )
