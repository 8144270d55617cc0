"""Cross-tokenizer alignment: which tokens of tokenizer A cover the same bytes as which of tokenizer B, and how often.

A text (with the space before it that B adds) is tiled by the tokens of A and by those of B. The tokens of B are a static
interval index: their starts and ends, sorted. Each token of A is looked up in it by bisection, for the first and the last
token of B that it overlaps; it spans the gaps between those. A gap of B that no token of A spans is a place where tokens
of both end: there a group ends and the next begins. Tokens of A and B in one group are linked.

Texts are cut before single spaces between words, where no token of either tokenizer crosses (read from the files; for
others the text is one piece). A piece that a worker has met before is not aligned again. The distinct links of each document
are written once, as differences of sorted codes; documents that hold a link are counted per task first, and the counts,
far fewer than the links of the documents, come back by broadcast up to MOST_CODES of them (the most frequent ones, a
number bounded by the counts' sum) and by a join for the others.

Handling: texts that are null or empty, and those whose tokens don't give back their bytes (of either tokenizer), have no
tokens, hence zeros and an empty groups_sha256. Each row is a document of its own, whatever its id. Very long texts are
aligned whole; the links of one group are all pairs of its distinct ids. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_small, give_back, keyed, materialize, release, unkeyed

#: Codes that are broadcast with their counts (16 bytes each), and those that a task holds while it counts.
MOST_CODES, HELD_CODES = 1 << 21, 1 << 22
#: Pieces that a worker keeps, the longest of them, pieces encoded as one text, and characters of texts worked on at a time.
KEPT, LONGEST, GROUP, CHUNK = 150_000, 100, 500, 1 << 21
#: Pairs of a group up to which its tokens are paired as they stand; those of larger groups are made distinct first.
PLAIN_PAIRS = 4096

_INSIDE = re.compile(r" (?!\S)")
_CUT = re.compile(r"(?<=[^ ])(?= \S)")


class ByteVocabulary:
    """A byte-level tokenizer of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # bytes that are printable in Latin-1 stand for themselves, the others for characters from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceVocabulary:
    """A sentencepiece model with byte fallback, which puts a space before each text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        sample = "Å ﬁ  x 　y"
        given_back = b"".join(self.bytes[i] for i in self.model.encode(sample)) == (" " + sample).encode()
        self.cuts = given_back and not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def vocabulary(path: str) -> ByteVocabulary | PieceVocabulary:
    return PieceVocabulary(path) if path.endswith(".model") else ByteVocabulary(path)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from 0, by the bytes at which they end; both tile the same bytes."""
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left") - 1
    n = len(b_ends)
    spans = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1))[:n]
    group = np.r_[0, np.cumsum(spans[: n - 1] == 0)]
    return group[first], group


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(a_path: str, b_path: str) -> "Aligner":
    """One for each Python worker and pair of files."""
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(vocabulary(a_path), vocabulary(b_path))
    return _aligners[key]


class Aligner:
    """Aligned pieces, and documents put together from them.

    A piece is what follows a space. Of each: tokens of A and of B, groups, links, the codes of its links (a x size of B + b)
    with how often each occurs, and its groups as text; None where the tokens don't give back its bytes.
    """

    def __init__(self, a: ByteVocabulary | PieceVocabulary, b: ByteVocabulary | PieceVocabulary):
        self.a, self.b, self.cuts = a, b, a.cuts and b.cuts
        self.size_b = len(b.bytes)
        self.lengths = [np.array([len(t) for t in v.bytes]) for v in (a, b)]
        # the decimal ids of A, then those of B, each as it stands inside a list, then each as it ends one
        inside = [b"%d," % i for v in (a, b) for i in range(len(v.bytes))]
        at_end = [b"%d%s" % (i, mark) for v, mark in ((a, b"|"), (b, b";")) for i in range(len(v.bytes))]
        self.words = np.array(inside + at_end, object)
        self.kept: dict[str, tuple | None] = {}

    def pieces(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return [p[1:] for p in _CUT.split(" " + text)] if _INSIDE.search(" " + text) else text.split(" ")

    def look_up(self, pieces: list[str]) -> list[tuple | None]:
        missing = [p for p in pieces if p not in self.kept]
        if len(self.kept) + len(missing) > KEPT:
            self.kept = dict(itertools.islice(self.kept.items(), KEPT // 2))  # pieces met first are the frequent ones
            give_back()
            missing = [p for p in pieces if p not in self.kept]
        joined = [p for p in missing if self.cuts and p and not p[0].isspace() and p[-1] != " "]
        for n in range(0, len(joined), GROUP):
            self._align(joined[n : n + GROUP])
        for p in missing:
            if p not in self.kept:
                self._align([p])
        out = [self.kept[p] for p in pieces]
        for p in missing:
            if len(p) > LONGEST:
                del self.kept[p]
        return out

    def _align(self, pieces: list[str]) -> None:
        """Align pieces as one text, with a space between them; one by one where that doesn't give back their bytes."""
        text = " ".join(pieces)
        whole = (" " + text).encode("utf-8", "surrogatepass")
        ids = [v.encode([text])[0] for v in (self.a, self.b)]
        if any(b"".join(map(v.bytes.__getitem__, i)) != whole for v, i in zip((self.a, self.b), ids, strict=True)):
            if len(pieces) > 1:
                for p in pieces:
                    self._align([p])
            else:
                self.kept[text] = None
            return
        a, b = (np.array(i, np.int64) for i in ids)
        a_ends, b_ends = (np.cumsum(n[i]) for n, i in zip(self.lengths, (a, b), strict=True))
        ends = np.cumsum([1 + len(p.encode("utf-8", "surrogatepass")) for p in pieces])
        a_cuts, b_cuts = (np.r_[0, np.searchsorted(e, ends, "right")] for e in (a_ends, b_ends))
        ga, gb = groups_of(a_ends, b_ends)
        groups = np.r_[gb[b_cuts[:-1]], gb[-1] + 1]
        na, nb = np.bincount(ga), np.bincount(gb)
        links = na * nb
        codes, times, sizes = self._codes(a, b, ga, gb, na, nb)
        code_cuts = np.r_[0, np.cumsum(sizes)][groups].tolist()
        link_cuts = np.r_[0, np.cumsum(links)][groups].tolist()
        # groups as text: the tokens of A and B of each group in turn
        order = np.argsort(np.r_[2 * ga, 2 * gb + 1], kind="stable")
        ends_list = np.r_[np.r_[ga[1:] != ga[:-1], True], np.r_[gb[1:] != gb[:-1], True]]
        word = np.r_[a, b + len(self.a.bytes)] + ends_list * (len(self.words) // 2)
        words = self.words[word[order]].tolist()
        a_cuts, b_cuts, groups = a_cuts.tolist(), b_cuts.tolist(), groups.tolist()
        for n, p in enumerate(pieces):
            (a0, a1), (b0, b1), (c0, c1) = ((c[n], c[n + 1]) for c in (a_cuts, b_cuts, code_cuts))
            self.kept[p] = (a1 - a0, b1 - b0, groups[n + 1] - groups[n], link_cuts[n + 1] - link_cuts[n], codes[c0:c1].tobytes(), times[c0:c1].tobytes(), b"".join(words[a0 + b0 : a1 + b1])[:-1])

    def _codes(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the links by group, how often each, and how many a group has; not distinct in small groups."""
        a0, b0 = np.cumsum(na) - na, np.cumsum(nb) - nb
        large = np.flatnonzero(na * nb > PLAIN_PAIRS)
        sizes = np.where(na * nb > PLAIN_PAIRS, 0, na * nb)
        each = np.where(sizes[ga] > 0, nb[ga], 0)
        codes = np.repeat(a, each) * self.size_b + b[_ragged(b0[ga], each)]
        times = np.ones(len(codes), np.int64)
        if len(large):
            parts, cuts = [], np.r_[0, np.cumsum(sizes)]
            done = 0
            for g in large.tolist():
                (x, nx), (y, ny) = (np.unique(i[s : s + n], return_counts=True) for i, s, n in ((a, a0[g], na[g]), (b, b0[g], nb[g])))
                parts += [(codes[done : cuts[g]], times[done : cuts[g]]), ((x[:, None] * self.size_b + y).ravel(), (nx[:, None] * ny).ravel())]
                sizes[g], done = len(x) * len(y), cuts[g]
            parts.append((codes[done:], times[done:]))
            codes, times = (np.concatenate([p[i] for p in parts]) for i in range(2))
        return codes, times, sizes

    def documents(self, texts: list[str], as_text: bool) -> Iterator[tuple]:
        """Of each text: tokens of A, of B, groups, links, sorted distinct codes of links, how often each, groups as text or digest."""
        lists = [self.pieces(t) if t else [] for t in texts]
        offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
        coded = pa.array(list(itertools.chain.from_iterable(lists)), pa.large_string()).dictionary_encode()
        met = self.look_up(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        known = [m or (0, 0, 0, 0, b"", b"", b"") for m in met]
        sums = lambda v: np.diff(np.r_[0, np.cumsum(np.asarray(v, np.int64)[at])][offsets])
        bad = sums([m is None for m in met]) > 0
        numbers = np.stack([sums([m[i] for m in known]) for i in range(4)], axis=1)
        numbers[bad] = 0
        strings = np.array([m[6] for m in known] + [b""], object)
        # each distinct piece of a document once, then each distinct code
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        n = max(1, len(known))
        pairs, often = np.unique((doc * n + at)[~bad[doc]], return_counts=True)
        pool, pool_times = (np.frombuffer(b"".join([m[i] for m in known]), np.int64) for i in (4, 5))
        sizes = np.array([len(m[4]) // 8 for m in known], np.int64)
        starts = np.cumsum(sizes) - sizes
        owner, piece = np.divmod(pairs, n)
        places = _ragged(starts[piece], sizes[piece])
        space = len(self.a.bytes) * self.size_b
        keys = np.repeat(owner, sizes[piece]) * space + pool[places]
        weights = pool_times[places] * np.repeat(often, sizes[piece])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        keys, weights = keys[firsts], np.add.reduceat(weights[order], firsts) if len(keys) else weights
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * space)
        for d in range(len(texts)):
            groups = "" if bad[d] or not texts[d] else b";".join(strings[at[offsets[d] : offsets[d + 1]]].tolist())
            shown = (groups.decode() if groups else "") if as_text else hashlib.sha256(groups).hexdigest() if groups else ""
            yield (*numbers[d].tolist(), keys[cuts[d] : cuts[d + 1]] - d * space, weights[cuts[d] : cuts[d + 1]], shown)


def _pack(values: np.ndarray, dtype: type) -> bytes:
    """Byte planes, which compress well: the first bytes of all values, then the second ones."""
    return values.astype(dtype).view(np.uint8).reshape(len(values), np.dtype(dtype).itemsize).T.tobytes()


def _unpack(raw: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(dtype).ravel().astype(np.int64)


def _in_parts(texts: list[object]) -> Iterable[list[str]]:
    """Texts, null as empty, of about CHUNK characters at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text if isinstance(text, str) else "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """One row for each of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (groups where as_text), and the
    distinct codes of its links with how often each occurs, packed."""
    shown = "groups" if as_text else "groups_sha256"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", shown, "codes", "times"]
    types = [pa.int64()] * 5 + [pa.large_string() if as_text else pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a_path, b_path)
        dtype = np.uint32 if len(made.a.bytes) * made.size_b < 1 << 32 else np.uint64
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for part in _in_parts(batch.column("text").to_pylist()):
                rows = [(i, *d[:4], d[6], _pack(np.diff(d[4], prepend=0), dtype), _pack(d[5], np.uint32)) for i, d in zip(ids[at : at + len(part)], made.documents(part, as_text), strict=True)]
                at += len(part)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return keyed(docs, id_col, text=text_col).mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {shown} string, codes binary, times binary")


def _codes_of(batch: pa.RecordBatch, dtype: type) -> list[np.ndarray]:
    return [np.cumsum(_unpack(c, dtype)) for c in batch.column("codes").to_pylist()]


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate([h[i] for h in held]) for i in range(2))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[firsts], np.add.reduceat(counts, firsts)


def link_counts(rows: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(code, n, best): how many of the aligned rows hold each link, and whether none of the same A id is held by more."""
    dtype = np.uint32 if sizes[0] * sizes[1] < 1 << 32 else np.uint64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        put = lambda: pa.record_batch([*_merge(held)], names=["code", "n"])
        for batch in batches:
            for codes in _codes_of(batch, dtype):
                if len(codes):
                    held.append((codes, np.ones(len(codes), np.int64)))
                    size += len(codes)
                if size > HELD_CODES:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > HELD_CODES // 2:
                        yield put()
                        held, size = [], 0
        if held:
            yield put()

    counts = materialize(rows.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "counts")
    a = F.floor(F.col("code") / F.lit(sizes[1])) if sizes[0] * sizes[1] < 1 << 50 else F.expr(f"code div {sizes[1]}")
    most = materialize(counts.groupBy(a.cast("long").alias("a")).agg(F.max("n").alias("most")), "most")
    out = materialize(counts.withColumn("a", a.cast("long")).join(broadcast_small(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "links")
    release(counts, most)
    return out


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links that no other of their A id outnumbers), count_sum (documents that hold each link, summed) and groups_sha256."""
    sizes = tuple(len(vocabulary(p).bytes) for p in (a_path, b_path))
    dtype = np.uint32 if sizes[0] * sizes[1] < 1 << 32 else np.uint64
    rows = materialize(aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = link_counts(rows, sizes)
    many, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # of counts that sum to total, at most MOST_CODES are this large
    bar = 0 if many <= MOST_CODES else total // MOST_CODES + 1
    found = counts.where(F.col("n") >= bar).orderBy("code").toArrow()
    arrays = [found.column(c).to_numpy() for c in ("code", "n", "best")]
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists = _codes_of(batch, dtype)
            cuts = np.r_[0, np.cumsum([len(x) for x in lists])]
            codes = np.concatenate([np.empty(0, np.int64), *lists])
            times = np.concatenate([np.empty(0, np.int64), *[_unpack(t, np.uint32) for t in batch.column("times").to_pylist()]])
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            here = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            sums = [np.diff(np.r_[0, np.cumsum(np.where(here, times * w[at], 0) if len(known) else np.zeros(len(codes), np.int64))][cuts]) for w in (best, n)]
            away = np.flatnonzero(~here)
            edges = pa.array(np.searchsorted(away, cuts), pa.int32())
            left = [pa.ListArray.from_arrays(edges, pa.array(v[away], pa.int64())) for v in (codes, times)]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), *left], names=[*names, "n_best", "count_sum", "left_codes", "left_times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long, left_codes array<long>, left_times array<long>"
    scored = rows.mapInArrow(look_up, schema)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if bar == 0:
        return unkeyed(scored.select(*out))
    # links of rarer codes, none of which is in many rows
    scored = materialize(scored, "scored")
    links = scored.select("row", F.explode(F.arrays_zip("left_codes", "left_times")).alias("l")).select("row", F.col("l.left_codes").alias("code"), F.col("l.left_times").alias("times"))
    rest = links.join(counts.where(F.col("n") < bar), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return unkeyed(scored.join(rest, "row", "left").withColumns(both).select(*out))
