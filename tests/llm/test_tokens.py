import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import packing, queries, token_counts, token_files
from plumbline.llm.common import shared_path
from plumbline.llm.tokens import encoder
from tests.llm.cases import empty_documents, odd_documents

PATH = queries.word_tokenizer()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain, spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [r["html"][:20_000] for r in spark.read.parquet(f"{sf}/pages.parquet").limit(20).collect()]
    texts += ["", "a<|endoftext|>b <|startoftext|> c", "it's we'll 12345 x²½ ǅ ΑΣ Σ é ́x", "a\x0bb\x1cc\x85d e f　g​h﻿i", "x" * 700, None]
    encode = encoder(PATH)
    assert [i.tolist() for i in encode(texts)] == [plain(t) for t in texts]
    assert encode.by_chunk
    few = encoder(PATH, 300)
    assert [i.tolist() for a in range(0, len(texts), 7) for i in few(texts[a : a + 7])] == [plain(t) for t in texts]
    encoder(PATH)


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    encode = encoder(path)
    assert not encode.by_chunk
    assert next(encode(["two  spaces here"])).tolist() == Tokenizer.from_file(path).encode("two  spaces here", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, queries.op2_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain(r["text"]), 2]
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_files_odd_rows_and_lookup(spark, plain):
    folder = shared_path(spark, "odd")
    parts = token_files.write_token_files(odd_documents(spark), folder, PATH, 2)
    rows = token_files.read_token_files(spark, parts).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == sorted((r["doc_id"] or -1, len(plain(r["text"])) + 1) for r in odd_documents(spark).collect())
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"] is not None, r["doc_id"]) for r in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    assert [s[3] for s in starts[2:]] == sorted(s[3] for s in starts[2:]) and not starts[0][2]
    found = [ids.tolist() for p in parts.collect() for ids in token_files.TokenFile(p["path"]).find(10)]
    assert found == [[*plain("you are an idiot"), 2]]


def test_token_files_empty(spark):
    parts = token_files.write_token_files(empty_documents(spark), shared_path(spark, "none"), PATH, 2)
    assert token_files.read_token_files(spark, parts).count() == 0


def check_pieces(rows, want, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, all_ids in want.items():
        parts = sorted(by_doc.pop(doc_id))
        assert len(all_ids) * (parts[0][3] // len(all_ids)) == parts[0][3]
        assert sum(p[1] for p in parts) == len(all_ids)
        assert b"".join(p[2] for p in parts) == np.array(all_ids, "<u4").tobytes()
        assert all(p[3] == len(all_ids) for p in parts)
    padding = 0
    for parts in by_seq.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: [*plain(r["text"]), 1] for r in docs.collect()}
    assert check_pieces(packing.pack(docs, PATH, 1).collect(), want) == 0
    crcs = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.op6_packing(spark, sf).collect()}
    assert all(c == crc(want[d][s : s + 2048]) for (d, s), c in crcs.items() if len(want[d]) > s + 2048 and s % 2048 == 0 and (d, s + 2048) in crcs)


def test_packing_odd_rows(spark, plain):
    rows = packing.pack(odd_documents(spark), PATH, 1).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain(r["text"])) + 1 for r in odd_documents(spark).collect())
    assert packing.pack(empty_documents(spark), PATH, 1).count() == 0
    once = odd_documents(spark).where("doc_id > 1")
    assert check_pieces(packing.pack(once, PATH, 1).collect(), {r["doc_id"]: [*plain(r["text"]), 1] for r in once.collect()}) == 0
    assert sum(r["n_tokens"] for r in packing.sequences(packing.pack(once, PATH, 1)).collect()) == sum(len(plain(r["text"])) + 1 for r in once.collect())


def test_sum_of_squares_minimises():
    rng = np.random.default_rng(1)
    packer, window = packing.SumOfSquares(32), 32
    for size in rng.integers(1, 32, 400):
        n = packer.counts.copy()
        options = []
        for level in [0, *np.flatnonzero(n).tolist()]:
            if level + size <= window:
                m = n.copy()
                if level:
                    m[level] -= 1
                if level + size < window:
                    m[level + size] += 1
                options.append((m**2).sum())
        packer.place(int(size))
        assert (packer.counts**2).sum() == min(options)


def test_token_counts(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = sorted(len(plain(r["text"])) for r in docs.collect())
    histogram = queries.op7_token_counts(spark, sf)
    rows = {r["length"]: r for r in histogram.collect()}
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["docs_below"] == sum(x < n for x in lengths)
    assert sum(r["n_docs"] for r in rows.values()) == len(lengths)
    got = token_counts.totals_at(histogram, [1, 500, 10**9]).collect()
    assert [(r["docs_over"], r["tokens_kept"]) for r in got] == [(sum(x > c for x in lengths), sum(min(x, c) for x in lengths)) for c in (1, 500, 10**9)]
    assert token_counts.quantile(histogram, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    odd = token_counts.length_histogram(odd_documents(spark), PATH)
    assert odd.agg(F.sum("n_docs")).first()[0] == 13 and odd.where("length = 0").first()["n_docs"] == 4
    assert token_counts.length_histogram(empty_documents(spark), PATH).count() == 0
