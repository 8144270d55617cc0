import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import token_alignment as ta
from tests.llm.cases import empty_documents, odd_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [" ", "  two  spaces ", "a\tb\n\nc \n d", "▁ the sign of spaces ▁", "x▁y z", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト　全角", "👩‍👩‍👧 é \u0000 \x1c \x85 ﬁ Å", "a" * 3000, " lead", "trail ", "don't 'll 1234 -- ...", "　x 　 y", "\n", "mixed ​ zero"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    special = {c: i for i, c in enumerate(byte_characters())}
    a_bytes = {i: bytes(special[c] for c in t) for t, i in a.get_vocab().items() if all(c in special for c in t)}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def byte_characters():
    out, n = [], 0
    for i in range(256):
        if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174:
            out.append(chr(i))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def plain_groups(text, tokenizers):
    """The groups of a text as pairs of id lists, by walking both lists of ends."""
    a, b, a_bytes, b_bytes = tokenizers
    if not text:
        return []
    x, y, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    if b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
        return []
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    ea, eb = ends(x, a_bytes), ends(y, b_bytes)
    both = sorted(set(ea) & set(eb))
    groups, i, j = [], 0, 0
    for at in both:
        p, q = ea.index(at, i) + 1, eb.index(at, j) + 1
        groups.append((x[i:p], y[j:q]))
        i, j = p, q
    return groups


def brute(rows, tokenizers):
    docs = [plain_groups(t, tokenizers) for _, t in rows]
    links = [Counter((x, y) for g in d for x in g[0] for y in g[1]) for d in docs]
    count = Counter(pair for d in links for pair in d)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (doc_id, _), d, own in zip(rows, docs, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d)
        out.append((doc_id, sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), sum(own.values()), sum(t for p, t in own.items() if count[p] == most[p[0]]), sum(t * count[p] for p, t in own.items()), hashlib.sha256(text.encode()).hexdigest() if d else ""))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_texts(spark, tokenizers):
    docs = odd_documents(spark).where("length(text) < 1000 OR text IS NULL").selectExpr("doc_id", "text", "keys", "'other' AS codes", "'other' AS row")
    docs = docs.union(spark.createDataFrame([(100 + n, t, "x", "y", "z") for n, t in enumerate(ODD_TEXTS)], docs.schema))
    assert result(ta.link_statistics(docs, A, B)) == brute([(r.doc_id, r.text) for r in docs.collect()], tokenizers)


def test_empty_table(spark):
    assert result(ta.link_statistics(empty_documents(spark), A, B)) == []


def test_whole_table(spark, sf, tokenizers):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(ta.link_statistics(docs, A, B)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizers)


def test_rare_codes_by_a_join(spark, sf, tokenizers, monkeypatch):
    """With room for few codes, the frequent ones come by broadcast and the others by a join: the same result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.orderBy("doc_id").limit(5))
    monkeypatch.setattr(ta, "MOST_CODES", 40)
    assert result(ta.link_statistics(docs, A, B)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizers)


def test_groups_as_text(spark, tokenizers):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, None)], "doc_id long, text string")
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain_groups("The quick brown fox", tokenizers))
    assert sorted((r.doc_id, r.groups) for r in ta.aligned(docs, A, B, as_text=True).collect()) == [(1, want), (2, "")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab é'.\n\t　▁0日👩\x1c", "the ", " in", "ing ", "  "]), max_size=12).map("".join), min_size=1, max_size=4))
def test_pieces_equal_whole_texts(tokenizers, texts):
    made = ta.aligner(A, B)
    assert made.cuts
    for text, d in zip(texts, made.documents(texts, True), strict=True):
        groups = plain_groups(text, tokenizers)
        assert d[6] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        own = Counter(x * made.size_b + y for g in groups for x in g[0] for y in g[1])
        assert dict(zip(d[4].tolist(), d[5].tolist(), strict=True)) == own
        assert list(d[:4]) == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(own.values())]


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_large_groups(most, monkeypatch):
    """Groups whose tokens are made distinct first give the same links."""
    monkeypatch.setattr(ta, "PLAIN_PAIRS", most)
    rng = random.Random(most)
    a, b = (np.array([rng.randrange(5) for _ in range(n)]) for n in (40, 30))
    ga, gb = (np.sort(np.r_[np.arange(6), [rng.randrange(6) for _ in range(len(i) - 6)]]) for i in (a, b))
    codes, times, sizes = ta.aligner(A, B)._codes(a, b, ga, gb, np.bincount(ga), np.bincount(gb))
    at = np.r_[0, np.cumsum(sizes)]
    for g in range(6):
        found = Counter()
        for c, t in zip(codes[at[g] : at[g + 1]].tolist(), times[at[g] : at[g + 1]].tolist(), strict=True):
            found[c] += t
        assert found == Counter(int(x) * 32000 + int(y) for x in a[ga == g] for y in b[gb == g])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_groups_are_cut_where_both_end(x, y):
    short = min(sum(x), sum(y))
    ends = [np.array(sorted({e for e in np.cumsum(v).tolist() if e < short} | {short})) for v in (x, y)]
    ga, gb = ta.groups_of(*ends)
    both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    for group, e in zip((ga, gb), ends, strict=True):
        assert group.tolist() == [sum(c < v for c in both) for v in e.tolist()]
