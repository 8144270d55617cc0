import hashlib
import random
import zlib

import pytest

from plumbline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a string, key int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def turn_key(role, text):
    r = role.encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + text.encode()).hexdigest()


def rebuilt(rows, every=5):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_key(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    if not every:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows, every=5):
    convs = rebuilt(rows, every)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        inner = {q[:-1] for q in members if q}
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children), sum(q not in inner for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def branched(df):
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.turns_of(df)))


ODD = [
    (0, 0, "user", "hello"), (0, 1, "bot", "hé there"), (0, 2, None, None), (0, None, "user", "before all"),
    (1, 0, "user", "own"), (1, 0, "user", "own"), (1, 0, "user", "tied"), (1, 5, "", ""),
    (4, 7, "user", "x"), (7, 1, "user", "base 5 is absent"), (None, 0, "user", "nobody's"), (None, None, None, None),
    (10, 0, "user", "hello"), (10, 1, "bot", "hé there"), (13, 1, "a", "bc"), (13, 2, "ab", "c"), (15, 3, "ab", "c"), (15, 9, "a", "bc"),
    (-3, 0, "user", "negative"), (-3, 1, "user", "more"), (-5, 0, "user", "base"), (-(2**63), 0, "user", "least"), (2**63 - 1, 0, "user", "hello"),
]


def test_odd_rows(spark):
    assert result(branched(conversations(spark, ODD))) == brute(ODD)
    as_they_are = prefix_trie.trie(prefix_trie.plain(prefix_trie.turns_of(conversations(spark, ODD))))
    assert result(as_they_are) == brute(ODD, every=0)


def test_empty(spark):
    assert result(branched(conversations(spark, []))) == []
    assert result(branched(conversations(spark, [(None, 1, "user", "text")]))) == []


@pytest.mark.parametrize("most", [1, 3, 10])
def test_oversized_parts_are_split_again(spark, monkeypatch, most):
    """A first turn that all share, long shared openings, a branch of many, copies, and a path without branches."""
    monkeypatch.setattr(prefix_trie, "MOST_NODES", most)
    rng = random.Random(most)
    rows, shared = [], [("user", f"shared {i}") for i in range(12)]
    for c in range(0, 60, 5):
        turns = shared[: rng.randrange(1, 13)] + [("bot", f"t{rng.randrange(3)}") for _ in range(rng.randrange(4))]
        rows += [(c, n, *t) for n, t in enumerate(turns)]
    rows += [(c, n, "user", t) for c in range(100, 112) for n, t in enumerate(["copy", "of", "this"])]
    rows += [(200, n, "user", f"alone {n}") for n in range(25)]
    assert result(prefix_trie.trie(prefix_trie.plain(prefix_trie.turns_of(conversations(spark, rows))))) == brute(rows, every=0)
    if most == 3:
        assert result(branched(conversations(spark, rows))) == brute(rows)


def test_ids_of_many_blocks(spark):
    """The ids that end at a prefix are in numerical order, however they are spread over blocks."""
    rng = random.Random(2)
    rows = [(c, 0, "user", "same") for c in sorted(rng.sample(range(-50_000, 50_000), 300))]
    assert result(prefix_trie.trie(prefix_trie.plain(prefix_trie.turns_of(conversations(spark, rows))))) == brute(rows, every=0)
