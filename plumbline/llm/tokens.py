"""Encoding of whole texts by a tokenizer file, with the ids of each chunk between white space kept for its next use."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import give_back

#: White space besides space, tab, line feed and carriage return: such texts are encoded as they are.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -​    　﻿]")
#: Marks that are cut from the end of a word; each is a word's own where no letter follows.
_MARKS = ".,!?;:"
#: Chunks kept in a worker, about 150 bytes each, and the longest that is kept.
KEPT, LONGEST = 400_000, 200
#: Characters of texts encoded at a time, words of letters encoded as one text, and words whose results (many times
#: the ids kept of them) the tokenizer holds at once.
CHUNK, GROUP, AT_ONCE = 1 << 21, 500, 20_000

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str, kept: int = KEPT) -> "Encoder":
    """The encoder of a tokenizer file, one for each Python worker; it keeps `kept` chunks, which bounds memory, not results."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        give_back()
    _encoders[path].most = kept
    return _encoders[path]


def forget(path: str) -> None:
    """Give a worker's encoder back: workers live on, and what they keep is missing in the stages that follow."""
    _encoders.pop(path, None)
    give_back()


class Encoder:
    """Encodes as `Tokenizer.encode(text, add_special_tokens=False)` does, for tokenizers whose words end at white space.

    Such a tokenizer drops white space between words, so the ids of a text are those of its chunks, one after
    another. Whether that holds is read from the file (its split pattern must exclude white space and remove it);
    for any other file whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = _word_end(path)
        self.by_chunk = suffix is not None
        if suffix is not None:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.kept: dict[str, bytes] = {}
        self.most = KEPT

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for a in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Keep the ids of words of letters only: GROUP of them are encoded as one text and told apart by the ids that end a word."""
        for a in range(0, len(words), AT_ONCE):
            self._groups(words[a : a + AT_ONCE])

    def _groups(self, words: list[str]) -> None:
        parts = [words[a : a + GROUP] for a in range(0, len(words), GROUP)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                raw, edges = ids.tobytes(), (4 * ends).tolist()
                self.kept.update(zip(part, [raw[a:b] for a, b in zip([0, *edges], edges, strict=False)], strict=True))
            else:  # a letter whose lower case is no letter alone
                self.kept.update(zip(part, self._whole(part), strict=True))

    def __call__(self, texts: Iterable[object], end: int | None = None) -> Iterator[np.ndarray]:
        """uint32 ids of each text, then `end` where given; null is empty. About CHUNK characters are held at a time."""
        last = b"" if end is None else np.uint32(end).tobytes()
        held, size = [], 0
        for text in texts:
            held.append(text if isinstance(text, str) else "")
            size += len(held[-1])
            if size >= CHUNK:
                yield from self._encode(held, last)
                held, size = [], 0
        yield from self._encode(held, last)

    def _encode(self, texts: list[str], last: bytes) -> Iterator[np.ndarray]:
        end = np.frombuffer(last, np.uint32)
        split = [self.by_chunk and not _ODD_SPACE.search(text) for text in texts]
        plain = iter(self._by_words([text for text, s in zip(texts, split, strict=True) if s]))
        for text, s in zip(texts, split, strict=True):
            yield np.concatenate([next(plain) if s else np.frombuffer(self._whole([text])[0], np.uint32), end])

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, looked up once for each distinct word of them all."""
        if not texts:
            return []
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        # marks after a word of letters are a word of their own, and ASCII case makes no difference
        bare = pc.utf8_rtrim(chunks, characters=_MARKS)
        letters = pc.utf8_is_alpha(bare)
        word = pc.if_else(letters, pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare), chunks)
        tailed = np.flatnonzero(pc.and_(letters, pc.not_equal(pc.binary_length(chunks), pc.binary_length(bare))).to_numpy(zero_copy_only=False))
        tail = pc.struct_field(pc.extract_regex(chunks.take(pa.array(tailed)), f"(?P<tail>[{_MARKS}]+)$"), "tail").cast(chunks.type)
        pieces = pa.concat_arrays([word, tail, pa.array([""], chunks.type)]).dictionary_encode()
        piece = pieces.indices.to_numpy()
        parts = self._ids(pieces.dictionary)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, starts = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(sizes) - sizes
        both = np.full((len(chunks), 2), piece[-1])  # word and marks of each distinct chunk
        both[:, 0] = piece[: len(chunks)]
        both[tailed, 1] = piece[len(chunks) : -1]
        at = both[coded.indices.to_numpy()].ravel()
        n = sizes[at]
        edges = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(starts[at] - edges[:-1], n) + np.arange(edges[-1])]
        cuts = edges[2 * lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each distinct piece, kept for its next use; of an empty one, none."""
        words, letters = pieces.to_numpy(zero_copy_only=False).tolist(), pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False).tolist()
        missing = [(w, a) for w, a in zip(words, letters, strict=True) if w not in self.kept]
        if len(self.kept) + len(missing) > self.most:
            self.kept = dict(itertools.islice(self.kept.items(), self.most // 2))  # words met first are the frequent ones
            give_back()
            missing = [(w, a) for w, a in zip(words, letters, strict=True) if w not in self.kept]
        self._words([w for w, a in missing if a])
        others = [w for w, a in missing if not a]
        self.kept.update(zip(others, self._whole(others), strict=True))
        out = [self.kept[w] for w in words]
        for w, _ in missing:
            if len(w) > LONGEST:
                self.kept.pop(w, None)
        return out


def _word_end(path: str) -> str | None:
    """The suffix that ends each word, where the file's rules drop the white space between words and the case of letters,
    and take marks as words of their own; else nothing."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before = rules.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [before])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    normal = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "[^\\s" in pattern and not re.search(r"(?<!\^)\\s|\\S| \?", pattern)
    alike = {"Lowercase"} <= set(normal) <= {"NFC", "Replace", "Lowercase"} and "[^\\s\\p{L}\\p{N}]+" in pattern
    return rules["model"].get("end_of_word_suffix") if drops and alike else None
