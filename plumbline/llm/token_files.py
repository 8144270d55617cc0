"""Token-ID files: each document's ids compressed on their own with one shared zstandard dictionary.

A file is: MAGIC, the 32-byte SHA-256 of the dictionary, the compressed documents one after another, their index
(four little-endian 64-bit integers a document: id, offset, compressed bytes, tokens), and a footer (offset of the
index, number of documents, MAGIC). The dictionary lies beside the files as dictionary-<hash>.zdict. A short document
is read with two range reads, without what comes before it. Files are written and read with pyarrow's file systems,
so the folder may be in any store it knows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import keyed, materialize, partitions, unkeyed
from plumbline.llm.tokens import encoder

MAGIC = b"PLTOKID1"
_FOOTER = "<QQ8s"
#: Documents that the dictionary is trained on at most, bytes of each, and bytes of the dictionary.
LEVEL = 1
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8192, 65_536


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def serialize(ids: np.ndarray) -> bytes:
    """ids as 16-bit integers where all fit, else as 32-bit; the first byte tells which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65_536 else b"\x04" + ids.astype("<u4").tobytes()


def deserialize(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"\x02" else "<u4", offset=1).astype(np.uint32)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """A zstandard dictionary from the ids of a bounded sample: SAMPLE_DOCS documents of smallest hash, SAMPLE_BYTES each.

    Of too few or too short documents none can be trained; it is empty then. The dictionary alters sizes only.
    """
    import zstandard

    bucket = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    bound = min(1 << 30, (1 << 30) * SAMPLE_DOCS // max(1, docs.count()))
    texts = docs.where(bucket <= bound).select(bucket.alias("bucket"), F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    sample = [r["text"] for r in texts.orderBy("bucket", "text").limit(SAMPLE_DOCS).collect()]
    raw = [serialize(ids)[:SAMPLE_BYTES] for ids in encoder(tokenizer_path)(sample, end_id)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    import zstandard

    if not raw:
        return None
    shared = zstandard.ZstdCompressionDict(raw)
    shared.precompute_compress(level=LEVEL)  # else each document would digest it anew
    return shared


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every row's whole text, end_id last, in ascending doc_id order; returns (part, path, docs, tokens).

    Null texts are empty; rows with a null doc_id come first, in files as the smallest 64-bit integer, and are read
    as null; rows that repeat an id follow each other. Texts are encoded and compressed where they are read; the
    compressed documents are what the sort by id moves. Each attempt of a task writes a file of its own name, and the
    result names those of the attempts that ended; files of others are left unnamed. Of an empty table, no files.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text=text_col)
    dictionary = train_dictionary(rows, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    store, at = file_system(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/dictionary-{digest.hex()}.zdict") as f:
        f.write(dictionary)

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        encode = encoder(tokenizer_path)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        for batch in batches:
            n, packed = [], []
            for ids in encode(batch["text"], end_id):
                n.append(len(ids))
                packed.append(squeeze(serialize(ids)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "packed": packed})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}-{uuid.uuid4().hex}.ids"
        index, offset, tokens, f = [], len(MAGIC) + 32, 0, None
        for batch in batches:
            if f is None:
                f = store.open_output_stream(f"{at}/{name}")
                f.write(MAGIC + digest)
            for doc_id, n, packed in zip(batch["doc_id"], batch["n_tokens"], batch["packed"], strict=True):
                f.write(packed)
                index.append((doc_id, offset, len(packed), n))
                offset += len(packed)
                tokens += n
        if f is not None:
            f.write(np.array(index, "<i8").tobytes())
            f.write(struct.pack(_FOOTER, offset, len(index), MAGIC))
            f.close()
            yield pd.DataFrame({"part": [part], "path": [f"{folder}/{name}"], "docs": [len(index)], "tokens": [tokens]})

    packed = rows.mapInPandas(compress, "doc_id long, n_tokens long, packed binary")
    # written once: the range partitioning samples its input, which would encode every text again
    packed = materialize(packed, "token-ids")
    ordered = packed.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "packed")
    return materialize(ordered.mapInPandas(write, "part int, path string, docs long, tokens long"), "token-parts")


class TokenFile:
    """One file: its index in memory, its documents read by range."""

    def __init__(self, path: str):
        import zstandard

        store, at = file_system(path)
        self.f = store.open_input_file(at)
        size = self.f.size()
        start, n, magic = struct.unpack(_FOOTER, self.f.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        head = self.f.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.index = np.frombuffer(self.f.read_at(32 * n, start), "<i8").reshape(n, 4)
        with store.open_input_file(f"{at.rsplit('/', 1)[0]}/dictionary-{head[len(MAGIC) :].hex()}.zdict") as d:
            raw = d.read()
        if hashlib.sha256(raw).digest() != head[len(MAGIC) :]:
            raise ValueError(f"the dictionary of {path} was changed")
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        return deserialize(self.expand(self.f.read_at(int(self.index[i, 2]), int(self.index[i, 1]))))

    def documents(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of all documents in order, read in blocks of about so many bytes."""
        i = 0
        while i < len(self.index):
            start = int(self.index[i, 1])
            j = max(i + 1, int(np.searchsorted(self.index[:, 1], start + block)))
            end = int(self.index[j - 1, 1] + self.index[j - 1, 2])
            data = self.f.read_at(end - start, start)
            for k in range(i, j):
                a = int(self.index[k, 1]) - start
                yield deserialize(self.expand(data[a : a + int(self.index[k, 2])]))
            i = j

    def find(self, doc_id: int) -> Iterator[np.ndarray]:
        """The ids of the documents of this id: a binary search of the index, then one range read each."""
        a, b = np.searchsorted(self.index[:, 0], [doc_id, doc_id + 1])
        return (self.document(i) for i in range(a, b))


def read_token_files(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, start counted over all files in order.

    parts: what write_token_files returned. One row for each file passes the driver, for the sums before it.
    """
    listed = parts.orderBy("part").collect()
    before = np.cumsum([0, *[r["tokens"] for r in listed]]).tolist()
    files = [(r["path"], b) for r, b in zip(listed, before, strict=False)]
    frame = spark.createDataFrame(files, "path string, base long").repartition(max(1, min(len(files), partitions(spark) * 4)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                file = TokenFile(path)
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in file.documents()), np.int64, len(file.index))
                n = file.index[:, 3]
                yield pd.DataFrame({"doc_id": file.index[:, 0], "start": base + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    return unkeyed(frame.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
